"""Rules of fact sets, types of arguments, plans that stay small, and functions in SQL."""

import pytest
from pyspark.sql import functions as F

from attestor.functions import grammar
from attestor.functions.register import register
from attestor.operators import answers, datagen, factset, gate, trials


@pytest.mark.parametrize("pattern, unsafe", [("(a+)+b", True), ("(a*)*", True), ("(?:a|b{2,})+", True), ("(a{1,20})+", True), (r"\d+", False), (r"every \d+ (?:to \d+ )?hours?", False), (r"\(a+\)+", False), ("(a+", False), ("a{1,3}+", False)])
def test_repeats_of_repeats(pattern, unsafe):
    assert factset.repeats_of_repeats(pattern) is unsafe


def test_prefixes_and_warnings():
    assert factset.scaled("mcg") == ("g", 1e-6) and factset.scaled("kg") == ("g", 1e3) and factset.scaled("m") == ("m", 1.0) and factset.scaled("dag") == ("g", 1e1)
    assert factset.FactSet(value_qualifiers=["PO", r"q\d+h"]).qualifier_warnings() == [r"qualifier 'q\\d+h' is treated as a pattern"]
    assert factset.abbreviates("hr", "hour") and not factset.abbreviates("abc", "xyz")


def test_argument_types(spark):
    rows = spark.createDataFrame([(1, "a", "b", None)], "entity_mention int, relation string, claimed_value string, context map<string,string>")
    with pytest.raises(TypeError, match="entity_mention"):
        gate.check_arguments(rows)


def test_claims_may_have_any_columns(spark):
    fs = factset.FactSet.from_dict(spark, {"entities": {"a": []}, "relations": {"x": {"kind": "quantity"}}, "facts": [{"s": "a", "r": "x", "o": "5 kg", "source": "5 kg"}]})
    names = ("source", "numeric", "variants", "status", "declared", "o", "when", "surface", "__n", "value")
    df = spark.createDataFrame([("a", "x", "6 kg", None, *"0123456789")], "entity_mention string, relation string, claimed_value string, context map<string,string>, " + ", ".join(f"{n} string" for n in names))
    row = gate.gate(df, fs.alias_table(spark), fs.slot_table(spark)).where("status = 'BLOCK'").first()
    assert row["declared"] == "5 kg" and row["source"] == "5 kg" and row["numeric"] == "1" and row["variants"] == "2" and row["when"] == "6"


def test_filters_on_verdicts_stay_above_them(spark):
    rows = spark.createDataFrame([("5 kg",)], "v string")
    plan = grammar.parsed(rows, "v", "p", F.lit(True)).where("p.q.value > 3")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000 and grammar.parsed(rows, "v", "p", F.lit(True)).where("p.q.value > 3").count() == 1


def test_unknown_split_raises(spark):
    rows = spark.createDataFrame([("other", "a", "b")], "split string, final_answer string, expected string")
    with pytest.raises(Exception, match="no scorer for split other"):
        answers.scored(rows).collect()
    assert "multi_hop" not in answers.SPLITS


def test_holdout_is_exact_and_disjoint(spark):
    rows = spark.createDataFrame([(f"s{i}", "isa", f"o{i % 7}") for i in range(50)], "s string, r string, o string")
    out = datagen.held_out(rows, 13, 5)
    assert out.where("held_out").count() == 13 and out.count() == 50
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, datagen.held_out(rows.repartition(9), 13, 5).collect()))
    assert datagen.held_out(rows, 99).where("held_out").count() == 50


def test_rebased_and_reparsed(spark):
    df = spark.createDataFrame([("$1.50/day", "$1.50 per customer", False, False), ("5 mg", "5 kg", True, False), ("5 mg", "5 mg", False, True), ("5-9 mg", "7 mg", False, True), ("red", "RED ", False, True), (None, "x", False, False)], "a string, b string, rebased boolean, equal boolean")
    assert df.where((trials.rebased(F.col("a"), F.col("b")) != F.col("rebased")) | (trials.equal_by_reparse(F.col("a"), F.col("b")) != F.col("equal"))).collect() == []


def test_functions_in_sql(spark):
    register(spark, lambda c: F.upper(c), ("parse_range", "compare_values", "normalise_value", "wilson_hi"))
    row = spark.sql("select parse_range('5-10 mg/kg').high as h, compare_values('5-10 mg/kg', '20 mg/kg') as c, normalise_value('x') as n, round(wilson_hi(0, 366), 4) as w").first()
    assert tuple(row) == (10.0, "DIFFER", "X", 0.0104)
