"""Guards on answers, mentions and suggestions, each in a job or two."""

from pyspark.sql import functions as F

from attestor.functions.text import offsets, shortest
from attestor.operators import extract, factset, suggest, trials

PASSAGE = "Give acetaminophen 7.5 mg/kg PO every four hours. Fee: $1,500 per user."


def test_grounding(spark):
    rows = [
        ("7.5 mg/kg", True), ("15 mg/kg", False), ("7.5 mg", True), ("7.5 litres", False), ("4 hours", True), ("$1,500 per user", True), ("$1500", False), ("$1.5k", False), ("500 zorkmids", False), ("acetaminophen", True),
        ("ibuprofen", False), ("5 mg/kg", False), ("", False), (None, False),
    ]
    df = spark.createDataFrame(rows, "v string, expected boolean").withColumn("p", F.lit(PASSAGE))
    assert df.where(extract.is_grounded(F.col("v"), F.col("p")) != F.col("expected")).collect() == []
    aliased = df.limit(1).select(extract.is_grounded(F.lit("5 mg/kg"), F.lit("it is 5 milligrams per kilogram"), {"milligrams per kilogram": "mg/kg"}).alias("x"))
    assert aliased.first().x


def test_hostile_answers_make_no_claim(spark):
    spec = {
        "entities": {"drug": ["APAP"], "other drug": []}, "relations": {"dose": {"kind": "quantity"}, "total": {"kind": "quantity"}},
        "facts": [{"s": "drug", "r": "dose", "o": "15 mg/kg"}, {"s": "drug", "r": "total", "o": "75 mg/kg"}],
    }
    fs = factset.FactSet.from_dict(spark, spec)
    hostile = ["15 mg/kg", "fifteen mg/kg", "I cannot say", "n/a", "", "7.5 мг/кг", "15 mg/kg PO", "None stated.", "sorry, 7.5 mg/kg", "7.5 zorkmids/kg"]
    passages = [(str(i), "APAP: give 7.5 mg/kg, at most 75 mg/kg.", a) for i, a in enumerate([*hostile, "Value: 7.5mg/kg.", "7.5 mg/kg"])]
    passages += [("decoy", "APAP: give 7.5 mg/kg or 9 mg/kg.", "7.5 mg/kg"), ("prose", "APAP is given as 15 mg/kg.", "it is refrigerated and kept, as told; at 15 mg/kg in all")]
    df = spark.createDataFrame(passages, "passage_id string, text string, answer string")
    answers = df.select("passage_id", F.lit("drug").alias("entity"), F.lit("dose").alias("relation"), "answer")
    got = {r.passage_id: (r.value, r.state) for r in extract.extract(df, fs.alias_table(spark), fs.slot_table(spark), fs.fact_table(spark), answers=answers).where("relation = 'dose'").collect()}
    assert {i for i, (_, state) in got.items() if state == "claim"} == {"10", "11"}
    assert got["10"][0] == "7.5 mg/kg" and got["decoy"] == ("7.5 mg/kg", "unresolved") and got["prose"] == ("15 mg/kg", "unresolved")


def test_mentions(spark):
    names = spark.createDataFrame([("Alpha Fund / Beta Fund", "round"), ("Angels (alt-arch AI)", "angels"), ("Summer On-Peak Energy", "summer"), ("acetaminophen", "drug"), ("energy", "e"), (None, "none")], "surface string, entity string")
    texts = [
        ("Beta Fund and also Alpha Fund came in", {"round"}), ("only Alpha Fund", set()), ("the angels' money", {"angels"}), ("in summer the on-peak rate of energy", {"summer", "e"}), ("aceta-\nminophen", {"drug"}), ("energetic", set()), (None, set()),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "passage_id long, text string")
    got: dict[int, set] = {}
    for r in extract.mentions(df, names).collect():
        got.setdefault(r.passage_id, set()).add(r.entity)
    assert [got.get(i, set()) for i in range(len(texts))] == [e for _, e in texts]


def test_alias_suggestions(spark):
    surfaces = spark.createDataFrame([("yc", "yc"), ("the raise", "the raise"), ("Series A", "series a")], "surface string, entity string")
    rows = [(1, "Y Combinator typically takes around 7% equity", "yc", "7%"), (2, "We are raising 7% by Series B", "the raise", "7%"), (3, "Y Combinator takes some", "yc", "7%"), (4, "yc takes 7%", "yc", "7%")]
    df = spark.createDataFrame(rows, "text_id long, text string, entity string, declared string")
    assert {r.text_id: r.candidates for r in suggest.suggest_aliases(df, surfaces).collect()} == {1: ["Y Combinator"], 2: ["Series B", "raising"]}


def test_qualifier_suggestions_try_the_least(spark):
    rows = [(1, "1 hour", "within 1 hour of submission"), (2, "1 hour", "within 1 hour"), (3, "30 days", "30 days net"), (4, "30 days", "30 days"), (5, "30 days", "31 days net"), (6, None, "x"), (7, "$5", "$5 monthly")]
    got = {r.residue: (r.n, r.risky) for r in suggest.suggest_qualifiers(spark.createDataFrame(rows, "pos long, declared string, claimed string")).collect()}
    assert got["of submission"] == (1, False) and got["within"] == (2, False) and got["net"] == (1, False)


def test_shortest_is_pythons(spark):
    values = [0.0, 1.0, -2.5, 123456.0, 1234567.0, 1e-5, 0.00012, 99999.94, 1e100, -1e-300, 0.1, 1 / 3]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(shortest(F.col("v")).alias("x")).collect()]
    assert got == [f"{v:g}" for v in values]


def test_offsets():
    text = " It cost $23.70. Really?!  No... \n Yes"
    assert [text[s:e] for s, e in offsets(text)] == ["It cost $23.70.", "Really?!", "No...", "Yes"] and offsets("  ") == []


def test_corruption(spark):
    rows = [("$150M", 0), ("$4M-$8M", 0), ("10 mg/kg", 1), ("no number", 2), ("0 mg", 0), (None, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, k int")
    got = [r.wrong for r in trials.corrupted(df, "v", "k", "wrong").orderBy("i").collect()]
    assert got[:5] == ["$300M", "$400M-$800M", "5 mg/kg", "unspecified", "0 mg"]
