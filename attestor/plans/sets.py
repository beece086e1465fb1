"""Queries of fact sets as documents, of files, and of the gate's rarer paths."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from attestor import __version__
from attestor.functions.grammar import ABSENT
from attestor.operators import answers, compare, datagen, factset, gate
from attestor.plans.answers import _echoed
from attestor.plans.catalogue import knowledge, no_context, query, t
from attestor.plans.examples import KB, STATES, _draw, QT
from attestor.session import shared_path
from attestor.sources import files


def market(spark, sf_dir) -> factset.FactSet:
    """Regions as a curated document: a lead time for each, and two fees that depend on the season."""
    region = sorted(t(spark, sf_dir, "region").select("r_regionkey", "r_name").collect())
    corpus = " ".join(f"Goods for {r.r_name} take {10 + r.r_regionkey} days by sea." for r in region)
    facts = [{"s": r.r_name, "r": "lead_time", "o": f"{10 + r.r_regionkey} days", "source": f"Goods for {r.r_name}  take {10 + r.r_regionkey} days by sea."} for r in region]
    for r in region:
        facts += [{"s": r.r_name, "r": "fee", "o": f"${100 + r.r_regionkey}", "source": "not there", "when": {"season": "summer"}}, {"s": r.r_name, "r": "fee", "o": f"${200 + r.r_regionkey}", "source": "nor this", "when": {"season": "winter"}}]
    spec = {
        "domain": "market", "corpus": corpus, "entities": {r.r_name: [f"region {r.r_regionkey}"] for r in region}, "relations": {"lead_time": {"kind": "quantity"}, "fee": {"kind": "quantity"}}, "conditions": ["season"],
        "value_qualifiers": ["on average"], "unit_aliases": {"business days": "days"}, "facts": facts,
    }
    path = shared_path(spark, "spec")
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(path)
    return factset.FactSet.from_json(spark, path)


@query("""select r_name as entity, 'lead_time' as relation, (10 + r_regionkey) || ' days' as o, 0 as conditions from region union all select r_name, 'fee', '$' || (100 + r_regionkey), 1 from region union all select r_name, 'fee', '$' || (200 + r_regionkey), 1 from region""")
def factset_document(spark, sf_dir):
    """A fact set written as a JSON document, read and checked."""
    return market(spark, sf_dir).fact_table(spark).select("entity", "relation", "o", F.size("when").alias("conditions"))


@query("select r_name as entity, 'fee' as relation, count(*) as n from region, range(2) group by all")
def unquoted_sources(spark, sf_dir):
    """Facts whose source isn't in the document's corpus, white space aside."""
    return market(spark, sf_dir).missing_sources(spark).groupBy("entity", "relation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select n_nationkey, case n_nationkey % 5 when 0 then 'VERIFIED' when 1 then 'BLOCK' when 2 then 'VERIFIED' when 3 then 'HELD' else 'HELD' end as status, (10 + n_regionkey) || ' days' as declared, 'Goods for ' || r_name || '  take ' || (10 + n_regionkey) || ' days by sea.' as source,
  '{__version__}' as library_version, true as stamped from nation join region on n_regionkey = r_regionkey""")
def factset_verdicts(spark, sf_dir):
    """Claims in other units' names, with a qualifier, with the source's own wording, and in words."""
    fs, k = market(spark, sf_dir), F.col("n_nationkey") % 5
    days = (F.col("n_regionkey") + 10).cast("string")
    value = F.when(k == 0, F.concat(days, F.lit(" business days, on average"))).when(k == 1, F.concat((F.col("n_regionkey") + 50).cast("string"), F.lit(" days"))).when(k == 2, F.concat(days, F.lit(" days by sea"))).when(k == 3, F.concat(days, F.lit(" days by air"))).otherwise(F.lit("n/a"))
    claims = t(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("\tREGION "), F.col("n_regionkey").cast("string")).alias("entity_mention"), F.lit("lead_time").alias("relation"), value.alias("claimed_value"), no_context())
    got = gate.gate(claims, fs.alias_table(spark), fs.slot_table(spark), fs.fingerprint(), fs.normalise)
    return got.select("n_nationkey", "status", "declared", "source", "library_version", (F.col("factset_fingerprint") == fs.fingerprint()).alias("stamped"))


@query("""select n_nationkey, case n_nationkey % 3 when 0 then 'HELD' when 1 then 'BLOCK' else 'HELD' end as status, case n_nationkey % 3 when 0 then '$' || (200 + n_regionkey) else '$' || (100 + n_regionkey) || ' | $' || (200 + n_regionkey) end as declared,
  case n_nationkey % 3 when 0 then 'nor this' else 'not there' end as source, case n_nationkey % 3 when 0 then 'depends on season' when 1 then 'differs from the value under every condition' else 'undecided under season' end as reason from nation""")
def ambiguous_verdicts(spark, sf_dir):
    """Claims on fees without a season: one of the two, neither, or nothing that compares."""
    fs, k = market(spark, sf_dir), F.col("n_nationkey") % 3
    value = F.when(k == 0, F.concat(F.lit("$"), (F.col("n_regionkey") + 200).cast("string"))).when(k == 1, F.lit("$7")).otherwise(F.lit("about right"))
    claims = t(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("entity_mention"), F.lit("fee").alias("relation"), value.alias("claimed_value"), no_context())
    got = gate.gate(claims, fs.alias_table(spark), fs.slot_table(spark), fs.fingerprint(), fs.normalise)
    return got.select("n_nationkey", "status", "declared", "source", "reason")


@query("""select * from (values ('lone_condition', 'error', 1), ('open_range_source', 'warning', 1), ('qualifier_collapse', 'error', 1), ('rate_qualifier', 'warning', 1), ('short_units', 'warning', 1), ('unit_known_unknown', 'error', 1), ('unit_rescale', 'error', 1), ('unit_scale', 'error', 2)) v(rule, severity, n)""")
def lint_rules(spark, sf_dir):
    """A fact set that breaks every rule of lint once, and one twice; spellings of one unit break none."""
    spec = {
        "corpus": "", "entities": {"a": [], "b": []}, "relations": {"x": {"kind": "quantity"}, "y": {}}, "conditions": ["c"], "value_qualifiers": ["orally", "each month"],
        "unit_aliases": {"milligrams": "mg", "g": "mg", "lb": "gal", "zorks": "kg", "kvolt": "volt", "abc": "xyz", "us gallons": "gal"},
        "facts": [{"s": "a", "r": "y", "o": "red orally"}, {"s": "b", "r": "y", "o": "red"}, {"s": "a", "r": "x", "o": "5 kg", "when": {"c": "1"}}, {"s": "b", "r": "x", "o": "100 kg", "source": "at least 100 kg+"}],
    }
    found = factset.FactSet.from_dict(spark, spec).lint(spark)
    return spark.createDataFrame([(x["rule"], x["severity"]) for x in found], "rule string, severity string").groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'DIFFER' when 1 then 'INCOMPARABLE' when 2 then 'INCOMPARABLE' else 'MATCH' end as outcome, p_partkey % 4 = 1 as absent from part")
def leading_ranges(spark, sf_dir):
    """A declared range against claims that begin with another range, that are absent, that begin with the same one, and a point."""
    low, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    high = (F.col("p_size") + 4).cast("string")
    declared = F.concat(low, F.lit("-"), high, F.lit(" weeks"))
    claimed = (
        F.when(k == 0, F.concat((F.col("p_size") + 100).cast("string"), F.lit("-"), (F.col("p_size") + 200).cast("string"), F.lit(" weeks after v0.5"))).when(k == 1, F.lit("Unknown, it says"))
        .when(k == 2, F.concat(low, F.lit(" to "), high, F.lit(" weeks after v0.5"))).otherwise(F.concat((F.col("p_size") + 2).cast("string"), F.lit(" weeks")))
    )
    rows = t(spark, sf_dir, "part").select("p_partkey", declared.alias("declared"), claimed.alias("claimed"), F.lit(False).alias("numeric"))
    return compare.compare(rows).select("p_partkey", "outcome", F.col("claimed").rlike(ABSENT).alias("absent"))


@query("select c_custkey as source_id, 'Market ' || c_mktsegment as text, c_custkey % 7 as start, c_custkey % 7 + 5 as \"end\" from customer where c_custkey % 3 = 0 and c_custkey % 2 = 0")
def span_files(spark, sf_dir):
    """Responses with labelled spans and their sources, from two files, of one task and one split."""
    rows, path = t(spark, sf_dir, "customer"), shared_path(spark, "spans")
    key = F.col("c_custkey").cast("string").alias("source_id")
    labels = F.array(F.struct((F.col("c_custkey") % 7).cast("int").alias("start"), (F.col("c_custkey") % 7 + 5).cast("int").alias("end")))
    rows.select(key, F.lit("m").alias("model"), F.when(F.col("c_custkey") % 2 == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"), F.col("c_name").alias("response"), labels.alias("labels")).write.json(f"{path}/responses")
    rows.select(key, F.when(F.col("c_custkey") % 3 == 0, F.lit("QA")).otherwise(F.lit("Summary")).alias("task_type"), F.concat(F.lit("Market "), F.col("c_mktsegment")).alias("source_info")).write.json(f"{path}/sources")
    got = files.read_spans(spark, f"{path}/responses", f"{path}/sources", "QA", "test").select(F.col("source_id").cast("long"), F.col("source_info").alias("text"), F.explode("labels").alias("l"))
    return got.select("source_id", "text", F.col("l.start").cast("long").alias("start"), F.col("l.end").cast("long").alias("end"))


@query("select 'lines' as what, count(*) as n from conversations union all select 'covered', count(distinct conv_id) from conversations union all select 'valid', count(*) filter (where trim(text) <> '') from conversations union all select 'first', 5")
def example_files(spark, sf_dir):
    """Training examples as JSON lines beside blank and torn ones: counted, their source triples, the valid ones, and the first five triples."""
    rows, path = t(spark, sf_dir, "conversations"), shared_path(spark, "sft")
    triple = F.struct(F.col("conv_id").cast("string").alias("s"), F.lit("isa").alias("r"), F.lit("talk").alias("o"))
    rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("qa").alias("generator"), datagen.messages(F.lit("Say it."), F.col("text")).alias("messages"), F.struct(triple.alias("source_triple")).alias("meta")).write.json(path)
    spark.createDataFrame([(" ",), ("",)], "value string").write.mode("append").text(path)
    lines = files.count_lines(spark, path)
    valid = files.validate_examples(spark, path)[0]
    covered = files.read_covered(spark, path)
    told = shared_path(spark, "covered")
    files.write_lines(covered, told)
    out = [("lines", lines), ("covered", covered.count()), ("valid", valid), ("first", files.read_triples(spark, told, 5).count())]
    return spark.createDataFrame(out, "what string, n long")


@query("select n_nationkey, n_nationkey % 4 as facts from nation where n_nationkey % 4 >= 2 and n_nationkey <> 3")
def hashed_documents(spark, sf_dir):
    """Text files with enough numeric facts, small enough, and not excluded by name."""
    path = shared_path(spark, "documents")
    body = F.concat(F.lit("Of it: "), F.array_join(F.array_repeat(F.lit("$5.50"), (F.col("n_nationkey") % 4).cast("int")), " and "))
    rows = t(spark, sf_dir, "nation").select("n_nationkey", body.alias("value"))
    names = {r.n_nationkey: r.value for r in rows.collect()}
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for key, text in names.items():
        for folder in ("docs", "docs/vendor"):
            out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/n{key}.md"))
            out.write(bytearray(text.encode()))
            out.close()
    got = files.documents_in_hash_order(spark, path, 200, 2, ("n3.md",))
    return got.select(F.regexp_extract("path", r"n([0-9]+)\.md$", 1).cast("int").alias("n_nationkey"), F.col("facts").cast("int").alias("facts"))


_E = "select case s_suppkey % 3 when 0 then 'knowable_heldout' when 1 then 'unknowable' else 'adversarial_nearmiss' end as split, count(*) as n, count(*) filter (where case s_suppkey % 3 when 0 then s_suppkey % 4 < 2 else s_suppkey % 4 = 0 end) as correct from supplier join nation on s_nationkey = n_nationkey group by 1"


@query(f"select split, 'echo' as target, n, correct, correct / n as accuracy, true as reported from ({_E})")
def result_files(spark, sf_dir):
    """Result objects written, read back beside what isn't one, and reported."""
    path = shared_path(spark, "results")
    summary = answers.split_summary(answers.scored(answers.rechecked(answers.echoed(_echoed(spark, sf_dir)), knowledge(spark, sf_dir))))
    files.write_contract(summary, f"{path}/{answers.safe_name('echo:a/b')}", "echo", 0)
    spark.createDataFrame([("{broken",), ('{"split": "x"}',)], "value string").write.text(f"{path}/other")
    got = files.read_results(spark, path)
    report = files.render_results(got)
    told = F.udf(lambda n, k: f"| {files.percent(k / n)} (" in report, "boolean")
    return got.select("split", "target", "n", "correct", "accuracy", told("n", "correct").alias("reported"))


@query(f"""with {KB}, {STATES}, {QT}, a as (select kb.s, kb.r, kb.o, replace(template, '{{s}}', kb.s) as question, answer, 1.0 / st.n as score from kb join st using (s, r) join qf on qf.r = kb.r join qt on qt.r = kb.r and qt.direction = 'forward' and qt.place = {_draw('qf.n', 5, 'question', 'kb.s', 'kb.r', 'kb.o')})
select question, case when score >= 0.11 then answer || '. [kb:' || s || '/' || r || '/' || answer || ']' else 'I don''t know. The knowledge base has no confident answer. [kb:idk]' end as answer, s, r, o from a""")
def live_answers(spark, sf_dir):
    """Every fact's question answered by the knowledge base, or with not knowing where it isn't confident."""
    kb = knowledge(spark, sf_dir)
    return datagen.live_answers(kb, kb, 5).select("question", "answer", "s", "r", "o")
