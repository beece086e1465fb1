"""Queries of models' output and the re-check of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import answers
from attestor.plans.catalogue import knowledge, query, rounded, t
from attestor.plans.examples import KB, STATES


@query("""select c_custkey, c_custkey % 4 < 2 as strict, case c_custkey % 4 when 0 then 2 when 1 then 0 when 2 then 1 else 0 end as n, case when c_custkey % 4 in (0, 2) then c_name end as first from customer""")
def model_triples(spark, sf_dir):
    """Triples in JSON with prose around and objects that aren't triples, an empty array, broken JSON, and prose."""
    name, k = F.col("c_name"), F.col("c_custkey") % 4
    one = F.concat(F.lit('{"s": "'), name, F.lit('", "r": "isa", "o": "customer"}'))
    raw = (
        F.when(k == 0, F.concat(F.lit("Here:\n["), one, F.lit(', {"s": "x", "r": "y"}, 7, {"s": "a", "r": "b", "o": 5}]\nDone.'))).when(k == 1, F.lit("I found none: []"))
        .when(k == 2, F.concat(F.lit('["s": "'), name, F.lit('", "r": "isa", "o": "customer"]'))).otherwise(F.lit("nothing here"))
    )
    rows = t(spark, sf_dir, "customer").select("c_custkey", answers.parse_triples(raw).alias("p"))
    return rows.select("c_custkey", "p.strict", F.size("p.triples").alias("n"), F.get("p.triples", F.lit(0))["s"].alias("first"))


@query(f"""with {KB}, {STATES}, u as (select r, o, count(*) as n, min(s) as first from kb group by all)
select s_suppkey, case s_suppkey % 4 when 0 then n_name when 1 then (select first from u where r = 'locatedin' and o = n_name) when 2 then 'locatedin' end as top from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 4 <> 3""")
def kb_rounds(spark, sf_dir):
    """Queries in replies, for the object, the subject and the relation, against the knowledge base; a broken block asks nothing."""
    kb, k = knowledge(spark, sf_dir), F.col("s_suppkey") % 4
    rows = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    block = (
        F.when(k == 0, F.to_json(F.struct(F.col("s_name").alias("s"), F.lit("locatedin").alias("r"), F.lit("O").alias("unknown"))))
        .when(k == 1, F.concat(F.lit("["), F.to_json(F.struct(F.lit("locatedin").alias("r"), F.col("n_name").alias("o"), F.lit("s").alias("unknown"))), F.lit("]")))
        .when(k == 2, F.to_json(F.struct(F.col("s_name").alias("s"), F.col("n_name").alias("o"), F.lit("R").alias("unknown")))).otherwise(F.lit('{"s": '))
    )
    said = rows.select("s_suppkey", F.explode(answers.kb_queries(F.concat(F.lit("Let me see. <kb_q>"), block, F.lit("</kb_q> and so on")))).alias("q"))
    return answers.execute(said, kb).select("s_suppkey", F.get("symbols", F.lit(0)).alias("top"))


def _echoed(spark, sf_dir):
    """Examples of the three splits, whose questions cite a right fact, a wrong one or none, and say what an answer should."""
    rows = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k, m = F.col("s_suppkey") % 3, F.col("s_suppkey") % 4
    said = F.when(m < 2, F.col("n_name")).otherwise(F.lit("ATLANTIS"))
    cite = F.concat(F.lit("[kb:"), F.col("s_name"), F.lit("/locatedin/"), said, F.lit("]"))
    question = F.when(k == 1, F.when(m == 0, F.lit("I don't know. [kb:idk]")).otherwise(F.concat(F.lit("It is so. "), cite))).when(k == 2, F.concat(F.when(m % 2 == 0, F.lit("No, ")).otherwise(F.lit("Yes: ")), cite)).otherwise(cite)
    split = F.when(k == 0, F.lit("knowable_heldout")).when(k == 1, F.lit("unknowable")).otherwise(F.lit("adversarial_nearmiss"))
    return rows.select(F.col("s_suppkey").alias("id"), split.alias("split"), question.alias("question"), F.when(k != 1, F.col("n_name")).alias("expected"))


_E = """e as (select s_suppkey % 3 as k, s_suppkey % 4 as m from supplier join nation on s_nationkey = n_nationkey),
x as (select case k when 0 then 'knowable_heldout' when 1 then 'unknowable' else 'adversarial_nearmiss' end as split, k, case k when 0 then m < 2 when 1 then m = 0 else m = 0 end as correct, case when k = 1 and m = 0 then 0 else 1 end as claims, case when k = 1 and m = 0 then 0 when m < 2 then 0 else 1 end as blocked from e)"""


@query(f"""with {_E} select split, n, correct, claims as claims_checked, blocked, coalesce(claims - blocked, 0) as verified, round(blocked / nullif(claims, 0), 9) as rate, case when split = 'unknowable' then correct end as abstained from
(select split, count(*) as n, count(*) filter (where correct) as correct, sum(claims)::bigint as claims, sum(blocked)::bigint as blocked from x group by 1)""")
def echo_run(spark, sf_dir):
    """The echo target over all splits: scores, and the verdicts on what its answers cite."""
    done = answers.rechecked(answers.echoed(_echoed(spark, sf_dir)), knowledge(spark, sf_dir))
    rows = answers.split_summary(answers.scored(done))
    return rounded(rows.select(
        "split", "n", "correct", "claims_checked", "blocked", F.coalesce(F.try_element_at("verdict_counts", F.lit("VERIFIED")), F.lit(0)).alias("verified"), F.col("gated_hallucination_rate").alias("rate"),
        F.when(F.col("split") == "unknowable", F.col("abstention_n")).alias("abstained"),
    ))


@query(f"""with {KB}, {STATES} select s_suppkey as id, case when s_suppkey % 2 = 0 then 2 else 1 end as rounds, case when s_suppkey % 2 = 0 then 1 else 0 end as executed, case when s_suppkey % 2 = 0 then 1 else 0 end as claims_checked from supplier""")
def tool_rounds(spark, sf_dir):
    """A recorded model that asks the knowledge base first, every other time, and then cites what it was told."""
    examples = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Where is "), F.col("s_name"), F.lit("?")).alias("question"), "s_name")

    def model(rows):
        ask = F.concat(F.lit("<kb_q>"), F.to_json(F.struct(F.col("s_name").alias("s"), F.lit("locatedin").alias("r"))), F.lit("</kb_q>"))
        told = F.regexp_extract("transcript", r'\{"results":\["([^"]+)"', 1)
        cite = F.concat(F.lit("It is in "), told, F.lit(". [kb:"), F.col("s_name"), F.lit("/locatedin/"), told, F.lit("]"))
        return rows.withColumn("reply", F.when((F.col("id") % 2 == 0) & ~F.contains("transcript", F.lit("<kb_r>")), ask).when(F.col("id") % 2 == 0, cite).otherwise(F.lit("I'm not sure.")))

    done = answers.rechecked(answers.tool_loop(examples, knowledge(spark, sf_dir), model, 3), knowledge(spark, sf_dir))
    return done.select("id", "rounds", F.size("executed").alias("executed"), F.col("claims_checked").cast("int").alias("claims_checked"))


@query("select conv_id, turn, n_name as s from conversations join nation on n_nationkey = conv_id % 25 where turn % 2 = 0")
def attributed_triples(spark, sf_dir):
    """Triples whose subject a sentence of their source names."""
    nation = t(spark, sf_dir, "nation")
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", "text").join(nation, F.col("n_nationkey") == F.col("conv_id") % 25)
    sentences = rows.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("In "), F.lower("n_name"), F.lit(" it is so."))).otherwise(F.lit("It is so.")).alias("text"))
    known = rows.select("conv_id", F.col("n_name").alias("s"), F.lit("isa").alias("r"), F.lit("nation").alias("o")).distinct()
    return answers.attributed(sentences, known, "conv_id").select("conv_id", "turn", "s")
