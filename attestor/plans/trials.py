"""Queries of trials of the gate. Parts' sizes are the facts; order items are trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import factset, gate, trials
from attestor.plans.catalogue import WILSON, no_context, query, t

#: Every item is a trial of its part's size in mg: stated, doubled on demand, or doubled by itself.
ITEMS = "i as (select l_orderkey, l_linenumber, l_returnflag as domain, p_partkey, p_size, p_brand, case l_linenumber % 3 when 0 then 'FAITHFUL' when 1 then 'CORRUPTED' else 'SPONTANEOUS' end as condition from lineitem join part on l_partkey = p_partkey)"


def items(spark, sf_dir) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("domain"), "l_partkey").join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_brand"), "l_partkey")
    k = F.col("l_linenumber") % 3
    condition = F.when(k == 0, F.lit(trials.FAITHFUL)).when(k == 1, F.lit(trials.CORRUPTED)).otherwise(F.lit(trials.SPONTANEOUS))
    return rows.select("l_orderkey", "l_linenumber", "domain", F.col("l_partkey").alias("p_partkey"), "p_size", "p_brand", condition.alias("condition"))


@query("""select p_partkey, case p_partkey % 4 when 0 then (p_size * 2) || ' mg' when 1 then case when p_size % 2 = 0 then (p_size // 2) || '' else (p_size // 2) || '.5' end || '-' || case when p_size % 2 = 0 then (p_size // 2 + 10) || '' else (p_size // 2 + 10) || '.5' end || ' mg'
  when 2 then '$' || (p_size * 3) || 'M' else 'unspecified' end as wrong, case p_partkey % 4 when 0 then 'valid' when 1 then null when 2 then 'left_intact' else null end as trial from part where p_size > 20""")
def corrupted_values(spark, sf_dir):
    """Wrong values in their own notation, ranges moved out of themselves; and texts that state them, or both values.

    A range halves to one that begins at half its lower bound; where that still overlaps, a hundred times as much is tried.
    """
    part = t(spark, sf_dir, "part").where("p_size > 20")
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    value = F.when(k == 0, F.concat(size, F.lit(" mg"))).when(k == 1, F.concat(size, F.lit("-"), (F.col("p_size") + 20).cast("string"), F.lit(" mg"))).when(k == 2, F.concat(F.lit("$"), size, F.lit("M"))).otherwise(F.lit("as needed"))
    rows = trials.corrupted(part.select("p_partkey", "p_size", value.alias("v"), k.alias("k")), "v", "k", "wrong")
    text = F.when(F.col("k") == 2, F.concat(F.lit("Not "), F.col("v"), F.lit(" but "), F.col("wrong"))).when(F.col("k") == 0, F.concat(F.lit("Take "), F.col("wrong"), F.lit(" now.")))
    return rows.select("p_partkey", "wrong", F.when(text.isNotNull(), trials.corrupted_trial(text, F.col("wrong"), F.col("v"))).alias("trial"))


@query("select p_partkey, p_partkey % 5 = 1 as other from part")
def other_values(spark, sf_dir):
    """Answers that state the declared value, another, another slot's, one in another unit, and none."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    another = (F.col("p_size") + 1000).cast("string")
    answer = (
        F.when(k == 0, F.concat(F.lit("It is "), size, F.lit(" mg, or "), another, F.lit(" mg."))).when(k == 1, F.concat(F.lit("It is "), another, F.lit(" mg.")))
        .when(k == 2, F.lit("It is 7777 mg.")).when(k == 3, F.concat(F.lit("It is "), another, F.lit(" litres."))).otherwise(F.lit("It depends."))
    )
    rows = t(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"), F.concat(size, F.lit(" mg")).alias("declared"), F.array(F.lit("7777")).alias("others"))
    return trials.states_other_value(rows, "answer", "declared", "others", "other").select("p_partkey", "other")


def judged(spark, sf_dir) -> DataFrame:
    """Trials with the verdict on what each states: a size, or no value at all for every fifth part."""
    rows = items(spark, sf_dir)
    size = F.col("p_size").cast("string")
    value = F.when(F.col("p_partkey") % 5 == 0, F.lit("unknown")).when(F.col("condition") == trials.FAITHFUL, F.concat(size, F.lit(" mg"))).otherwise(F.concat((F.col("p_size") * 2).cast("string"), F.lit(" mg")))
    part = t(spark, sf_dir, "part")
    facts = part.select(
        F.lit(0).alias("pos"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("entity"), F.lit("size").alias("relation"), F.concat(F.col("p_size").cast("string"), F.lit(" mg")).alias("o"),
        F.concat(F.lit("The size is "), F.col("p_size").cast("string"), F.lit(" mg of "), F.col("p_brand")).alias("source"), F.create_map().cast("map<string,string>").alias("when"), F.lit(True).alias("numeric"),
    )
    claims = rows.select("*", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("entity_mention"), F.lit("size").alias("relation"), value.alias("claimed_value"), no_context())
    return gate.gate(claims, facts.select(F.col("entity").alias("surface"), "entity"), factset.slots(facts), "sizes")


_J = f"{ITEMS}, j as (select *, case when p_partkey % 5 = 0 then 'HELD' when condition = 'FAITHFUL' then 'VERIFIED' when p_size = 0 then 'VERIFIED' else 'BLOCK' end as status from i)"


@query(f"""with {_J}, f as (select domain, p_partkey, count(*) filter (where condition <> 'FAITHFUL' and status = 'VERIFIED') as leaks, count(*) filter (where condition <> 'FAITHFUL') as nc, count(*) filter (where condition = 'FAITHFUL' and status <> 'VERIFIED') as obs,
  count(*) filter (where condition = 'FAITHFUL') as nf, count(*) filter (where condition = 'SPONTANEOUS') as ns from j group by all),
g as (select domain, sum(leaks)::bigint as leaks, sum(nc)::bigint as n_corrupted, sum(obs)::bigint as over_blocked, sum(nf)::bigint as n_faithful, sum(ns)::bigint as n_spontaneous, count(*) filter (where obs > 0) as over_facts, count(*) filter (where nf > 0) as n, count(*) as n_distinct_facts from f group by 1),
w as (select *, over_facts as k from g)
select domain, leaks, n_corrupted, over_blocked, n_faithful, n_spontaneous, over_facts, n_distinct_facts, round(leaks / n_corrupted, 9) as leak_rate, round(over_blocked / n_faithful, 9) as over_block_rate, round(lo, 9) as over_block_by_fact_lo, round(hi, 9) as over_block_by_fact_hi from (select *, {WILSON} from w)""")
def trial_summary(spark, sf_dir):
    """Leaks and over-blocks of a run of trials, by trial and by fact."""
    rows = trials.summary(judged(spark, sf_dir), ["domain"])
    names = ("leak_rate", "over_block_rate", "over_block_by_fact_lo", "over_block_by_fact_hi")
    return rows.select("domain", "leaks", "n_corrupted", "over_blocked", "n_faithful", "n_spontaneous", "over_facts", "n_distinct_facts", *(F.round(c, 9).alias(c) for c in names))


@query(f"""with {ITEMS} select domain, case when l_linenumber = 6 then 'genuine' when p_partkey % 2 = 0 then 'no_claim_linked' else 'gate_refused_a_fabrication' end as hold, count(*) as n, count(*) filter (where l_linenumber = 3 and p_partkey % 2 = 1) as rebased from i where condition = 'FAITHFUL' group by all""")
def hold_classes(spark, sf_dir):
    """Why faithful trials were held: nothing linked, an invented basis, or wording of the source; and how many only change the unit."""
    rows = items(spark, sf_dir).where("l_linenumber % 3 = 0")
    size = F.col("p_size").cast("string")
    value = F.when(F.col("l_linenumber") == 6, F.concat(size, F.lit(" mg of brands"))).when(F.col("p_partkey") % 2 == 1, F.concat(size, F.lit(" mg per customer")))
    rows = rows.select("domain", "condition", F.lit("HELD").alias("status"), value.alias("value"), F.concat(F.lit("The size is "), size, F.lit(" mg of the brand")).alias("source"), F.lit("part").alias("entity"), F.lit("size").alias("relation"), F.concat(size, F.lit(" mg")).alias("declared"), "l_linenumber")
    rows = trials.hold_class(rows).withColumn("rebased", (F.col("l_linenumber") == 3) & trials.rebased(F.col("declared"), F.col("value")))
    return rows.groupBy("domain", "hold").agg(F.count(F.lit(1)).alias("n"), F.count_if("rebased").alias("rebased"))


_R = "r as (select l_returnflag as domain, l_linenumber % 2 = 0 as asserted, l_linenumber % 3 = 0 as wrong, l_orderkey % 2 = 0 as adjudicated, l_orderkey % 5 = 1 as unresolved, l_orderkey % 4 = 0 as verified from lineitem)"


def _routed(spark, sf_dir) -> DataFrame:
    item, order = F.col("l_linenumber"), F.col("l_orderkey")
    return t(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("domain"), (item % 2 == 0).alias("asserted"), (item % 3 == 0).alias("wrong"), (order % 2 == 0).alias("adjudicated"), (order % 5 == 1).alias("unresolved"), (order % 4 == 0).alias("verified"),
        F.when(order % 4 == 0, F.lit("VERIFIED")).when(order % 2 == 0, F.when(item % 2 == 0, F.lit("BLOCK")).otherwise(F.lit("HELD"))).alias("status"),
    )


@query(f"""with {_R}, a as (select *, asserted or wrong as said, adjudicated or unresolved as reached from r),
g as (select domain, count(*) filter (where said) as asserted, count(*) filter (where not said) as declined, count(*) filter (where said and reached) as adjudicated, count(*) filter (where said and unresolved and not adjudicated) as held_unresolved, count(*) filter (where said and not reached) as bypassed,
  count(*) filter (where said and not reached and wrong) as unguarded_wrong, count(*) filter (where said and adjudicated and wrong and verified) as verified_wrong from a group by 1)
select domain, asserted, declined, adjudicated, held_unresolved, bypassed, unguarded_wrong, verified_wrong, {WILSON.replace("as lo,", "as adjudicated_lo,").replace("as hi", "as adjudicated_hi")} from (select *, adjudicated as k, asserted as n from g)""")
def routing_coverage(spark, sf_dir):
    names = ("asserted", "declined", "adjudicated", "held_unresolved", "bypassed", "unguarded_wrong", "verified_wrong", "adjudicated_lo", "adjudicated_hi")
    return trials.routing_totals(_routed(spark, sf_dir), ["domain"]).select("domain", *names)


@query("""with r as (select l_returnflag as domain, l_linenumber % 3 = 0 as wrong, coalesce(case when l_orderkey % 4 = 0 then 'VERIFIED' when l_orderkey % 2 = 0 and l_linenumber % 2 = 0 then 'BLOCK' when l_orderkey % 2 = 0 then 'HELD' end, case when l_orderkey % 5 = 1 then 'HELD' end, 'no-answer') as s from lineitem)
select domain, count(*) filter (where s = 'VERIFIED') as verified, count(*) filter (where s = 'BLOCK') as blocked, count(*) filter (where s = 'HELD') as held, count(*) filter (where s = 'no-answer') as no_answer, count(*) filter (where s = 'VERIFIED' and wrong) as breaches,
  round(count(*) filter (where s = 'VERIFIED') / count(*) filter (where s <> 'no-answer'), 9) as load_reduction from r group by 1""")
def pilot_counts(spark, sf_dir):
    return trials.pilot_totals(_routed(spark, sf_dir), ["domain"]).withColumn("load_reduction", F.round("load_reduction", 9))


@query("""select d.p_partkey as d, c.p_partkey as c, case when d.p_partkey % 2 = 0 and c.p_partkey % 2 = 0 then d.p_size = c.p_size when d.p_partkey % 2 = 1 and c.p_partkey % 2 = 0 then c.p_size between d.p_size and d.p_size + 5 when d.p_partkey % 2 = 1 then d.p_size = c.p_size else false end as equal
from part d join part c on c.p_partkey = d.p_partkey * 3 % (select count(*) from part)""")
def reparsed_equality(spark, sf_dir):
    """Equality without the comparator: points, ranges, and a point in a range."""
    part = t(spark, sf_dir, "part")
    size, n = F.col("p_size").cast("string"), part.count()
    v = F.when(F.col("p_partkey") % 2 == 0, F.concat(size, F.lit(" kg"))).otherwise(F.concat(size, F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit(" kg")))
    d = part.select(F.col("p_partkey").alias("d"), (F.col("p_partkey") * 3 % F.lit(n)).alias("c"), v.alias("a"))
    both = d.join(part.select(F.col("p_partkey").alias("c"), v.alias("b")), "c")
    return both.select("d", "c", trials.equal_by_reparse(F.col("a"), F.col("b")).alias("equal"))


@query("select rule, count(*) as n from (select unnest(case l_linenumber when 1 then ['S1'] when 2 then ['S3'] when 3 then ['S4'] when 4 then ['S5', 'S6'] when 5 then ['S2'] else [] end) as rule from lineitem join part on l_partkey = p_partkey) group by 1")
def soak_violations(spark, sf_dir):
    """Verdicts of the gate, which break no rule, after some were tampered with: each is found by the rule it breaks.

    Equal claims are judged and checked once, with their number.
    """
    from attestor.plans.catalogue import price_claims, price_facts

    facts = price_facts(spark, sf_dir)
    claims = price_claims(spark, sf_dir).withColumn("claimed_value", F.concat(F.lit("$"), F.col("l_linenumber").cast("string"), F.lit("00000.00")))
    claims = claims.groupBy("l_linenumber", "entity_mention", "relation", "claimed_value").agg(F.count(F.lit(1)).alias("n")).withColumn("context", no_context())
    got = gate.gate(claims, facts.select(F.col("entity").alias("surface"), "entity"), factset.slots(facts), "prices")
    k = F.col("l_linenumber")
    rows = got.select(
        "n", "l_linenumber", F.when(k == 4, F.lit("MAYBE")).when(k.isin(1, 5), F.lit("VERIFIED")).otherwise(F.col("status")).alias("status"), F.col("claimed_value"),
        F.when(k.isin(2, 5), F.col("claimed_value")).otherwise(F.col("declared")).alias("declared"), "source", F.when(k != 4, F.col("factset_fingerprint")).alias("factset_fingerprint"),
        F.when(k == 5, F.lit("no number here")).alias("passage"), (k != 3).alias("known"),
    )
    return trials.violations(rows).groupBy("rule").agg(F.sum("n").alias("n"))
