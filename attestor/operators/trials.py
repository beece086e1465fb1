"""Trials of the gate: corrupted values, which trials are valid, and what a run of trials amounts to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import stats
from attestor.functions.grammar import parse_leading, parse_quantity, parse_range, parsed
from attestor.functions.text import content_words, false_if_null, let, settled, shortest, squeeze, strip
from attestor.operators.compare import DIFFER, outcome
from attestor.operators.evaluation import trial_status
from attestor.operators.extract import extract, is_grounded
from attestor.operators.factset import FactSet
from attestor.operators.gate import gate, once

NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
ANY_NUMBER = r"[-+]?" + NUMBER
#: Factors of the first four corruptions, and those tried where a corruption isn't provably wrong.
FACTORS, OTHER_FACTORS = (2.0, 0.5, 3.0, 10.0), (100.0, 0.01, 1000.0)
#: Words of a value's grammar rather than of a document.
GRAMMAR = ("a", "an", "the", "of", "is", "are", "to", "and", "or", "per", "at", "in", "for", "between", "from", "approximately", "about", "around", "up", "million", "billion", "thousand")
FAITHFUL, CORRUPTED, SPONTANEOUS = "FAITHFUL", "CORRUPTED", "SPONTANEOUS"


def numbers_of(text: Column) -> Column:
    """All number tokens as they are written, without commas."""
    return F.transform(F.regexp_extract_all(text, F.lit(ANY_NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))


def differs(df: DataFrame, declared: str, claimed: str, out: str, numeric: bool = False) -> DataFrame:
    """df with the boolean column out: whether the claimed value provably differs from the declared one."""
    keep = df.columns
    df = parsed(parsed(df, declared, "__d", F.lit(numeric)), claimed, "__c", F.lit(numeric))
    return settled(df, keep, **{out: outcome(F.col("__d"), F.col("__c"), F.lit(numeric)) == DIFFER})


def scaled_value(value: Column, factor: Column) -> Column:
    """The value with each of its numbers times the factor, written as short as it can be, in the same notation."""
    numbers = F.regexp_extract_all(value, F.lit(NUMBER), F.lit(0))
    gaps = F.split(value, NUMBER)
    made = F.transform(numbers, lambda x: shortest(F.replace(x, F.lit(","), F.lit("")).cast("double") * factor))
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(made, i), F.lit("")))), "")


def corrupted(df: DataFrame, value: str, k: str, out: str) -> DataFrame:
    """df with the column out: a clearly wrong value in the notation of value, by the k-th factor; "unspecified" for a value
    without numbers, and the value itself where no factor makes one that provably differs. A value is corrupted once for all
    rows that have it with one factor."""
    which = (F.pmod(F.col(k), F.lit(len(FACTORS))) + 1).cast("int")
    return once(df, {"__value": F.col(value), "__which": which}, lambda asked: _corrupted(asked, "__value", F.col("__which"), out)).select(*df.columns, out)


def _corrupted(df: DataFrame, value: str, which: Column, out: str) -> DataFrame:
    factor = F.element_at(F.array(*map(F.lit, FACTORS)), which)
    tries = [factor, *map(F.lit, OTHER_FACTORS)]
    keep = df.columns
    for i, f in enumerate(tries):
        df = differs(df.withColumn(f"__w{i}", scaled_value(F.col(value), f)), value, f"__w{i}", f"__ok{i}")
    found = F.coalesce(*(F.when(F.col(f"__ok{i}"), F.col(f"__w{i}")) for i in range(len(tries))), F.col(value))
    return df.select(*keep, F.when(F.col(value).rlike("[0-9]"), found).otherwise(F.lit("unspecified")).alias(out))


def question_for(entity: Column, relation: Column, template: Column) -> Column:
    """The relation's question with a capital, or the general one."""
    own = F.replace(F.nullif(template, F.lit("")), F.lit("{entity}"), entity)
    return F.coalesce(F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, F.lit(2), F.length(own))), F.concat(F.lit("What is the "), F.replace(relation, F.lit("_"), F.lit(" ")), F.lit(" for "), entity, F.lit("?")))


def corrupted_trial(text: Column, wrong: Column, declared: Column) -> Column:
    """Why a rewritten text is no valid trial (never_stated, left_intact), or valid: it states the wrong value and not the declared one."""
    return F.when(~is_grounded(wrong, text), F.lit("never_stated")).when(is_grounded(declared, text), F.lit("left_intact")).otherwise(F.lit("valid"))


def states_other_value(df: DataFrame, answer: str, declared: str, others: str, out: str, unitless_must_be_bare: bool = True) -> DataFrame:
    """df with the boolean column out: whether the answer states a value for the slot that provably isn't the declared one.

    Never where a declared number stands in the answer. A number counts if no other slot has it (others: their numbers as
    written, without commas), and if the declared unit's first three characters follow it; with a declared value without a
    unit, and unitless_must_be_bare, if no letter, % or / follows.
    """
    keep = df.columns
    unit = strip(F.regexp_replace(F.col(declared), r"^[-+]?[0-9][0-9,.]*\s*", ""))
    pieces = F.transform(F.regexp_extract_all(F.col(answer), F.lit(rf"({ANY_NUMBER})(?=((?s:.{{0,24}})))"), F.lit(1)), lambda x: x)
    after = F.regexp_extract_all(F.col(answer), F.lit(rf"({ANY_NUMBER})(?=((?s:.{{0,24}})))"), F.lit(2))
    found = F.arrays_zip(pieces.alias("n"), after.alias("after"))
    bare = lambda n: F.replace(n, F.lit(","), F.lit(""))

    def counts(x: Column) -> Column:
        tail = F.lower(strip(x["after"]))
        fits = F.when(F.col("__unit") != "", F.startswith(tail, F.lower(F.substring("__unit", 1, 3))))
        return ~F.array_contains(F.col(others), bare(x["n"])) & (fits.otherwise(~tail.rlike("^[a-z%/]")) if unitless_must_be_bare else fits.otherwise(True))

    rows = df.withColumn("__unit", unit)
    told = F.arrays_overlap(numbers_of(F.col(answer)), numbers_of(F.col(declared)))
    rows = rows.withColumn("__candidates", F.when(~false_if_null(told), F.array_distinct(F.transform(F.filter(found, counts), lambda x: strip(F.concat_ws(" ", x["n"], F.col("__unit")))))))
    # Each candidate is compared inside its row; the declared value is parsed once.
    rows = parsed(rows, declared, "__d", F.lit(False))
    wrong = F.exists("__candidates", lambda c: _differs_inline(F.col("__d"), c))
    return settled(rows, keep, **{out: false_if_null(wrong)})


def _differs_inline(d: Column, candidate: Column) -> Column:
    """Whether a number with the declared unit differs from the declared quantity or range."""
    def against(q: Column) -> Column:
        point = (q["unit"] == d["q"]["unit"]) & (q["value"] != d["q"]["value"])
        outside = (q["unit"] == d["r"]["unit"]) & ~q["value"].between(d["r"]["low"], d["r"]["high"])
        return false_if_null(F.when(d["r"].isNotNull(), outside).otherwise(point))

    return let(against, q=F.coalesce(parse_quantity(candidate), parse_leading(candidate)))


def summary(trials: DataFrame, by: list[str]) -> DataFrame:
    """One row a group of trials (condition, status, entity, relation): n and rates of leaks (a wrong value VERIFIED) and
    over-blocks (a faithful one not VERIFIED) with Wilson bounds by trial and by fact, split into instructed and spontaneous,
    the distinct facts, and counts by status. A fact fails if any of its trials does; trials of one fact are correlated."""
    wrong, faithful = F.col("condition").isin(CORRUPTED, SPONTANEOUS), F.col("condition") == FAITHFUL
    verified = F.col("status") == "VERIFIED"
    flags = trials.withColumn("__leak", wrong & verified).withColumn("__over", faithful & ~verified).withColumn("__wrong", wrong).withColumn("__faithful", faithful)
    # Two levels: per fact first, which partial aggregation makes small before the shuffle.
    per_fact = flags.groupBy(*by, "entity", "relation").agg(
        *(F.count_if(F.col(c)).alias(c) for c in ("__leak", "__over", "__wrong", "__faithful")),
        F.count_if((F.col("condition") == SPONTANEOUS) & verified).alias("__sl"), F.count_if(F.col("condition") == SPONTANEOUS).alias("__s"),
        *(F.count_if(faithful & (F.col("status") == s)).alias(f"faithful_{s.lower()}") for s in ("VERIFIED", "BLOCK", "HELD")),
        *(F.count_if(wrong & (F.col("status") == s)).alias(f"wrong_{s.lower()}") for s in ("VERIFIED", "BLOCK", "HELD")),
    )
    total = lambda c, name: F.sum(c).alias(name)
    out = per_fact.groupBy(*by).agg(
        total("__leak", "leaks"), total("__wrong", "n_corrupted"), total("__over", "over_blocked"), total("__faithful", "n_faithful"), total("__s", "n_spontaneous"), total("__sl", "__sl"),
        F.count_if(F.col("__leak") > 0).alias("leak_facts"), F.count_if(F.col("__wrong") > 0).alias("__wf"), F.count_if(F.col("__over") > 0).alias("over_facts"), F.count_if(F.col("__faithful") > 0).alias("__ff"),
        F.count(F.lit(1)).alias("n_distinct_facts"), *(F.sum(f"{c}_{s}").alias(f"{c}_{s}") for c in ("faithful", "wrong") for s in ("verified", "block", "held")),
    )
    instructed, leaked = F.col("n_corrupted") - F.col("n_spontaneous"), F.col("leaks") - F.col("__sl")
    bounds = {}
    for name, k, n in (("leak", "leaks", "n_corrupted"), ("over_block", "over_blocked", "n_faithful"), ("leak_by_fact", "leak_facts", "__wf"), ("over_block_by_fact", "over_facts", "__ff")):
        bounds[f"{name}_lo"], bounds[f"{name}_hi"] = stats.wilson(F.col(k), F.col(n))
    out = out.withColumns(bounds).withColumns({
        "leak_rate": F.try_divide(F.col("leaks"), F.col("n_corrupted")), "over_block_rate": F.try_divide(F.col("over_blocked"), F.col("n_faithful")),
        "leak_rate_instructed": leaked / F.greatest(F.lit(1), instructed), "leak_rate_spontaneous": F.try_divide(F.col("__sl"), F.col("n_spontaneous")),
    })
    return out.drop("__sl", "__wf", "__ff")


def hold_class(rows: DataFrame) -> DataFrame:
    """rows (condition, status, value, source, entity, relation) with hold: null unless a faithful trial wasn't VERIFIED; then
    no_claim_linked without a value or a declared source, gate_refused_a_fabrication if the value has a content word that its
    source, relation and entity lack, else genuine."""
    words = lambda c: content_words(c, GRAMMAR)
    known = F.concat(words(F.col("source")), words(F.replace(F.col("relation"), F.lit("_"), F.lit(" "))), words(F.col("entity")))
    invented = F.size(F.array_except(words(F.col("value")), known)) > 0
    kind = F.when(F.col("value").isNull() | F.col("source").isNull(), F.lit("no_claim_linked")).when(invented, F.lit("gate_refused_a_fabrication")).otherwise(F.lit("genuine"))
    return settled(rows, rows.columns, hold=F.when((F.col("condition") == FAITHFUL) & (F.col("status") != "VERIFIED"), kind))


def rebased(declared: Column, value: Column) -> Column:
    """Whether a value has the declared number in another unit."""
    return false_if_null(let(lambda d, v: (d["value"] == v["value"]) & (d["unit"] != v["unit"]), d=parse_quantity(declared), v=F.coalesce(parse_quantity(value), parse_leading(value))))


def routing_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts over answers (asserted, wrong, adjudicated, unresolved, verified): of those that assert something (the declared value
    or a wrong one), how many reached the gate, how many were only held as unresolved, how many bypassed it, and of the wrong
    ones how many went unguarded or were verified; with Wilson bounds of the adjudicated and of the unguarded."""
    said = F.col("asserted") | F.col("wrong")
    reached = said & (F.col("adjudicated") | F.col("unresolved"))
    out = rows.groupBy(*by).agg(
        F.count_if(said).alias("asserted"), F.count_if(~said).alias("declined"), F.count_if(reached).alias("adjudicated"), F.count_if(said & F.col("unresolved") & ~F.col("adjudicated")).alias("held_unresolved"),
        F.count_if(said & ~reached).alias("bypassed"), F.count_if(said & ~reached & F.col("wrong")).alias("unguarded_wrong"), F.count_if(said & F.col("adjudicated") & F.col("wrong") & F.col("verified")).alias("verified_wrong"),
    )
    bounds = {}
    for name in ("adjudicated", "bypassed", "unguarded_wrong"):
        bounds[f"{name}_lo"], bounds[f"{name}_hi"] = stats.wilson(F.col(name), F.col("asserted"))
    return out.withColumns(bounds)


def pilot_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts over answers (status or null, unresolved, wrong): VERIFIED, BLOCK, HELD (unresolved ones too) and none; the share of
    answers that needed no review, and breaches: VERIFIED although the answer states a wrong value. Breaches must be 0."""
    status = F.coalesce("status", F.when(F.col("unresolved"), F.lit("HELD")), F.lit("no-answer"))
    rows = rows.withColumn("__s", status)
    out = rows.groupBy(*by).agg(
        *(F.count_if(F.col("__s") == s).alias(name) for s, name in (("VERIFIED", "verified"), ("BLOCK", "blocked"), ("HELD", "held"), ("no-answer", "no_answer"))),
        F.count_if((F.col("__s") == "VERIFIED") & F.col("wrong")).alias("breaches"),
    )
    return out.withColumn("load_reduction", F.try_divide(F.col("verified"), F.col("verified") + F.col("blocked") + F.col("held")))


def equal_by_reparse(a: Column, b: Column) -> Column:
    """Equality without the comparator: equal quantities, equal ranges, a point in the first one's range, or equal texts."""
    def same(qa: Column, qb: Column, ra: Column, rb: Column) -> Column:
        inside = (ra["unit"] == qb["unit"]) & qb["value"].between(ra["low"], ra["high"])
        unparsed = qa.isNull() & qb.isNull() & ra.isNull() & rb.isNull()
        return F.when(qa.isNotNull() & qb.isNotNull(), qa == qb).when(ra.isNotNull() & rb.isNotNull(), ra == rb).when(ra.isNotNull() & qb.isNotNull(), inside).otherwise(unparsed & (squeeze(F.lower(a)) == squeeze(F.lower(b))))

    return false_if_null(let(same, qa=parse_quantity(a), qb=parse_quantity(b), ra=parse_range(a), rb=parse_range(b)))


def violations(verdicts: DataFrame, normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """verdicts (status, entity, claimed_value, declared, source, factset_fingerprint, passage or null, known) with rule, only rows
    that break one: S1 VERIFIED but neither equal nor quoted, S2 VERIFIED but not in the passage, S3 BLOCK on equal values, S4
    an entity that isn't known (known is false) and not HELD, S5 an unheard-of status, S6 no fingerprint."""
    claimed, declared = F.col("claimed_value"), F.col("declared")
    equal = equal_by_reparse(normalise(declared), normalise(claimed))
    low = squeeze(F.lower(F.col("source")))
    quoted = (low != "") & (F.contains(low, squeeze(F.lower(claimed))) | F.contains(low, squeeze(F.lower(normalise(claimed)))))
    verified, blocked = F.col("status") == "VERIFIED", F.col("status") == "BLOCK"
    rules = {
        "S1": verified & ~equal & ~false_if_null(quoted), "S2": verified & F.col("passage").isNotNull() & ~is_grounded(claimed, F.col("passage")), "S3": blocked & declared.isNotNull() & equal,
        "S4": ~F.col("known") & (F.col("status") != "HELD"), "S5": ~F.col("status").isin("VERIFIED", "BLOCK", "HELD") | F.col("status").isNull(),
        "S6": F.coalesce(F.col("factset_fingerprint"), F.lit("")) == "",
    }
    broken = F.array_compact(F.array(*(F.when(false_if_null(c), F.lit(name)) for name, c in rules.items())))
    return verdicts.withColumn("rule", F.explode(broken))


def run(fs: FactSet, texts: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """texts (trial, condition, entity, relation, text) with value, declared, source and status of each trial of a fact set.

    Passages go through extraction and the gate; only claims about the trial's own entity and relation count. The status is
    BLOCK if any of them is blocked, else VERIFIED if any is verified, else HELD, also where nothing was claimed. answers
    (trial, entity, relation, answer) are what a model said; without them the rule extractor reads the passages.
    """
    spark = texts.sparkSession
    slots, aliases, facts = fs.slot_table(spark), fs.alias_table(spark), fs.fact_table(spark)
    passages = texts.select(F.col("trial").alias("passage_id"), "text")
    said = None if answers is None else answers.withColumnRenamed("trial", "passage_id")
    found = extract(passages, aliases, slots, facts, answers=said, normalise=fs.normalise, aliases=fs.unit_aliases)
    claims = found.where("state = 'claim'").select("passage_id", F.col("entity").alias("entity_mention"), "relation", F.col("value").alias("claimed_value"), F.lit(None).cast("map<string,string>").alias("context"))
    judged = gate(claims, aliases, slots, fs.fingerprint(), fs.normalise)
    own = texts.select(F.col("trial").alias("passage_id"), F.col("entity").alias("__e"), F.col("relation").alias("__r"))
    mine = judged.join(own, "passage_id").where((F.col("entity") == F.col("__e")) & (F.col("relation") == F.col("__r")))
    folded = mine.groupBy("passage_id").agg(trial_status(F.col("status")).alias("status"), F.min("claimed_value").alias("value"))
    declared = facts.groupBy("entity", "relation").agg(F.min_by("o", "pos").alias("declared"), F.min_by("source", "pos").alias("source"))
    rows = texts.join(folded.withColumnRenamed("passage_id", "trial"), "trial", "left").join(F.broadcast(declared), ["entity", "relation"], "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("HELD")))
