"""What models say: triples and queries in their output, tool rounds against the knowledge base, and the re-check of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.stats import with_wilson
from attestor.functions.text import cites, citations, is_abstention, is_correction
from attestor.operators.triples import VERIFIED, ranked, verify
from attestor.session import materialised

TRIPLES = "array<struct<s: string, r: string, o: string>>"
QUERY = "struct<s: string, r: string, o: string, unknown: string, top_k: int>"
STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}
#: Splits, and whether they are measured or put off.
STATUS = {"knowable_heldout": "active", "unknowable": "active", "adversarial_nearmiss": "active", "multi_hop": "deferred"}
SPLITS = tuple(name for name, status in STATUS.items() if status == "active")
ROUNDS, TOP_K = 6, 5
#: Fixed value: a triple in text that isn't valid JSON.
LOOSE = r'(?s)"s"\s*:\s*"([^"]*)"\s*,\s*"r"\s*:\s*"([^"]*)"\s*,\s*"o"\s*:\s*"([^"]*)"'


def parse_triples(raw: Column) -> Column:
    """triples and strict of a model's output: from its outermost brackets if they are a JSON array (strict; what isn't an object
    with s, r and o is left out), else from whatever has the look of a triple."""
    inside = F.nullif(F.regexp_extract(raw, r"(?s)\[.*\]", 0), F.lit(""))
    strict = F.coalesce(F.schema_of_variant(F.try_parse_json(inside)).startswith("ARRAY"), F.lit(False))
    each = F.transform(F.from_json(inside, "array<string>", STRICT), lambda x: F.from_json(x, "s string, r string, o string"))
    whole = F.filter(each, lambda x: x["s"].isNotNull() & x["r"].isNotNull() & x["o"].isNotNull())
    part = lambda i: F.regexp_extract_all(raw, F.lit(LOOSE), F.lit(i))
    loose = F.arrays_zip(part(1).alias("s"), part(2).alias("r"), part(3).alias("o"))
    found = F.when(strict, whole.cast(TRIPLES)).otherwise(F.coalesce(loose.cast(TRIPLES), F.expr(f"cast(array() as {TRIPLES})")))
    return F.struct(found.alias("triples"), strict.alias("strict"))


def kb_queries(response: Column) -> Column:
    """The queries (an object or an array of them) in the first <kb_q> block of a response; null without a block, or if it isn't JSON."""
    block = F.btrim(F.regexp_extract(response, r"(?s)<kb_q>(.*?)</kb_q>", 1))
    many = F.transform(F.from_json(block, "array<string>", STRICT), lambda x: F.from_json(x, QUERY))
    one = F.array(F.from_json(block, QUERY, STRICT))
    sound = F.try_parse_json(F.nullif(block, F.lit(""))).isNotNull()
    return F.when(sound & F.startswith(block, F.lit("[")), F.filter(many, lambda x: x.isNotNull())).when(sound & F.startswith(block, F.lit("{")), one)


def execute(queries: DataFrame, kb: DataFrame, k: int = TOP_K) -> DataFrame:
    """queries (with a column q of QUERY) with unknown, symbols and n: the first k symbols of the unknown role, given the others.

    A null part that isn't the unknown one is not known, and then nothing is found. Each unknown role is an equi-join of its
    own with the symbols of the knowledge base, ranked before they meet the queries.
    """
    rows = queries.withColumn("unknown", F.upper(F.coalesce("q.unknown", F.lit("O"))))
    out = None
    for role, known in (("o", ("s", "r")), ("s", ("r", "o")), ("r", ("s", "o"))):
        own = rows.where(F.col("unknown") == role.upper())
        facts = ranked(kb, known, role, k).select(F.col(known[0]).alias("__a"), F.col(known[1]).alias("__b"), "symbols", "n")
        met = own.join(facts, (F.col(f"q.{known[0]}") == F.col("__a")) & (F.col(f"q.{known[1]}") == F.col("__b")), "left").drop("__a", "__b")
        out = met if out is None else out.unionByName(met)
    asked = F.when(F.col("q.top_k") > 0, F.slice("symbols", 1, F.col("q.top_k"))).otherwise(F.col("symbols"))
    return out.withColumn("symbols", F.coalesce(asked, F.expr("cast(array() as array<string>)"))).withColumn("n", F.coalesce("n", F.lit(0)))


def rebuilt(q: Column, unknown: Column, top: Column) -> Column:
    """The triple of a query's known roles and its first candidate, or null if a part is missing."""
    part = lambda role: F.when(unknown == role.upper(), top).otherwise(q[role])
    s, r, o = part("s"), part("r"), part("o")
    return F.when(s.isNotNull() & r.isNotNull() & o.isNotNull(), F.struct(s.alias("s"), r.alias("r"), o.alias("o")))


def echoed(examples: DataFrame) -> DataFrame:
    """examples with final_answer and no rounds: the target that repeats the question, for tests of the harness."""
    return examples.withColumn("final_answer", F.col("question")).withColumn("rounds", F.lit(0)).withColumn("executed", F.expr(f"cast(array() as {TRIPLES})"))


def tool_loop(examples: DataFrame, kb: DataFrame, model: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """examples (id, question) with final_answer, rounds and executed (the triples that the queries led to).

    model takes rows with id, question and transcript and adds reply; it is any DataFrame function, such as a join with
    recorded replies. Rows whose reply has a valid query block go on with the result in their transcript, at most so many
    rounds; all rounds of all examples are joins, none a loop over rows.
    """
    none = F.expr(f"cast(array() as {TRIPLES})")
    live = examples.withColumn("transcript", F.col("question")).withColumn("rounds", F.lit(0)).withColumn("executed", none)
    done = None
    for i in range(rounds):
        # A round is written down: no reply is asked for twice, and plans don't grow with the rounds.
        said = materialised(model(live).withColumn("rounds", F.lit(i + 1)).withColumn("__queries", kb_queries(F.col("reply"))), "round")
        ends = said.where(F.col("__queries").isNull() | (F.size("__queries") == 0) | F.lit(i + 1 == rounds))
        asked = said.where(F.size("__queries") > 0).select("id", F.posexplode("__queries").alias("place", "q"))
        found = execute(asked, kb).withColumn("triple", rebuilt(F.col("q"), F.col("unknown"), F.get("symbols", F.lit(0))))
        per = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "symbols", "triple"))).alias("__found"))
        own = materialised(said.join(per, "id", "left").withColumn("executed", F.concat("executed", F.coalesce(F.filter(F.transform("__found", lambda x: x["triple"]), lambda t: t.isNotNull()), none))), "round")
        last = own.join(ends.select("id"), "id", "left_semi")
        finished = last.select(*examples.columns, F.col("reply").alias("final_answer"), "rounds", "executed")
        done = finished if done is None else done.unionByName(finished)
        result = F.concat(F.lit("<kb_r>"), F.to_json(F.transform("__found", lambda x: F.struct(x["symbols"].alias("results")))), F.lit("</kb_r>"))
        live = own.join(ends.select("id"), "id", "left_anti").select(*examples.columns, F.concat_ws("\n", "transcript", "reply", result).alias("transcript"), "rounds", "executed")
    return done


def claims_of(answered: DataFrame) -> DataFrame:
    """id, s, r, o: the distinct citations and executed triples of each answer."""
    told = answered.select("id", F.explode(citations(F.col("final_answer"))).alias("t")).union(answered.select("id", F.explode("executed")))
    return told.select("id", "t.s", "t.r", "t.o").distinct()


def rechecked(answered: DataFrame, kb: DataFrame) -> DataFrame:
    """answered (id, final_answer, executed) with claims_checked, blocked (not VERIFIED) and verdict_counts by status."""
    verdicts = verify(claims_of(answered), kb).groupBy("id", "status").agg(F.count(F.lit(1)).alias("n"))
    per = verdicts.groupBy("id").agg(
        F.sum("n").alias("claims_checked"), F.sum(F.when(F.col("status") != VERIFIED, F.col("n")).otherwise(0)).alias("blocked"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("verdict_counts")
    )
    zero = F.lit(0).cast("long")
    return answered.join(per, "id", "left").withColumns({
        "claims_checked": F.coalesce("claims_checked", zero), "blocked": F.coalesce("blocked", zero), "verdict_counts": F.coalesce("verdict_counts", F.expr("cast(map() as map<string, bigint>)")),
    })


def scored(rows: DataFrame, response: str = "final_answer") -> DataFrame:
    """rows (split, response, expected) with correct, and abstained and confident_wrong (null but in the unknowable split).

    Raises ValueError for an unknown split, at the time the plan runs.
    """
    answer, unknowable = F.col(response), F.col("split") == "unknowable"
    abstained = is_abstention(answer)
    unknown = F.raise_error(F.concat(F.lit("no scorer for split "), F.coalesce("split", F.lit("null")))).cast("boolean")
    correct = (
        F.when(unknowable, abstained).when(F.col("split") == "adversarial_nearmiss", is_correction(answer, F.col("expected")))
        .when(F.col("split") == "knowable_heldout", cites(answer, F.col("expected"))).otherwise(unknown)
    )
    return rows.withColumn("correct", F.coalesce(correct, F.lit(False))).withColumn("abstained", F.when(unknowable, abstained)).withColumn("confident_wrong", F.when(unknowable, ~abstained))


def split_summary(rows: DataFrame) -> DataFrame:
    """One row a split of scored and rechecked rows: n, correct, accuracy with bounds, rates of abstention and of confident wrong
    answers (null but for the unknowable split), claims checked, the share of them that was blocked (null without claims), and
    counts by verdict, summed over the maps."""
    k = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    per = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), k("correct").alias("correct"), k("abstained").alias("abstention_n"), k("confident_wrong").alias("confident_wrong_n"), F.sum("claims_checked").alias("claims_checked"),
        F.sum("blocked").alias("blocked"),
    )
    counts = rows.select("split", F.explode("verdict_counts").alias("status", "n")).groupBy("split", "status").agg(F.sum("n").alias("n"))
    maps = counts.groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("verdict_counts"))
    out = with_wilson(per.join(maps, "split", "left"), "correct", "n").withColumn("accuracy", F.col("correct") / F.col("n"))
    of_unknowable = lambda c: F.when(F.col("split") == "unknowable", F.col(c) / F.col("n"))
    return out.withColumns({
        "abstention_rate": of_unknowable("abstention_n"), "confident_wrong_rate": of_unknowable("confident_wrong_n"), "gated_hallucination_rate": F.try_divide(F.col("blocked"), F.col("claims_checked")),
    })


def safe_name(target: str) -> str:
    """A target as part of a file name."""
    return target.replace(":", "-").replace("/", "-")


def attributed(sentences: DataFrame, triples: DataFrame, on: str) -> DataFrame:
    """sentences (on, place, text) joined with the triples (on, s, r, o) of the same source whose subject stands in them, case
    aside. Triples are gathered per source by the equi-join on it, never across sources."""
    return sentences.join(triples, on).where(F.contains(F.lower("text"), F.lower("s")) & (F.col("s") != ""))
