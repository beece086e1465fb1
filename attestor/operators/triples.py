"""Triples: the four-valued verdict, chains, lookups by known roles, top-k and the relational operators over a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import literal_map, squeeze
from attestor.operators.gate import small

VERIFIED, CONTRADICTED, UNRESOLVED, OUT_OF_KB = "VERIFIED", "CONTRADICTED", "UNRESOLVED", "OUT_OF_KB"
#: Relations with one object a subject, and spellings with one meaning.
FUNCTIONAL = ("capital", "isa", "color", "lives_in", "population", "locatedin")
SYNONYMS = {"hue": "color", "uk": "england", "america": "usa"}


def canonical(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Lower case, white space as underscores, synonyms under one name."""
    name = F.regexp_replace(squeeze(F.lower(c)), r"[\s_]+", "_")
    return F.coalesce(F.try_element_at(literal_map(SYNONYMS if synonyms is None else synonyms), name), name)


def states(kb: DataFrame) -> DataFrame:
    """s, r, n, answer: distinct objects of each (s, r) and the first in order; score is 1 / n."""
    return kb.groupBy("s", "r").agg(F.countDistinct("o").alias("n"), F.min("o").alias("answer"))


def verify(claims: DataFrame, kb: DataFrame, functional: tuple[str, ...] = FUNCTIONAL, denied: DataFrame | None = None, synonyms: dict[str, str] | None = None) -> DataFrame:
    """claims (s, r, o) with status, answer, score: OUT_OF_KB without a fact, UNRESOLVED with several, VERIFIED if the only
    one is the claim's, CONTRADICTED if the relation is functional or the claim is denied, else UNRESOLVED.

    Claims, facts and denials meet under their canonical names. The fact is also looked up from its object (s among the
    subjects of (r, o)); as both ways read one table of facts, that holds wherever the answer is the claim's. The joins are on
    canonical (s, r) and broadcast only where the knowledge base has been checked to be small. A null part is OUT_OF_KB.
    """
    name = lambda c: canonical(F.col(c), synonyms)
    facts = states(kb.select(name("s").alias("__s"), name("r").alias("__r"), name("o").alias("__o")).select(F.col("__s").alias("s"), F.col("__r").alias("r"), F.col("__o").alias("o")))
    facts = facts.select(F.col("s").alias("__s"), F.col("r").alias("__r"), F.col("n").alias("__n"), F.col("answer").alias("__answer"))
    rows = claims.withColumns({"__cs": name("s"), "__cr": name("r"), "__co": name("o")})
    rows = rows.join(small(facts), (F.col("__cs") == F.col("__s")) & (F.col("__cr") == F.col("__r")), "left")
    no = F.lit(False)
    if denied is not None:
        own = denied.select(name("s").alias("__ds"), name("r").alias("__dr"), name("o").alias("__do")).distinct()
        rows = rows.join(small(own), (F.col("__cs") == F.col("__ds")) & (F.col("__cr") == F.col("__dr")) & (F.col("__co") == F.col("__do")), "left")
        no = F.col("__ds").isNotNull()
    status = (
        F.when(F.col("__n").isNull() | F.col("__co").isNull(), F.lit(OUT_OF_KB))
        .when(F.col("__n") > 1, F.lit(UNRESOLVED))
        .when(F.col("__answer") == F.col("__co"), F.lit(VERIFIED))
        .when(F.col("__cr").isin(*functional) | no, F.lit(CONTRADICTED))
        .otherwise(F.lit(UNRESOLVED))
    )
    keep = [c for c in claims.columns if c not in ("status", "answer", "score")]
    return rows.select(*keep, status.alias("status"), F.when(F.col("__n") == 1, F.col("__answer")).alias("answer"), (1 / F.col("__n")).alias("score"))


def chain(starts: DataFrame, kb: DataFrame, path: list[str]) -> DataFrame:
    """starts (s, o) with status and reached: each relation of the path is one equi-join; a hop without a fact is OUT_OF_KB."""
    rows = starts.withColumn("at", F.col("s"))
    for r in path:
        hop = states(kb.where(F.col("r") == r)).where("n = 1").select(F.col("s").alias("at"), F.col("answer").alias("to"))
        rows = rows.join(hop, "at", "left").withColumn("at", F.col("to")).drop("to")
    status = F.when(F.col("at").isNull(), F.lit(OUT_OF_KB)).when(F.col("at") == F.col("o"), F.lit(VERIFIED)).otherwise(F.lit(CONTRADICTED))
    return rows.select(*starts.columns, status.alias("status"), F.col("at").alias("reached"))


#: Parts in which a group's rows are ranked first, so that no popular group is one task.
PARTS = 64


def _best(rows: DataFrame, by: list[str], order: list, k: int, spread: list[str]) -> DataFrame:
    """The first k rows of each group with their rank: k of each part of a group, then k of these."""
    part = F.pmod(F.xxhash64(*spread), F.lit(PARTS))
    rows = rows.withColumn("__part", part)
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("__part").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def lookup(queries: DataFrame, kb: DataFrame, known: list[str], k: int = 5) -> DataFrame:
    """queries with their k first answers for the unknown roles, by rank. Facts are ranked before they meet the queries."""
    unknown = [x for x in ("s", "r", "o") if x not in known]
    best = _best(kb.select("s", "r", "o").distinct(), known, unknown, k, unknown)
    return queries.join(best, known)


def top_k(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best (score descending, then o) of each (s, r) of scored (s, r, o, score)."""
    return _best(scored, ["s", "r"], [F.desc("score"), F.col("o")], k, ["o"])


def ranked(kb: DataFrame, known: tuple[str, str], unknown: str, k: int = 5) -> DataFrame:
    """known roles, symbols (the first k of the unknown role in order) and n (all of them)."""
    own = kb.where(" and ".join(f"{x} is not null" for x in (*known, unknown))).select(*known, unknown).distinct()
    sizes = own.groupBy(*known).agg(F.count(F.lit(1)).alias("n"))
    best = _best(own, list(known), [F.col(unknown)], k, [unknown]).groupBy(*known).agg(F.sort_array(F.collect_list(unknown)).alias("symbols"))
    return best.join(sizes, list(known))


def relation_histogram(kb: DataFrame) -> DataFrame:
    """r, n, most common first."""
    return kb.groupBy("r").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "r")


def shared_relations(a: DataFrame, b: DataFrame) -> DataFrame:
    """r: the relations of both knowledge bases."""
    return a.select("r").intersect(b.select("r"))


def entities(kb: DataFrame) -> DataFrame:
    return kb.select(F.col("s").alias("entity")).union(kb.select(F.col("o"))).distinct()


def manifest(kb: DataFrame) -> DataFrame:
    """facts, relations, entities: one row."""
    counts = kb.agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("r").alias("relations"))
    return counts.join(entities(kb).agg(F.count(F.lit(1)).alias("entities")))


def first_values(triples: DataFrame) -> DataFrame:
    """s, r, o: the first object in order (pos) of each (s, r)."""
    return triples.groupBy("s", "r").agg(F.min_by("o", "pos").alias("o"))


#: Most edges in one row of an adjacency list.
MOST_EDGES = 10_000


def adjacency(triples: DataFrame) -> DataFrame:
    """s, part, edges: relations and objects of each subject, sorted; a subject with more than MOST_EDGES of them has several
    rows, by hash of the edge, so that no row grows with a hub."""
    own = triples.select("s", "r", "o").distinct()
    parts = own.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / MOST_EDGES).alias("parts"))
    rows = own.join(parts, "s").withColumn("part", F.pmod(F.xxhash64("r", "o"), F.col("parts")))
    return rows.groupBy("s", "part").agg(F.sort_array(F.collect_list(F.struct("r", "o"))).alias("edges"))
