"""Suggestions to the author of a fact set, from claims that were held or not linked."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.grammar import parsed
from attestor.functions.text import literals, squeeze, strip
from attestor.operators.compare import MATCH, outcome
from attestor.operators.extract import is_grounded, mentions
from attestor.operators.gate import once

#: Words whose qualifier would change what a value means; words that begin sentences.
RISKY = ("per", "day", "daily", "week", "month", "year", "annual", "hour", "dose", "user", "query")
OPENERS = ("the", "a", "an", "we", "it", "this", "that", "they", "our", "based", "according", "there", "these", "for", "in", "on", "at", "as")
CAPITALISED = r"(?U)\b([A-Z][\w&.-]*(?:\s+[A-Z][\w&.-]*){0,3})"
EDGES = " ,.;:"
MOST_CANDIDATES = 4


def residue(declared: Column, claimed: Column) -> Column:
    """head and tail: what stands on either side of the declared value's first number in the claim, without the declared unit;
    null where the claim hasn't the number, empty where nothing stands there."""
    number = F.regexp_extract(declared, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0)
    at = F.instr(claimed, number)
    unit = F.lower(strip(F.substring(declared, F.instr(declared, number) + F.length(number), F.length(declared))))
    after = F.regexp_replace(F.substring(claimed, at + F.length(number), F.length(claimed)), r"(?U)^\s+", "")
    tail = F.when((unit != "") & F.startswith(F.lower(after), unit), F.substring(after, F.length(unit) + 1, F.length(after))).otherwise(after)
    parts = F.struct(F.btrim(F.substring(claimed, F.lit(1), at - 1), F.lit(EDGES)).alias("head"), F.btrim(tail, F.lit(EDGES)).alias("tail"))
    return F.when((number != "") & (at > 0), parts)


def suggest_qualifiers(held: DataFrame, normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """residue, n, example, risky of held (pos, declared, claimed): the least wording whose removal makes a claim match: what
    follows the declared number, or precedes it, or both.

    Claims that match as they are suggest nothing. Values are compared as texts of no declared kind. Most frequent first, then
    by first occurrence; the example is the first claim in order. What a claim says of a declared
    value is found out once for all rows that have both.
    """
    known = once(held.select("pos", "declared", "claimed"), {"__declared": F.col("declared"), "__claimed": F.col("claimed")}, lambda asked: _least(asked, normalise)).where("parts is not null")
    first = known.groupBy("pos").agg(F.min_by(F.struct("parts", "claimed"), "way").alias("x"))
    told = first.select("pos", F.col("x.claimed").alias("claimed"), F.explode(F.filter("x.parts", lambda p: p != "")).alias("residue"))
    counted = told.groupBy("residue").agg(F.count(F.lit(1)).alias("n"), F.min_by("claimed", "pos").alias("example"), F.min("pos").alias("__first"))
    risky = F.col("residue").rlike(rf"(?iU)\b(?:{'|'.join(RISKY)})\b")
    return counted.withColumn("risky", risky).orderBy(F.desc("n"), "__first", "residue").drop("__first")


def _least(asked: DataFrame, normalise: Callable[[Column], Column]) -> DataFrame:
    """__declared, __claimed, way and parts of the first way that makes the claim match, of distinct pairs that don't match as they are."""
    declared, claimed, no = F.col("__declared"), F.col("__claimed"), F.lit(False)
    rows = asked.withColumn("__n", normalise(claimed)).withColumn("__r", residue(declared, claimed))
    head, tail = F.col("__r.head"), F.col("__r.tail")
    without = lambda c, part: F.when(part != "", F.replace(c, part, F.lit(""))).otherwise(c)
    ways = F.array(
        F.struct(F.lit(0).alias("way"), F.array(tail).alias("parts"), without(claimed, tail).alias("rest")), F.struct(F.lit(1).alias("way"), F.array(head).alias("parts"), without(claimed, head).alias("rest")),
        F.struct(F.lit(2).alias("way"), F.array(head, tail).alias("parts"), without(without(claimed, head), tail).alias("rest")),
    )
    rows = rows.withColumn("__ways", F.filter(ways, lambda w: F.exists(w["parts"], lambda p: p != "")))
    rows = parsed(parsed(rows, "__declared", "__d", no), "__n", "__c", no).where(F.coalesce(outcome(F.col("__d"), F.col("__c"), no) != MATCH, F.lit(True)))
    each = rows.where("__r is not null").select("__declared", "__claimed", "__d", F.explode("__ways").alias("__way"))
    each = parsed(each.withColumn("__rest", normalise(F.btrim(F.col("__way.rest"), F.lit(EDGES)))), "__rest", "__c", no).where(outcome(F.col("__d"), F.col("__c"), no) == MATCH)
    return each.groupBy("__declared", "__claimed").agg(F.min("__way.way").alias("way"), F.min_by("__way.parts", "__way.way").alias("parts"))


def stems(names: Column) -> Column:
    """The first four letters of each word of four letters or more of some names."""
    words = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(F.lower(n), F.lit("[a-z]{4,}"), F.lit(0))))
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 4)))


def candidates(text: Column, own: Column, taken: Column) -> Column:
    """The first four names that a text has for an entity, each once but for case: runs of capitalised words, then words with a
    stem of its names (own); neither its names, nor those of others (taken), nor a sentence's opener."""
    low = lambda c: F.lower(c)
    known = lambda w: F.array_contains(own, low(w)) | F.array_contains(taken, low(w))
    runs = F.transform(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(1)), lambda p: F.btrim(p, F.lit(".,;:")))
    runs = F.filter(runs, lambda p: (F.length(p) > 1) & ~known(p) & ~F.array_contains(literals(OPENERS), low(p)))
    words = F.filter(F.regexp_extract_all(text, F.lit("[a-zA-Z]{4,}"), F.lit(0)), lambda w: F.array_contains(stems(own), F.substring(low(w), 1, 4)) & ~known(w))
    both = F.concat(runs, words)
    lows = F.transform(both, low)
    return F.slice(F.filter(both, lambda x, i: F.array_position(lows, low(x)) == i + 1), 1, MOST_CANDIDATES)


def suggest_aliases(unlinked: DataFrame, surfaces: DataFrame | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """text_id, candidates of unlinked (text_id, text, and optionally entity, declared): names under which an entity may be meant.

    Where declared is given, only texts that state it count; with surfaces (surface, entity) only texts that mention no entity,
    the entity's own names are left out and give the stems, and names of other entities are left out too. An alias is only
    ever a suggestion.
    """
    rows = unlinked
    if "declared" in rows.columns:
        rows = rows.where(is_grounded(F.col("declared"), F.col("text"), aliases))
    none = literals(())
    if surfaces is None:
        found = candidates(F.col("text"), none, none)
        return rows.select("text_id", found.alias("candidates")).where("size(candidates) > 0")
    seen = mentions(rows.select(F.col("text_id").alias("passage_id"), "text"), surfaces).select(F.col("passage_id").alias("text_id"))
    names = surfaces.select(F.col("entity").alias("__entity"), F.explode(F.array(F.lower("entity"), F.lower("surface"))).alias("name")).distinct()
    own = names.groupBy("__entity").agg(F.collect_set("name").alias("__own"))
    rows = rows.join(seen, "text_id", "left_anti").join(own, F.col("entity") == F.col("__entity"), "left").withColumn("__own", F.coalesce("__own", F.array(F.lower("entity"))))
    # Other entities' names are looked up by the names that were found, never gathered.
    open_ = rows.select("text_id", "entity", candidates(F.col("text"), F.col("__own"), none).alias("found"), F.col("text"), "__own")
    runs = F.filter(F.regexp_extract_all("text", F.lit(CAPITALISED), F.lit(1)), lambda p: F.length(p) > 1)
    asked = open_.select("text_id", F.col("entity").alias("__of"), F.explode(F.array_distinct(F.transform(F.concat("found", runs), lambda x: F.lower(F.btrim(x, F.lit(".,;:")))))).alias("name"))
    taken = asked.join(names, "name").where(F.col("__entity") != F.col("__of")).groupBy("text_id", "__of").agg(F.collect_set("name").alias("__taken"))
    taken = taken.withColumnRenamed("text_id", "__id")
    rows = rows.join(taken, (F.col("text_id") == F.col("__id")) & (F.col("entity") == F.col("__of")), "left")
    return rows.select("text_id", candidates(F.col("text"), F.col("__own"), F.coalesce("__taken", none)).alias("candidates")).where("size(candidates) > 0")


def rendered(suggestions: DataFrame) -> str:
    """A report of all qualifier suggestions: those to declare, then those to review."""
    rows = list(suggestions.toLocalIterator())
    if not rows:
        return "no qualifier suggestions"
    line = lambda r: f"{r.n:>5}  {r.residue!r}, as in {r.example!r}"
    safe, risky = [line(r) for r in rows if not r.risky], [line(r) for r in rows if r.risky]
    return "\n".join([*(["to declare:", *safe] if safe else []), *(["to review, as they say when or of what a value holds:", *risky] if risky else [])])


def rendered_aliases(suggestions: DataFrame) -> str:
    """A report of all alias suggestions."""
    rows = [f"{r.text_id}: " + ", ".join(map(repr, r.candidates)) for r in suggestions.orderBy("text_id").toLocalIterator()]
    return "\n".join(["names that may be missing, each to be reviewed:", *rows]) if rows else "no alias suggestions"
