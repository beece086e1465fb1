"""From passages to claims: mentions of entities, slots to ask for, answers, and the guards on what they say."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.grammar import ABSENT, CURRENCY_UNITS, parse_leading, parse_quantity, parse_range
from attestor.functions.text import dehyphenated, digits_for_words, false_if_null, let, literals, no_space, settled, shortest, squeeze, strip, surface
from attestor.operators.gate import is_small, repeatable, small

#: Spellings of units, words that don't count in names, prose that isn't a value.
SPELLINGS = {
    "usd": ("$", "us$", "usd", "dollar", "dollars"), "gbp": ("£", "gbp", "pound", "pounds", "sterling"), "eur": ("€", "eur", "euro", "euros"), "jpy": ("¥", "jpy", "yen"),
    "percent": ("%", "percent", "pct", "percentage"), "%": ("%", "percent", "pct", "percentage"),
}
STOPWORDS = ("the", "a", "an", "of", "and", "or", "for", "to", "in", "on")
LEADS_WITH_NUMBER = r"^\s*(?:US\$|[$£€¥])?\s*[-+]?[0-9]"
PROSE = r"(?iU)\b(?:sorry|cannot|can't|does\s+not|doesn't|unable|i\s+)\b"
MOST_WORDS = 3
QUESTION = "According to the passage, what is the {relation} of {entity}?"


def _padded(c: Column) -> Column:
    """The words with one space around each."""
    return F.concat(F.lit(" "), F.regexp_replace(c, r"(?U)\W+", " "), F.lit(" "))


def needles(surfaces: DataFrame) -> DataFrame:
    """entity, phrases, loose, word: what a text must hold for a name to count as mentioned, and the word to look it up by.

    All phrases of a needle must stand in one reading: the name without a bracket at its end; all parties of a name that lists
    several; all words that count of a name with two or more (loose: only in the text as it is written). Of all words of a
    needle the one that the fewest needles hold is its key, so that a first word that many names share is never joined on.
    """
    name = strip(F.col("surface"))
    base = F.regexp_replace(name, r"\s*\([^)]*\)\s*$", "")
    parties = F.filter(F.transform(F.split(base, r"\s*[/,]\s*|\s+and\s+"), surface), lambda p: p != "")
    words = F.filter(F.split(surface(name), " "), lambda w: (w != "") & ~F.array_contains(literals(STOPWORDS), w))
    kind = lambda phrases, loose: F.struct(phrases.alias("phrases"), F.lit(loose).alias("loose"))
    ways = F.array(kind(F.array(surface(base)), False), F.when(F.size(parties) > 1, kind(parties, False)), F.when(F.size(words) > 1, kind(words, True)))
    rows = surfaces.select("entity", F.explode(ways).alias("way")).where("way is not null").select("entity", "way.*").distinct()
    tokens = F.array_distinct(F.regexp_extract_all(F.array_join("phrases", " "), F.lit(r"(?U)\w+"), F.lit(0)))
    rows = rows.withColumn("tokens", tokens).where("size(tokens) > 0")
    frequent = rows.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    keyed = rows.withColumn("word", F.explode("tokens")).join(frequent, "word")
    return keyed.groupBy("entity", "phrases", "loose").agg(F.min_by("word", F.struct("n", "word")).alias("word"))


def mentions(passages: DataFrame, surfaces: DataFrame) -> DataFrame:
    """passage_id, entity of passages (passage_id, text) and surfaces (surface, entity): names found on word boundaries.

    A needle meets only the passages that hold its rarest word, by an equi-join, and is then compared in full. The text with
    words joined that a line break split is a second reading. Null texts and names mention nothing. Where names are too many to
    be broadcast, equal texts are read once, and words are dealt out with a hash of their text alone.
    """
    told = passages.where("text is not null").select("passage_id", "text")
    known = needles(surfaces)
    if is_small(known, surfaces) or not repeatable(told):
        return _standing(_words(_readings(told)).join(small(known, surfaces), "word")).select("passage_id", "entity").distinct()
    # Texts that share a hash share their words' needles, which are then compared in full: no more than work is lost.
    texts = told.select("text").distinct().withColumn("hash", F.xxhash64("text"))
    met = _words(_readings(texts)).select("hash", "word").distinct().join(known, "word").select("hash", "entity", "phrases", "loose")
    found = _standing(_readings(met.join(texts, "hash"))).select("text", "entity").distinct()
    return told.join(found, "text").select("passage_id", "entity").distinct()


def _readings(rows: DataFrame) -> DataFrame:
    """Each text as it is written, and with words joined that a line break split, if that differs."""
    both = F.array_distinct(F.array(F.struct(surface(F.col("text")).alias("text"), F.lit(True).alias("written")), F.struct(surface(dehyphenated(F.col("text"))).alias("text"), F.lit(False).alias("written"))))
    return rows.select("*", F.explode(both).alias("reading")).withColumn("padded", _padded(F.col("reading.text")))


def _words(readings: DataFrame) -> DataFrame:
    return readings.withColumn("word", F.explode(F.array_distinct(F.filter(F.split("padded", " "), lambda w: w != ""))))


def _standing(met: DataFrame) -> DataFrame:
    """The readings that hold all phrases of the needle they met."""
    stands = F.forall("phrases", lambda p: F.contains(F.col("reading.text"), p) & F.contains(F.col("padded"), _padded(p)))
    return met.where(stands & (~F.col("loose") | F.col("reading.written")))


def in_one_sentence(name: Column, sentence: Column) -> Column:
    """Whether all words that count of a name, two at least, stand in a sentence."""
    words = F.filter(F.split(surface(name), " "), lambda w: (w != "") & ~F.array_contains(literals(STOPWORDS), w))
    return false_if_null((F.size(words) > 1) & F.forall(words, lambda w: F.contains(_padded(surface(sentence)), _padded(w))))


def asked_slots(found: DataFrame, slots: DataFrame) -> DataFrame:
    """passage_id, entity, relation, stated: the slots with a fact of every mentioned entity, and the first declared value."""
    return found.join(small(slots.select("entity", "relation", F.col("variants")[0]["o"].alias("stated"))), "entity").select("passage_id", "entity", "relation", "stated")


def slot_question(entity: Column, relation: Column, template: Column) -> Column:
    """The relation's question about the entity, or the general one."""
    general = F.replace(F.replace(F.lit(QUESTION), F.lit("{relation}"), F.replace(relation, F.lit("_"), F.lit(" "))), F.lit("{entity}"), F.replace(entity, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.replace(F.nullif(template, F.lit("")), F.lit("{entity}"), entity), general)


def first_quantity(text: Column, entity: Column, relation: Column) -> Column:
    """The rule extractor: the first amount of money in the passage, or else the first number with a unit."""
    money = F.regexp_extract(text, r"(?:US\$|[$£€¥])[0-9][0-9,]*(?:\.[0-9]+)?", 0)
    return F.coalesce(F.nullif(money, F.lit("")), F.nullif(F.regexp_extract(text, r"[0-9][0-9,]*(?:\.[0-9]+)?\s*[a-zA-Zµ%°]+(?:/[a-zA-Z]+)?", 0), F.lit("")))


def _answer_line(c: Column) -> Column:
    """The first line with text of an answer, without quotes, a label or a final dot."""
    line = F.get(F.filter(F.transform(F.split(c, r"\R"), strip), lambda x: x != ""), F.lit(0))
    bare = strip(F.btrim(F.btrim(line, F.lit('"')), F.lit("'")))
    return strip(F.rtrim(strip(F.regexp_replace(bare, r"(?i)^(?:value|answer)\s*:\s*", "")), F.lit(".")))


def _shaped(value: Column, most: Column) -> Column:
    """Whether a text has the shape of a value: a quantity, a range, something that leads with a number, or few words."""
    wordy = (F.size(F.split(value, r"(?U)\s+")) > most) | F.contains(value, F.lit(". ")) | F.contains(value, F.lit("; ")) | F.contains(value, F.lit(", however"))
    return false_if_null((value != "") & ~value.rlike(ABSENT) & ~value.rlike(PROSE) & (~wordy | value.rlike(LEADS_WITH_NUMBER) | parse_quantity(value).isNotNull() | parse_range(value).isNotNull()))


def clean_answer(c: Column, declared: Column | None = None, normalise: Callable[[Column], Column] | None = None) -> Column:
    """An answer as a value, or null if it is absent, prose, or too long for one.

    The words that a value may have grow with the declared value. One that is too long has a second chance: if it has the
    shape of a value without the fact set's qualifiers, it is kept, as it was written.
    """
    most = F.lit(MOST_WORDS) if declared is None else F.coalesce(F.greatest(F.lit(MOST_WORDS), F.size(F.split(squeeze(declared), " ")) + 3), F.lit(MOST_WORDS))

    def kept(value: Column) -> Column:
        first = _shaped(value, most)
        if normalise is None:
            return F.when(first, value)
        # What normalise() leaves is an answer again, with its quotes, label and final dot.
        second = let(lambda s: (s != value) & _shaped(s, F.lit(MOST_WORDS)), s=_answer_line(normalise(value)))
        return F.when(first, value).when((value != "") & ~value.rlike(ABSENT) & ~value.rlike(PROSE) & second, value)

    return let(kept, value=_answer_line(c))


def respelled(value: Column, passage: Column) -> Column:
    """The value as the passage spells it, if they differ in white space only; else itself."""
    flat = no_space(value)
    pattern = F.concat(F.lit(r"(?iU)\Q"), F.array_join(F.split(flat, ""), "\\E\\s*\\Q"), F.lit(r"\E"))
    there = F.contains(no_space(F.lower(passage)), F.lower(flat)) & ~F.contains(squeeze(F.lower(passage)), F.lower(value))
    found = F.nullif(squeeze(F.call_function("regexp_extract", passage, pattern, F.lit(0))), F.lit(""))
    return F.when(there & (flat != "") & ~F.contains(flat, F.lit("\\")), F.coalesce(found, value)).otherwise(value)


def _unit_spellings(unit: Column, aliases: Mapping[str, str]) -> Column:
    """Spellings under which a unit may stand in a passage; aliases: names to the units that the fact set declares for them."""
    known: dict[str, tuple[str, ...]] = dict(SPELLINGS)
    for name, to in aliases.items():
        key = "".join(str(to).split()).lower()
        known[key] = (*known.get(key, ()), str(name).lower())
    table = F.from_json(F.try_element_at(_json_map(known), unit), "array<string>")
    plural = F.when(unit.endswith("s"), F.substring(unit, F.lit(1), F.length(unit) - 1)).otherwise(F.concat(unit, F.lit("s")))
    return F.array_distinct(F.concat(F.array(unit, plural), F.coalesce(table, literals(()))))


def _json_map(known: Mapping[str, tuple[str, ...]]) -> Column:
    import json

    from attestor.functions.text import literal_map

    return literal_map({k: json.dumps(v) for k, v in known.items()})


def _present(unit: Column, low: Column, aliases: Mapping[str, str]) -> Column:
    flat = F.replace(low, F.lit(" "), F.lit(""))
    return F.exists(_unit_spellings(unit, aliases), lambda s: (s != "") & (F.contains(low, s) | F.contains(flat, no_space(s))))


def is_grounded(value: Column, passage: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Both the number, in one of its written forms, and the unit stand in the passage; other values as they are written.

    The passage is read as it is and with number words as digits. The number's forms: as short as it can be written, and as
    the value has it, with or without commas.
    """
    aliases = aliases or {}

    def stands(text: Column, q: Column, unit: Column, forms: Column) -> Column:
        bounded = lambda n: F.call_function("rlike", text, F.concat(F.lit(r"(?<![0-9.])\Q"), n, F.lit(r"\E(?![0-9]|\.[0-9])")))
        money = F.substring(unit, 1, 3)
        named = (
            F.when(unit == "", F.lit(True))
            .when(money.isin(*CURRENCY_UNITS) & (F.length(unit) > 3), _present(money, text, aliases) & _present(F.substring(unit, F.lit(4), F.length(unit)), text, aliases))
            .otherwise(_present(unit, text, aliases))
        )
        return F.when(q.isNotNull(), F.exists(forms, bounded) & named).otherwise(F.contains(text, strip(F.lower(value))))

    def checked(q: Column, written: Column, texts: Column) -> Column:
        forms = F.array_distinct(F.filter(F.array(shortest(q["value"]), written, F.replace(written, F.lit(","), F.lit(""))), lambda n: n != ""))
        return F.exists(texts, lambda text: false_if_null(stands(text, q, F.lower(q["unit"]), forms)))

    readings = F.array_distinct(F.array(squeeze(F.lower(passage)), squeeze(F.lower(digits_for_words(passage)))))
    found = let(checked, q=F.coalesce(parse_quantity(value), parse_leading(value)), written=F.regexp_extract(value, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0), texts=readings)
    return F.when((F.length(value) > 0) & (F.length(passage) > 0), false_if_null(found)).otherwise(False)


def candidates(passage: Column, unit: Column) -> Column:
    """Distinct numbers that stand before a unit in the passage, with or without white space."""
    low = squeeze(F.lower(passage))
    pattern = F.concat(F.lit(r"(?<![0-9.])([-+]?[0-9]+(?:\.[0-9]+)?)\s*\Q"), F.lower(unit), F.lit(r"\E\b"))
    of = lambda text: F.call_function("regexp_extract_all", text, pattern, F.lit(1))
    return F.array_distinct(F.transform(F.concat(of(low), of(F.replace(low, F.lit(" "), F.lit("")))), lambda x: F.ltrim(x, F.lit("+")).try_cast("double")))


def is_ambiguous(value: Column, passage: Column, explained: Column) -> Column:
    """More than one number with the value's unit in the passage, not counting those that other slots of the entity explain:
    explained is an array of quantities, of which those in the value's unit count."""
    def several(q: Column) -> Column:
        own = F.transform(F.filter(explained, lambda x: (F.lower(x["unit"]) == F.lower(q["unit"])) & (x["value"] != q["value"])), lambda x: x["value"])
        return (q["unit"] != "") & (F.size(F.array_except(candidates(passage, q["unit"]), own)) > 1)

    return false_if_null(let(several, q=parse_quantity(value)))


def foreign_words(value: Column, passage: Column) -> Column:
    """Words of two letters or more of the value that the passage lacks."""
    low = squeeze(F.lower(passage))
    return F.filter(F.regexp_extract_all(value, F.lit(r"(?U)[^\W\d_]{2,}"), F.lit(0)), lambda w: ~F.contains(low, F.lower(w)))


def explained_values(facts: DataFrame) -> DataFrame:
    """entity, relation, explained: the distinct quantities of the entity's facts for other relations.

    Facts are curated per entity; what one row gathers are the distinct values of one entity's relations.
    """
    own = facts.withColumn("q", parse_quantity(F.col("o"))).where("q is not null").select("entity", "relation", "q").distinct()
    others = facts.select("entity", "relation").distinct().join(own.withColumnRenamed("relation", "__other"), "entity").where(F.col("relation") != F.col("__other"))
    return others.groupBy("entity", "relation").agg(F.collect_set("q").alias("explained"))


def answered(asked: DataFrame, extractor: Callable[[Column, Column, Column], Column] | None, answers: DataFrame | None) -> DataFrame:
    """asked with answer and repair: from a Column function of text, entity and relation, or from a table (passage_id, entity,
    relation, answer, repair) of what a model said; the repair is its second answer, given its first."""
    if answers is None:
        return asked.withColumn("answer", (extractor or first_quantity)(F.col("text"), F.col("entity"), F.col("relation"))).withColumn("repair", F.lit(None).cast("string"))
    own = answers if "repair" in answers.columns else answers.withColumn("repair", F.lit(None).cast("string"))
    return asked.join(own.select("passage_id", "entity", "relation", "answer", "repair"), ["passage_id", "entity", "relation"], "left")


def extract(
    passages: DataFrame, surfaces: DataFrame, slots: DataFrame, facts: DataFrame, extractor: Callable[[Column, Column, Column], Column] | None = None, answers: DataFrame | None = None,
    normalise: Callable[[Column], Column] | None = None, aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """passage_id, entity, relation, value, state of every asked slot.

    An answer is cleaned, its number words become digits if these stand in the passage, and its white space becomes the
    passage's. If it has words that the passage lacks, the repair is tried once. What then is grounded and unambiguous is a
    claim. An ambiguous value is unresolved, and so is the declared value where the answer says something that can't be
    grounded but the passage states the declared value; all else is dropped. Unresolved slots are to be HELD.
    """
    asked = asked_slots(mentions(passages, surfaces), slots).join(passages.select("passage_id", "text"), "passage_id")
    asked = asked.join(small(explained_values(facts)), ["entity", "relation"], "left")
    text, own = F.col("text"), F.col("value")
    rows = answered(asked, extractor, answers).withColumn("value", clean_answer(F.col("answer"), F.col("stated"), normalise))
    rows = rows.withColumn("__digits", digits_for_words(own))
    rows = rows.withColumn("value", F.when((F.col("__digits") != own) & is_grounded(F.col("__digits"), text, aliases), F.col("__digits")).otherwise(own))
    rows = rows.withColumn("value", respelled(own, text))
    repaired = let(lambda r: F.when(F.size(foreign_words(r, text)) == 0, r), r=respelled(clean_answer(F.col("repair")), text))
    rows = rows.withColumn("value", F.when(F.size(foreign_words(own, text)) > 0, repaired).otherwise(own))
    rows = rows.withColumn("__grounded", is_grounded(own, text, aliases))
    none = F.expr("cast(array() as array<struct<value: double, unit: string>>)")
    rows = rows.withColumn("__several", F.when(F.col("__grounded"), is_ambiguous(own, text, F.coalesce("explained", none))))
    refused = F.coalesce(_answer_line(F.col("answer")), F.lit("")).rlike(ABSENT)
    rows = rows.withColumn("__stated", F.when(~F.col("__grounded") & ~refused, is_grounded(F.col("stated"), text, aliases)))
    state = F.when(F.col("__grounded"), F.when(F.col("__several"), F.lit("unresolved")).otherwise(F.lit("claim"))).when(F.col("__stated"), F.lit("unresolved")).otherwise(F.lit("dropped"))
    value = F.when(F.col("__grounded"), own).when(F.col("__stated"), F.col("stated"))
    return settled(rows, ("passage_id", "entity", "relation"), value=value, state=state)
