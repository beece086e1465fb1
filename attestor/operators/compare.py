"""Three-valued comparison of a declared and a claimed value, and the residue rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.grammar import ABSENT, MOST_CHARS, numbers, parse_range, parsed
from attestor.functions.text import clauses, false_if_null, let, literals, settled, squeeze

MATCH, DIFFER, INCOMPARABLE = "MATCH", "DIFFER", "INCOMPARABLE"

#: Fixed values of the residue rule: words that may begin a fragment, that may not occur in one, and that void a clause.
LEADERS = ("per", "of", "at", "in", "on", "for", "by", "to", "from", "with", "within", "before", "after", "during", "across", "under", "over", "up", "each", "every")
ADVERBS = (
    "monthly", "daily", "weekly", "annually", "quarterly", "hourly", "nightly", "yearly", "once", "twice", "thrice", "flat", "total", "combined", "approximately", "about", "roughly",
    "nominal", "maximum", "minimum", "inclusive", "exclusive",
)
STRUCTURAL = ("or", "unless", "if", "except", "when", "while", "but", "though", "although", "provided", "subject", "whereas", "otherwise", "instead", "rather", "versus")
NEGATIONS = (
    "not", "n't", "never", "no", "nor", "none", "except", "excepting", "unless", "excluding", "excluded", "exclude", "without", "waived", "waive", "exempt", "contraindicated",
    "contraindication", "free", "complimentary", "reduced", "discounted", "halved", "prorated", "refunded", "forgiven", "abated", "unlimited", "gratis",
)


def leading_range(claimed: Column, declared: Column, unitless: Column) -> Column:
    """The range that the longest prefix of whole words spells in the declared unit, unless a declared bound recurs after it."""
    return let(_leading_range, claimed=claimed, declared=declared, unitless=unitless)


def _leading_range(claimed: Column, declared: Column, unitless: Column) -> Column:
    tokens = F.split(squeeze(claimed), " ")

    def prefix(i: Column) -> Column:
        text = F.regexp_replace(F.array_join(F.slice(tokens, F.lit(1), i), " "), "[.,;:]+$", "")
        return F.struct(i.alias("i"), parse_range(text, unitless).alias("r"))

    fits = F.filter(F.transform(F.sequence(F.size(tokens), F.lit(1), F.lit(-1)), prefix), lambda x: x["r"].isNotNull() & (x["r"]["unit"] == declared["unit"]))
    best = F.get(fits, F.lit(0))
    rest = numbers(F.array_join(F.slice(tokens, best["i"] + 1, F.greatest(F.size(tokens) - best["i"], F.lit(0))), " "))
    recurs = F.array_contains(rest, declared["low"]) | F.array_contains(rest, declared["high"])
    return F.when(best.isNotNull() & ~recurs, best["r"])


def outcome(d: Column, c: Column, numeric: Column) -> Column:
    """MATCH, DIFFER or INCOMPARABLE for parsed values (see grammar.parsed); the first rule that applies decides."""
    incomparable = F.lit(INCOMPARABLE)
    return (
        F.when(c["raw"].isNull() | d["raw"].isNull(), incomparable)
        .when((F.length(d["raw"]) > MOST_CHARS) | (F.length(c["raw"]) > MOST_CHARS), incomparable)
        .when(false_if_null(d["money"] != c["money"]), incomparable)
        .when(d["r"].isNotNull(), _to_range(d["r"], c, numeric))
        .when(c["r"].isNotNull(), incomparable)
        .when(d["q"].isNotNull(), _to_quantity(d["q"], c, numeric))
        .when(c["q"].isNotNull(), incomparable)
        .otherwise(let(_texts, dk=d["key"], ck=c["key"]))
    )


def _to_range(dr: Column, c: Column, numeric: Column) -> Column:
    """A claimed range, or the one that a claim begins with, against a declared range; else a claimed point."""
    incomparable = F.lit(INCOMPARABLE)

    def ranges(cr: Column, point: Column) -> Column:
        both = (
            F.when(dr["unit"] != cr["unit"], incomparable)
            .when((cr["high"] < dr["low"]) | (cr["low"] > dr["high"]), F.lit(DIFFER))
            .when((cr["low"] == dr["low"]) & (cr["high"] == dr["high"]) & c["r"].isNotNull(), F.lit(MATCH))
            .otherwise(incomparable)
        )
        inside = (
            F.when(point.isNull() | (point["unit"] != dr["unit"]), incomparable)
            .when(~point["value"].between(dr["low"], dr["high"]), F.lit(DIFFER))
            .when(c["q"].isNotNull(), F.lit(MATCH))
            .otherwise(incomparable)
        )
        return F.when(cr.isNotNull(), both).otherwise(inside)

    return let(ranges, cr=F.coalesce(c["r"], leading_range(c["raw"], dr, numeric)), point=F.coalesce(c["q"], c["lead"]))


def _to_quantity(dq: Column, c: Column, numeric: Column) -> Column:
    """Equal or not in the same unit; else only a leading number in that unit can differ, if the declared one isn't told too."""
    incomparable, cq = F.lit(INCOMPARABLE), c["q"]
    elsewhere = F.when(false_if_null((c["lead"]["unit"] == dq["unit"]) & (c["lead"]["value"] != dq["value"])), F.lit(DIFFER)).otherwise(incomparable)
    return (
        F.when(cq["unit"] == dq["unit"], F.when(dq["value"] == cq["value"], F.lit(MATCH)).otherwise(F.lit(DIFFER)))
        .when(cq.isNull() & (~numeric & c["exact"] | F.array_contains(c["numbers"], dq["value"])), incomparable)
        .otherwise(elsewhere)
    )


def _texts(dk: Column, ck: Column) -> Column:
    """Canonical texts: only ones without digits, of similar length, neither in the other, can differ."""
    words = lambda k: F.when(k == "", F.lit(0)).otherwise(F.size(F.split(k, " ")))
    unlike = ck.rlike(ABSENT) & ~dk.rlike(ABSENT) | (words(ck) > F.greatest(F.lit(4), words(dk) + 2)) | F.contains(ck, dk) | F.contains(dk, ck) | F.concat(dk, ck).rlike(r"(?U)\d")
    return F.when(dk == ck, F.lit(MATCH)).when(unlike, F.lit(INCOMPARABLE)).otherwise(F.lit(DIFFER))


def compare(df: DataFrame, declared: str = "declared", claimed: str = "claimed", numeric: str = "numeric", compose: bool = True) -> DataFrame:
    """df with the column outcome."""
    keep = df.columns
    df = parsed(parsed(df, declared, "__d", numeric, compose), claimed, "__c", numeric, compose)
    return settled(df, keep, outcome=outcome(F.col("__d"), F.col("__c"), F.col(numeric)))


def folded(c: Column) -> Column:
    return squeeze(F.lower(c))


def is_modifier(residue: Column, raw: Column) -> Column:
    """Only recognised scope phrases: comma-separated fragments that begin with a leader, an adverb or a short capital code."""
    codes = F.transform(F.filter(F.regexp_extract_all(raw, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: (w == F.upper(w)) & F.length(w).between(2, 4)), lambda w: F.lower(w))
    text = F.btrim(residue, F.lit(" ,;:"))
    fragments = F.filter(F.transform(F.split(text, ","), squeeze), lambda f: f != "")

    def admitted(f: Column) -> Column:
        words = F.regexp_extract_all(F.lower(f), F.lit("[a-z0-9'/%°µ+-]+"), F.lit(0))
        head = F.get(words, F.lit(0))
        return (F.size(words) > 0) & ~F.arrays_overlap(words, literals(STRUCTURAL)) & (F.array_contains(literals(LEADERS + ADVERBS), head) | F.array_contains(codes, head))

    return (text != "") & F.forall(fragments, lambda f: false_if_null(admitted(f)))


def source_grounded(declared: Column, claimed: Column, source: Column, raw: Column) -> Column:
    """Whether the source states the whole claim, normalised or raw, in the only clause that states the declared value; false if
    it can't be shown. Everything but the comparison of prefixes is evaluated only where the claim extends the declared value."""
    return let(_source_grounded, declared=declared, claimed=claimed, source=source, raw=raw)


def _source_grounded(declared: Column, claimed: Column, source: Column, raw: Column) -> Column:
    nd = folded(declared)
    longer = F.filter(F.array_distinct(F.array(claimed, raw)), lambda x: F.startswith(folded(x), nd) & (folded(x) != nd))

    def stated(nd: Column, clauses_of_it: Column, span: Column, longer: Column) -> Column:
        one = F.get(clauses_of_it, F.lit(0))
        negated = F.arrays_overlap(F.regexp_extract_all(one, F.lit("[a-z']+"), F.lit(0)), literals(NEGATIONS))
        return (F.size(clauses_of_it) == 1) & ~negated & F.exists(longer, lambda x: false_if_null(_admitted(nd, x, raw, one, span)))

    holding = F.filter(F.transform(clauses(source), folded), lambda s: F.contains(s, nd))
    found = let(stated, nd=nd, clauses_of_it=holding, span=parse_range(declared).isNotNull(), longer=longer)
    return F.when((nd != "") & (F.length(source) > 0) & (F.size(longer) > 0), false_if_null(found)).otherwise(False)


def _admitted(nd: Column, claimed: Column, raw: Column, clause: Column, span: Column) -> Column:
    """What follows the declared value in a claim is a scope phrase without digits, the clause has the claim, and the claim is
    no range unless the declared value is one."""
    nc = folded(claimed)
    residue = F.substring(nc, F.length(nd) + 1, F.length(nc))
    tail = F.coalesce(raw, claimed)
    tail = F.substring(tail, F.greatest(F.length(tail) - F.length(residue) - 3, F.lit(1)), F.length(residue) + 4)
    becomes_range = ~span & F.exists(F.array(claimed, nc, raw), lambda x: parse_range(x).isNotNull())
    return F.contains(clause, nc) & is_modifier(residue, tail) & ~residue.rlike(r"(?U)\d|\p{N}") & ~becomes_range
