"""The value grammar as Column expressions: quantities, currencies, exact notations, ranges and leading quantities.

A value is lexed once: its number tokens, and the gaps before, between and after them. How many tokens there are and what the
gaps say decides the notation: a currency symbol before the only number, a slash between two, a dash or "to" between two
bounds, a plus at the end. parsed() keeps tokens and gaps in columns of their own, so that no pattern runs twice on a value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import false_if_null, let, literal_map, no_space, settled, squeeze, text_key

#: Longer values parse as nothing.
MOST_CHARS = 512
MARK = "\u0001"

#: Currency symbols and words, magnitudes, separators of bounds, words for the absence of a value.
CURRENCIES = {"$": "usd", "US$": "usd", "£": "gbp", "€": "eur", "¥": "jpy"}
CURRENCY_WORDS = {"dollars": "usd", "dollar": "usd", "usd": "usd", "pounds": "gbp", "gbp": "gbp", "euros": "eur", "eur": "eur"}
CURRENCY_UNITS = ("usd", "gbp", "eur", "jpy")
MAGNITUDES = {"k": 1e3, "m": 1e6, "b": 1e9, "thousand": 1e3, "million": 1e6, "billion": 1e9}
DASHES, JOINERS = ("-", "–", "—"), ("to", "and")
ABSENCES = ("no", "none", "not", "nothing", "na", "n/a", "null", "unknown", "unclear", "unspecified", "unavailable", "undetermined", "absent", "missing", "nil")

LETTER = "A-Za-zµ%°"
#: A number token: a run of digits, commas and dots that doesn't continue a word, as the 2 of m2 does.
TOKEN = rf"(?<![{LETTER}0-9.,])[.,]?[0-9][0-9.,]*"
SYMBOL = "|".join(["US[$]", "[" + "".join(s for s in CURRENCIES if len(s) == 1) + "]"])
LETTERS_OF_SCALE = "[" + "".join(m + m.upper() for m in MAGNITUDES if len(m) == 1) + "]"
WORDS_OF_SCALE = "|".join(m for m in MAGNITUDES if len(m) > 1)
#: What may stand before the first number: about, between, a symbol, a sign.
HEAD = rf"^(~?) ?((?:between )?)((?:{SYMBOL})?) ?([-+]?)$"
#: Between two bounds: scale of the first, separator, symbol and sign of the second.
MIDDLE = rf"^ ?({LETTERS_OF_SCALE}?)(?: ?[{''.join(DASHES)}]| (?:{'|'.join(JOINERS)})\b) ?((?:{SYMBOL})?) ?([-+]?)$"
#: After an amount of money: its scale, of which a first letter is enough, and words that belong to the unit.
AFTER_MONEY = rf"^ ?({LETTERS_OF_SCALE}|thousand)? ?([A-Za-z][A-Za-z /]*)? ?$"
#: After a bound: a scale that isn't the beginning of a word, and the unit.
AFTER_BOUND = rf"^ ?({LETTERS_OF_SCALE}(?![A-Za-z])|{WORDS_OF_SCALE})? ?([{LETTER}][{LETTER}/ ]*)?$"
AFTER_LAST_BOUND = AFTER_BOUND.replace(f"|{WORDS_OF_SCALE}", "")
WORDED = rf"^ ?({WORDS_OF_SCALE})? ?([A-Za-z]+) ?$"
POWER = rf"^([-+]?[0-9]*[.]?[0-9]+) ?(?:[eE]|[x*×] ?10 ?\^?) ?([-+]?[0-9]+) ?([0-9{LETTER}][0-9{LETTER}/ ]*)?$"
NUMBER = r"(?<![.0-9])[+-]?\d+(?:,\d{3})*(?:\.\d+)?(?!\d)"
ABSENT = rf"(?iU)^\s*(?:{'|'.join(sorted(ABSENCES, key=len, reverse=True))})\b"

QUANTITY_TYPE, RANGE_TYPE = "struct<value: double, unit: string>", "struct<low: double, high: double, unit: string>"


def _parts(c: Column, pattern: str, n: int) -> Column:
    """The n groups of an anchored pattern, absent ones empty; null where it doesn't match."""
    found = F.split(F.regexp_replace(c, pattern, MARK.join(f"${i}" for i in range(1, n + 1)) + MARK), MARK)
    return F.when(F.size(found) == n + 1, found)


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")




def _scale(c: Column) -> Column:
    return F.when(c == "", F.lit(1.0)).otherwise(F.try_element_at(literal_map(MAGNITUDES), F.lower(c)))


def _code(c: Column) -> Column:
    return F.try_element_at(literal_map(CURRENCIES), c)


def _grouped(token: Column) -> Column:
    """The token as a number if its commas are between groups of three digits or absent."""
    return F.when(token.rlike(r"^(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]*)(?:[.][0-9]+)?$"), _number(token))


def _bound(token: Column) -> Column:
    """The token as a bound, in which commas may stand anywhere after the first digit."""
    return F.when(token.rlike(r"^[0-9][0-9,]*(?:[.][0-9]+)?$"), _number(token))


def _signed(sign: Column, value: Column) -> Column:
    return F.when(sign == "-", -value).otherwise(value)


def _make(kind: str, condition: Column, *values: Column) -> Column:
    names = ("value", "unit") if kind == QUANTITY_TYPE else ("low", "high", "unit")
    return F.when(condition, F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True))).cast(kind))


def _text(c: Column) -> Column:
    """The value with single spaces, or null if it is empty, too long or can't be lexed."""
    return F.when((F.length(c) > 0) & (F.length(c) <= MOST_CHARS) & ~F.contains(c, F.lit(MARK)), squeeze(c))


def _lex(text: Column) -> dict[str, Column]:
    return {"tokens": F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), "gaps": F.split(text, TOKEN)}


def _look(x: dict[str, Column]) -> dict[str, Column]:
    """What several notations ask of a lexed value: the parts of its head, its first number, its first tail."""
    return {"n": F.size(x["tokens"]), "head": _parts(x["gaps"][0], HEAD, 4), "first": _grouped(F.get(x["tokens"], F.lit(0))), "tail": F.get(x["gaps"], F.lit(1))}


def _money(x: dict[str, Column]) -> Column:
    """A symbol and a number, a scale and words of the unit; or a number and a currency's name."""
    bare = (x["n"] == 1) & (x["head"][1] == "") & (x["head"][3] == "")
    symbol = let(
        lambda after: _make(QUANTITY_TYPE, after.isNotNull() & x["first"].isNotNull(), x["first"] * _scale(after[0]), F.concat(_code(x["head"][2]), F.lower(no_space(after[1])))),
        after=_parts(x["tail"], AFTER_MONEY, 2),
    )
    worded = let(
        lambda after: let(lambda word: _make(QUANTITY_TYPE, word.isNotNull() & x["first"].isNotNull(), x["first"] * _scale(after[0]), word), word=F.try_element_at(literal_map(CURRENCY_WORDS), F.lower(after[1]))),
        after=_parts(x["tail"], WORDED, 2),
    )
    return F.when(bare & (x["head"][2] != ""), symbol).when((x["n"] == 1) & (x["gaps"][0] == ""), worded)


def _exact(x: dict[str, Column]) -> Column:
    """A fraction or mixed number, a ratio with its denominator in the unit, a power of ten in the range of doubles."""
    token, gap = (lambda i: F.get(x["tokens"], F.lit(i))), (lambda i: F.get(x["gaps"], F.lit(i)))
    digits = F.forall(x["tokens"], lambda t: t.rlike("^[0-9]+$"))

    def fraction(over: int) -> Column:
        whole = token(0).try_cast("double") if over else F.lit(0.0)
        below = token(over + 1).try_cast("double")
        shape = digits & (F.btrim(gap(over + 1)) == "/") & gap(over + 2).rlike(rf"^ ?([{LETTER}][{LETTER}/ ]*)?$") & ((gap(1) == " ") if over else F.lit(True))
        return _make(QUANTITY_TYPE, shape & (below != 0), whole + F.try_divide(token(over).try_cast("double"), below), no_space(gap(over + 2)))

    plain = F.forall(x["tokens"], lambda t: t.rlike("^[0-9]+([.][0-9]+)?$"))
    ratio = _make(QUANTITY_TYPE, plain & (F.btrim(gap(1)) == ":") & F.btrim(gap(2)).isin("", "ratio") & (_number(token(1)) != 0), _number(token(0)), F.concat(F.lit("ratio:"), token(1)))

    def power(parts: Column) -> Column:
        value = F.concat(parts[0], F.lit("E"), parts[1]).try_cast("double")
        return _make(QUANTITY_TYPE, (F.abs(value) < float("inf")) & ((_number(parts[0]) == 0) | (value != 0)), value, no_space(parts[2]))

    begins = x["gaps"][0] == ""
    return F.coalesce(F.when(begins & (x["n"] == 2), F.coalesce(fraction(0), ratio)).when(begins & (x["n"] == 3), fraction(1)), let(power, parts=_parts(x["text"], POWER, 3)))


def _plain(x: dict[str, Column]) -> Column:
    """A number and words of letters, digits after the first, joined by spaces or slashes."""
    unit = no_space(x["tail"])
    shape = (x["n"] == 1) & (x["head"][1] == "") & (x["head"][2] == "") & x["tail"].rlike(rf"^ ?(?:[{LETTER}](?:[0-9{LETTER}/ ]*[0-9{LETTER}])?)? ?$")
    return _make(QUANTITY_TYPE, shape & x["first"].isNotNull(), _signed(x["head"][3], x["first"]), unit)


def _range(x: dict[str, Column], unitless: Column) -> Column:
    """Open upwards with a plus at the end, or between two ascending bounds; without a unit only if unitless holds."""
    def opened(after: Column) -> Column:
        unit = F.coalesce(_code(x["head"][2]), no_space(after[1]))
        low = _bound(x["tokens"][0])
        return _make(RANGE_TYPE, after.isNotNull() & low.isNotNull() & ((unit != "") | unitless), low * _scale(after[0]), F.lit(float("inf")), unit)

    def closed(middle: Column, after: Column) -> Column:
        unit = F.coalesce(_code(x["head"][2]), _code(middle[1]), no_space(after[1]))
        low, high = _signed(x["head"][3], _bound(x["tokens"][0])) * _scale(middle[0]), _signed(middle[2], _bound(x["tokens"][1])) * _scale(after[0])
        return _make(RANGE_TYPE, middle.isNotNull() & after.isNotNull() & (low < high) & ((unit != "") | unitless), low, high, unit)

    single = (x["n"] == 1) & (x["head"][1] == "") & (x["head"][3] == "") & x["tail"].endswith("+")
    double = (x["n"] == 2) & (x["head"][0] == "")
    without = F.substring(x["tail"], F.lit(1), F.length(x["tail"]) - 1)
    return F.when(single, let(opened, after=_parts(without, AFTER_BOUND, 2))).when(double, let(closed, middle=_parts(x["gaps"][1], MIDDLE, 3), after=_parts(x["gaps"][2], AFTER_LAST_BOUND, 2)))


def _leading(x: dict[str, Column]) -> Column:
    """The quantity that a value begins with, whatever follows. Of digits without commas only three are read."""
    def found(token: Column, read: Column) -> Column:
        whole = F.length(read) == F.length(token)
        scale = F.when(whole, F.regexp_extract(x["tail"], rf"^ ?({LETTERS_OF_SCALE}|thousand)", 1)).otherwise("")
        unit = F.when(whole, no_space(F.regexp_extract(x["tail"], rf"^ ?([{LETTER}]+(?: ?/ ?[{LETTER}]+)*)", 1))).otherwise("")
        money = x["head"][2] != ""
        value = F.when(money, _number(read) * _scale(scale)).otherwise(_signed(x["head"][3], _number(read)))
        sole = (x["head"][0] == "") & (x["head"][1] == "") & ((x["head"][2] == "") | (x["head"][3] == ""))
        return _make(QUANTITY_TYPE, sole & (read != ""), value, F.when(money, _code(x["head"][2])).otherwise(unit))

    token = F.get(x["tokens"], F.lit(0))
    return let(found, token=token, read=F.regexp_extract(token, r"^(?:[0-9]{1,3}(?:,[0-9]{3})*(?:[.][0-9]+)?|[.][0-9]+)", 0))


def _quantity(x: dict[str, Column], numeric: Column) -> Column:
    """Money first, then the exact notations if the value is numeric, then the plain form."""
    return F.coalesce(_money(x), F.when(numeric, _exact(x)), _plain(x))


def _one(c: Column, make: Callable[..., Column], *flags: Column | bool) -> Column:
    """make of a lexed value, each stage evaluated once."""
    own = {f"flag{i}": F.lit(x) if isinstance(x, bool) else x for i, x in enumerate(flags)}
    third = lambda x, *f: let(lambda *v: make(x | dict(zip(("n", "head", "first", "tail"), v, strict=True)), *f), **_look(x))
    second = lambda text, *f: let(lambda tokens, gaps: third({"text": text, "tokens": tokens, "gaps": gaps}, *f), **_lex(text))
    return let(lambda text, *f: F.when(text.isNotNull(), second(text, *f)), text=_text(c), **own)


def parse_quantity(c: Column, numeric: Column | bool = False) -> Column:
    return _one(c, _quantity, numeric)


def parse_range(c: Column, unitless: Column | bool = False) -> Column:
    return _one(c, _range, unitless)


def parse_leading(c: Column) -> Column:
    return _one(c, _leading)


def parse_exact(c: Column) -> Column:
    """Fractions, ratios and powers of ten only."""
    return _one(c, _exact)


def numbers(c: Column) -> Column:
    """All number tokens as doubles."""
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), _number)


def is_currency(q: Column, r: Column) -> Column:
    """Whether what parses (without the numeric notations) is money; null if nothing parses."""
    unit = F.coalesce(q["unit"], r["unit"])
    return F.substring(unit, 1, 3).isin(*CURRENCY_UNITS)


#: Fields of a parsed value.
FIELDS = ("raw", "q", "r", "money", "exact", "lead", "numbers", "key")


@lru_cache(maxsize=2)
def _stages(compose: bool) -> tuple[dict[str, Column], ...]:
    """The columns that parsed() adds, stage by stage, from __lex_raw and __lex_flag: built once, as building them takes longer than
    planning them."""
    raw = F.col("__lex_raw")
    x = {k: F.col(f"__lex_{k}") for k in ("text", "tokens", "gaps", "n", "head", "first", "tail")}
    money, exact, plain, r1 = (F.col(f"__lex_{k}") for k in ("money", "exact", "plain", "r1"))
    r0 = F.when(r1["unit"] != "", r1)
    q, r = F.coalesce(money, F.when(F.col("__lex_flag"), exact), plain), F.when(F.col("__lex_flag"), r1).otherwise(r0)
    # Number tokens and the text key are asked for only where a value is neither a quantity nor a range.
    words = F.col("__lex_q").isNull() & F.col("__lex_r").isNull()
    value = F.struct(
        raw.alias("raw"), F.col("__lex_q").alias("q"), F.col("__lex_r").alias("r"), is_currency(F.coalesce(money, plain), r0).alias("money"), exact.isNotNull().alias("exact"), F.col("__lex_lead").alias("lead"),
        F.when(words, numbers(raw)).alias("numbers"), F.when(words, text_key(raw, compose)).alias("key"),
    )
    return (
        {"__lex_text": _text(raw)},
        {f"__lex_{k}": v for k, v in _lex(x["text"]).items()},
        {f"__lex_{k}": v for k, v in _look(x).items()},
        {"__lex_money": _money(x), "__lex_plain": _plain(x), "__lex_r1": _range(x, F.lit(True)), "__lex_lead": _leading(x)},
        # An exact notation is asked for only of a value that isn't money, and else may be something other than a plain number.
        {"__lex_exact": F.when(money.isNull() & (F.col("__lex_flag") | plain.isNull()), _exact(x))},
        {"__lex_q": q, "__lex_r": r},
        {"value": value},
    )


def parsed(df: DataFrame, column: str, out: str, numeric: str | Column, compose: bool = True) -> DataFrame:
    """df with the struct column out: everything that a comparison needs of a value, each pattern evaluated once."""
    flag = F.col(numeric) if isinstance(numeric, str) else numeric
    keep = df.columns
    df = df.withColumns({"__lex_raw": F.col(column), "__lex_flag": false_if_null(flag)})
    *stages, last = _stages(compose)
    for stage in stages:
        df = df.withColumns(stage)
    return settled(df, keep, **{out: last["value"]})
