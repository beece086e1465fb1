"""The engine's functions in SQL: temporary SQL functions whose bodies are the Column expressions, and one table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from attestor.functions import grammar, stats, text
from attestor.functions.text import let, offsets

OPERATORS = {"+", "-", "*", "/", "%", "=", "<", ">", "<=", ">=", "<=>", "!=", "and", "or"}


def _string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_of(column: Column) -> str:
    """The SQL text of a Column expression that was built from functions, literals, lambdas, casts and CASE."""
    return _sql(column._jc.node())


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.length())]


def _sql(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "SqlExpression":
        return f"({node.expression()})"
    if kind == "UnresolvedAttribute":
        return ".".join(_all(node.nameParts()))
    if kind == "UnresolvedNamedLambdaVariable":
        return node.name()
    if kind == "LambdaFunction":
        names = [v.name() for v in _all(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_sql(node.function())}"
    if kind == "Literal":
        value = node.value()
        if value is None:
            return "null"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, float):
            return f"double('{'Infinity' if value == float('inf') else value}')"
        return _string(value) if isinstance(value, str) else str(value)
    if kind == "Cast":
        return f"{'try_cast' if 'Try' in node.evalMode().toString() else 'cast'}({_sql(node.child())} as {node.dataType().sql()})"
    if kind == "Alias":
        return f"{_sql(node.child())} as `{node.name().apply(0)}`"
    if kind == "UnresolvedExtractValue":
        key = node.extraction()
        inner = key.value() if key.getClass().getSimpleName() == "Literal" else None
        return f"{_sql(node.child())}.`{inner}`" if isinstance(inner, str) else f"{_sql(node.child())}[{_sql(key)}]"
    if kind == "CaseWhenOtherwise":
        whens = " ".join(f"when {_sql(b._1())} then {_sql(b._2())}" for b in _all(node.branches()))
        otherwise = f" else {_sql(node.otherwise().get())}" if node.otherwise().isDefined() else ""
        return f"(case {whens}{otherwise} end)"
    if kind == "UnresolvedFunction":
        name, args = node.functionName(), [_sql(a) for a in _all(node.arguments())]
        if name.lower() in OPERATORS and len(args) == 2:
            return f"({args[0]} {name} {args[1]})"
        if name == "!" or name == "not":
            return f"(not {args[0]})"
        return f"{name}({', '.join(args)})"
    raise TypeError(f"no SQL for {kind}")


def _value(c: Column, numeric: Column) -> Column:
    """What grammar.parsed makes of a value, in one expression (its text key without composition)."""
    q, r, q0, r0 = grammar.parse_quantity(c, numeric), grammar.parse_range(c, numeric), grammar.parse_quantity(c), grammar.parse_range(c)
    fields = lambda q, r, q0, r0, exact, lead: F.struct(
        c.alias("raw"), q.alias("q"), r.alias("r"), grammar.is_currency(q0, r0).alias("money"), exact.alias("exact"), lead.alias("lead"), grammar.numbers(c).alias("numbers"), text.text_key(c, False).alias("key")
    )
    return let(fields, q=q, r=r, q0=q0, r0=r0, exact=grammar.parse_exact(c).isNotNull(), lead=grammar.parse_leading(c))


def functions() -> dict[str, tuple[str, str, Callable[[], Column]]]:
    """Name to parameters, type and expression over the parameters."""
    from attestor.operators.compare import outcome, source_grounded
    from attestor.operators.extract import is_grounded

    col = F.col
    bounds = lambda i: stats.wilson(col("k"), col("n"))[i]
    compared = lambda: let(lambda d, c: outcome(d, c, col("numeric")), d=_value(col("declared"), col("numeric")), c=_value(col("claimed"), col("numeric")))
    return {
        "parse_quantity": ("v string, numeric boolean default false", grammar.QUANTITY_TYPE, lambda: grammar.parse_quantity(col("v"), col("numeric"))),
        "parse_range": ("v string, unitless boolean default false", grammar.RANGE_TYPE, lambda: grammar.parse_range(col("v"), col("unitless"))),
        "text_key": ("v string", "string", lambda: text.text_key(col("v"), False)),
        "compare_values": ("declared string, claimed string, numeric boolean default false", "string", compared),
        "source_grounded": ("declared string, claimed string, source string, raw string", "boolean", lambda: source_grounded(col("declared"), col("claimed"), col("source"), col("raw"))),
        "value_is_grounded": ("v string, passage string", "boolean", lambda: is_grounded(col("v"), col("passage"))),
        "wilson_lo": ("k bigint, n bigint", "double", lambda: bounds(0)),
        "wilson_hi": ("k bigint, n bigint", "double", lambda: bounds(1)),
    }


@udtf(returnType="s: int, e: int")
class SplitSentencesOffsets:
    """s, e of each sentence of a text."""

    def eval(self, body: str) -> Iterator[tuple[int, int]]:
        yield from offsets(body or "")


def register(spark: SparkSession, normalise: Callable[[Column], Column] | None = None, names: tuple[str, ...] = ()) -> None:
    """Temporary functions of the given names (all, if none are given), and normalise_value where a fact set's normalise is given."""
    own = functions()
    if normalise is not None:
        own["normalise_value"] = ("v string", "string", lambda: normalise(F.col("v")))
    for name, (parameters, kind, make) in own.items():
        if not names or name in names:
            spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {sql_of(make())}")
    if not names or "split_sentences_offsets" in names:
        spark.udtf.register("split_sentences_offsets", SplitSentencesOffsets)
