"""The verdict on every claim: alias join, slot join, selection by condition, comparison, residue rule."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor import __version__
from attestor.functions.grammar import parsed
from attestor.functions.text import false_if_null, let, settled, strip
from attestor.operators.compare import DIFFER, MATCH, outcome, source_grounded
from attestor.session import materialised

VERIFIED, BLOCK, HELD = "VERIFIED", "BLOCK", "HELD"
#: Most rows and bytes (as JSON) of a table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def is_small(df: DataFrame, rows: DataFrame | None = None) -> bool:
    """Whether rows and bytes of df have been counted to be few. rows: as many rows as df has, where these take less to count."""
    if rows is not None and rows.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return False
    size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES


def small(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if it is small."""
    return F.broadcast(df) if is_small(df, rows) else df


def repeatable(df: DataFrame) -> bool:
    """Whether df has the same rows whenever it is read: neither a stream nor of expressions that may give other values."""
    return not df.isStreaming and df._jdf.queryExecution().analyzed().deterministic()


def once(df: DataFrame, inputs: dict[str, Column], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that compute adds to its inputs, which it gets each distinct combination of once.

    df is read twice; if it isn't repeatable, it is written down first. Columns of compute's result must not have names of df's.
    """
    df = df if repeatable(df) else materialised(df, "once")
    keys = {k: f"__of{k}" for k in inputs}
    made = compute(df.select(*(c.alias(k) for k, c in inputs.items())).distinct()).withColumnsRenamed(keys)
    rows = df.withColumns(inputs)
    return rows.join(made, reduce(and_, (F.col(k).eqNullSafe(F.col(of)) for k, of in keys.items())), "left").drop(*inputs, *keys.values())


def resolve(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """claims with entity: the owner of the mention, white space and case aside."""
    known = small(aliases.select(F.col("surface").alias("__surface"), F.col("entity").alias("__entity")))
    rows = claims.drop("entity").withColumn("__mention", F.lower(strip(F.col("entity_mention")))).join(known, F.col("__mention") == F.col("__surface"), "left")
    return rows.drop("__mention", "__surface").withColumnRenamed("__entity", "entity")


def applies(when: Column, context: Column) -> Column:
    """Every condition has the context's value, case aside."""
    low = F.transform(F.map_entries(context), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.lower(e["value"]).alias("value")))
    return F.forall(F.map_entries(when), lambda w: F.exists(low, lambda e: (e["key"] == F.lower(w["key"])) & (e["value"] == F.lower(w["value"]))))


def chosen(variants: Column, context: Column) -> Column:
    """The one fact for a context, or null: a lone unconditional one; else the only conditional one that applies; else, if a
    context is given and none applies, the only unconditional one."""
    def pick(variants: Column, context: Column) -> Column:
        conditional = F.filter(variants, lambda v: (F.size(v["when"]) > 0) & applies(v["when"], context))
        plain = F.filter(variants, lambda v: F.size(v["when"]) == 0)
        return let(_pick, variants=variants, conditional=conditional, plain=plain, given=F.size(context) > 0)

    first = F.get(variants, F.lit(0))
    several = let(pick, variants=variants, context=F.coalesce(context, F.create_map().cast("map<string,string>")))
    return F.when((F.size(variants) == 1) & (F.size(first["when"]) == 0), first).otherwise(several)


def _pick(variants: Column, conditional: Column, plain: Column, given: Column) -> Column:
    only = lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0)))
    return F.coalesce(only(conditional), F.when((F.size(conditional) == 0) & given, only(plain)))


#: What a claim is to one variant of its slot.
SAME, OTHER, QUOTED, UNDECIDED = "SAME", "OTHER", "QUOTED", "UNDECIDED"


def _judged(v: Column, c: Column, numeric: Column, normal: Column, raw: Column) -> Column:
    """A variant with what the claim is to it. The source is read only where values can't be compared."""
    found = outcome(v["d"], c, numeric)
    quoted = F.when(source_grounded(v["o"], normal, v["source"], raw), F.lit(QUOTED)).otherwise(F.lit(UNDECIDED))
    verdict = F.when(v["d"].isNull(), F.lit(UNDECIDED)).otherwise(let(lambda x: F.when(x == MATCH, F.lit(SAME)).when(x == DIFFER, F.lit(OTHER)).otherwise(quoted), x=found))
    return F.struct(v["o"].alias("o"), v["source"].alias("source"), v["when"].alias("when"), verdict.alias("is"))


def check_arguments(claims: DataFrame) -> None:
    """Raises TypeError unless mention, relation and value are strings and the context is a map of strings."""
    types = {f.name: f.dataType.simpleString() for f in claims.schema}
    for name, wanted in (("entity_mention", "string"), ("relation", "string"), ("claimed_value", "string"), ("context", "map<string,string>")):
        if types.get(name) not in (wanted, "void"):
            raise TypeError(f"{name} must be {wanted}, got {types.get(name)}")


def gate(claims: DataFrame, aliases: DataFrame, slots: DataFrame, fingerprint: str = "", normalise=lambda c: c, compose: bool = True) -> DataFrame:
    """claims (entity_mention, relation, claimed_value, context) with entity, status, declared, source, reason, fingerprint, version.

    Null values are HELD, never VERIFIED or BLOCK. Facts are parsed once, a claim once, and each variant of its slot is judged
    once; nothing of the claims is shuffled while aliases and slots are small. If slots aren't, claims are shuffled anyway, and of
    claims that agree in mention, relation, value and context one is judged for all. Columns of claims with names of the result
    are replaced, others are kept whatever their names.
    """
    check_arguments(claims)
    added = ("entity", "status", "declared", "source", "reason", "factset_fingerprint", "library_version")
    keep = [c for c in claims.columns if c not in added]
    known = slots.select(F.col("entity").alias("__slot_entity"), F.col("relation").alias("__slot_relation"), F.col("numeric").alias("__slot_numeric"), F.col("variants").alias("__variants"))
    if is_small(known, getattr(slots, "keys", None)):
        return _verdicts(claims, aliases, F.broadcast(known), keep, fingerprint, normalise, compose)
    inputs = {f"__{c}": F.col(c).cast("string") for c in ("entity_mention", "relation", "claimed_value")} | {"__context": F.array_sort(F.map_entries(F.col("context").cast("map<string,string>")))}
    own = {k.removeprefix("__"): F.col(k) for k in inputs} | {"context": F.map_from_entries("__context")}

    def judged(asked: DataFrame) -> DataFrame:
        return _verdicts(asked.withColumns(own), aliases, known, list(inputs), fingerprint, normalise, compose)

    kept = claims.select(*keep)
    if not repeatable(kept):
        return _verdicts(claims, aliases, known, keep, fingerprint, normalise, compose)
    return once(kept, inputs, judged).select(*keep, *added)


def _verdicts(claims: DataFrame, aliases: DataFrame, known: DataFrame, keep: list[str], fingerprint: str, normalise, compose: bool) -> DataFrame:
    """The kept columns of claims and their verdicts; known: the slots, by names that claims don't have."""
    rows = resolve(claims, aliases)
    rows = rows.join(known, (rows["entity"] == F.col("__slot_entity")) & (rows["relation"] == F.col("__slot_relation")), "left").drop("__slot_entity", "__slot_relation")
    rows = rows.withColumn("__normal", normalise(F.col("claimed_value"))).withColumn("__numeric", F.coalesce("__slot_numeric", F.lit(False)))
    rows = parsed(rows, "__normal", "__c", "__numeric", compose)
    *stages, verdict = _stages()
    for stage in stages:
        rows = rows.withColumns(stage)
    return settled(rows, [*keep, "entity"], **verdict, factset_fingerprint=F.lit(fingerprint), library_version=F.lit(__version__))


@lru_cache(maxsize=1)
def _stages() -> tuple[dict[str, Column], ...]:
    """The columns from a claim (__c, __normal, claimed_value, context, entity) and its slot (__variants, __numeric) to its
    verdict, stage by stage, built once."""
    each = F.transform("__variants", lambda v: _judged(v, F.col("__c"), F.col("__numeric"), F.col("__normal"), F.col("claimed_value")))
    one, hit, first = F.col("__one"), F.col("__hit"), F.get("__each", F.lit(0))
    several = F.col("__each").isNotNull() & one.isNull()
    found = F.when(several, F.get(F.filter("__each", lambda e: e["is"].isin(SAME, QUOTED)), F.lit(0)))
    differ = several & F.forall("__each", lambda e: e["is"] == OTHER)
    joined = F.array_join(F.transform("__each", lambda e: e["o"]), " | ")
    keys = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("__each", lambda e: F.map_keys(e["when"]))))), ", ")
    status = F.when(one["is"].isin(SAME, QUOTED), F.lit(VERIFIED)).when((one["is"] == OTHER) | false_if_null(differ), F.lit(BLOCK)).otherwise(F.lit(HELD))
    reason = (
        F.when(F.col("entity").isNull(), F.lit("the entity is not in the fact set"))
        .when(F.col("__each").isNull(), F.lit("no fact for this entity and relation"))
        .when(one["is"] == SAME, F.lit("matches the declared value"))
        .when(one["is"] == OTHER, F.lit("differs from the declared value"))
        .when(one["is"] == QUOTED, F.lit("the source states the whole claim"))
        .when(one.isNotNull(), F.lit("can't be compared with the declared value"))
        .when(hit.isNotNull(), F.concat(F.lit("depends on "), keys))
        .when(differ, F.lit("differs from the value under every condition"))
        .otherwise(F.concat(F.lit("undecided under "), keys))
    )
    declared, source = F.coalesce(one["o"], hit["o"], joined), F.coalesce(one["source"], hit["source"], first["source"], F.lit(""))
    return {"__each": each}, {"__one": chosen(F.col("__each"), F.col("context"))}, {"__hit": found}, {"status": status, "declared": declared, "source": source, "reason": reason}
