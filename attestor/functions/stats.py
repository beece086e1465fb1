"""Rates and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 1) without trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    centre, half = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    scale = 1 + z * z / n
    return F.coalesce(F.greatest(F.lit(0.0), (centre - half) / scale), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), (centre + half) / scale), F.lit(1.0))


def with_wilson(df: DataFrame, k: str, n: str) -> DataFrame:
    low, high = wilson(F.col(k), F.col(n))
    return df.withColumn("lo", low).withColumn("hi", high)


def cluster_wilson(df: DataFrame, by: list[str], cluster: str, flag: str) -> DataFrame:
    """A cluster fails if any of its trials does: flags folded per cluster, then counted per group; both partly before the shuffle."""
    folded = df.groupBy(*by, cluster).agg(F.max(F.col(flag).cast("int")).alias("failed"))
    return with_wilson(folded.groupBy(*by).agg(F.sum("failed").alias("k"), F.count(F.lit(1)).alias("n")), "k", "n")


def rate(condition: Column, among: Column) -> Column:
    """Share of the rows among which condition holds; null where there are none."""
    return F.try_divide(F.count_if(condition & among), F.count_if(among))
