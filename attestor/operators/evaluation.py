"""Evaluation: folds of trials, leak and over-block, span labels, splits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.stats import rate, with_wilson


def trial_status(status: Column) -> Column:
    """BLOCK if any claim is blocked, else VERIFIED if any is verified, else HELD: an aggregate."""
    return F.when(F.bool_or(status == "BLOCK"), F.lit("BLOCK")).when(F.bool_or(status == "VERIFIED"), F.lit("VERIFIED")).otherwise(F.lit("HELD"))


def sentence_policy(asserts: Column, statuses: Column) -> Column:
    """SKIP what asserts nothing, HELD without triples, BLOCK if any is contradicted, PASS if all are verified, else HELD."""
    return (
        F.when(~asserts, F.lit("SKIP")).when(F.size(statuses) == 0, F.lit("HELD")).when(F.array_contains(statuses, "CONTRADICTED"), F.lit("BLOCK"))
        .when(F.forall(statuses, lambda s: s == "VERIFIED"), F.lit("PASS")).otherwise(F.lit("HELD"))
    )


def leak_overblock(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates over rows (hallucinated, passed, skipped): hallucinated ones that passed, faithful ones that didn't; skipped ones don't count."""
    bad, good = F.col("hallucinated") & ~F.col("skipped"), ~F.col("hallucinated") & ~F.col("skipped")
    return rows.groupBy(*by).agg(rate(F.col("passed"), bad).alias("leak"), rate(~F.col("passed"), good).alias("overblock"), F.count_if(bad).alias("n_bad"), F.count_if(good).alias("n_good"))


def accuracy(rows: DataFrame, by: list[str], flag: str = "correct") -> DataFrame:
    """k, n, rate and Wilson bounds of a flag."""
    counted = rows.groupBy(*by).agg(F.count_if(F.col(flag)).alias("k"), F.count(F.lit(1)).alias("n"))
    return with_wilson(counted.withColumn("rate", F.col("k") / F.col("n")), "k", "n")


def label_sentences(sentences: DataFrame, spans: DataFrame, on: str) -> DataFrame:
    """sentences (on, s, e) with overlaps: whether a half-open span (on, s, e) meets it. Spans are gathered per document."""
    own = spans.groupBy(on).agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    hit = F.exists("spans", lambda x: (x["s"] < F.col("e")) & (x["e"] > F.col("s")))
    return sentences.join(own, on, "left").select(*sentences.columns, F.coalesce(hit, F.lit(False)).alias("overlaps"))


def report(rows: DataFrame) -> str:
    """Markdown of a whole result table, which the driver takes row by row."""
    own = rows.toLocalIterator()
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}"
    cell = lambda x: "n/a" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    return "\n".join([head, *(f"| {' | '.join(map(cell, r))} |" for r in own)])
