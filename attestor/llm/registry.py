"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Name and module of each query.
OPERATORS = (
    ("op1_pii", "pii"),
    ("op2_nearest", "ann"),
    ("op3_warc", "warc"),
    ("op4_quality", "quality"),
    ("op5_licences", "licences"),
    ("op6_simple8b", "simple8b"),
    ("op7_simhash_dedup", "simhash"),
    ("op8_mixing", "mixing"),
    ("op9_decontaminate", "decontaminate"),
    ("op10_secrets", "secrets"),
)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: import_module(f"attestor.llm.{module}").query for name, module in OPERATORS}
    return found | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: sql for name, module in OPERATORS if (sql := getattr(import_module(f"attestor.llm.{module}"), "SQL", None))}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
