"""Readers and writers of claims, triples, examples, results and reports."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.datagen import is_valid
from attestor.operators.triples import manifest, relation_histogram

TRIPLE = "s string, r string, o string"
EXAMPLE = "id string, generator string, messages array<struct<role: string, content: string>>, plain struct<question: string, answer: string>, meta map<string, string>"
RESULT = (
    "split string, target string, n long, correct long, accuracy double, ci95 array<double>, config map<string, string>, "
    "metrics struct<abstention_rate: double, confident_wrong_rate: double, gate_claims_checked: long, gated_hallucination_rate: double, gate_verdict_counts: map<string, long>>, notes string, timestamp string"
)
#: What counts as a fact in a document, and folders that hold no documents.
NUMERIC = r"\$[0-9][0-9,]*(?:\.[0-9]+)?[KMB]?|[0-9]+(?:\.[0-9]+)?%|\b[0-9]+(?:\.[0-9]+)?\s*(?:days?|months?|years?|hours?|users?|seats?)\b"
SKIPPED = ("node_modules", "vendor", ".git", "dist", "build", "target", "__pycache__", ".venv", "site-packages")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line: the lines that aren't blank, with the order of lines within a file."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return rows.where(F.trim("value") != "")


def first_lines(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows (of those with file and line) by file name, then line."""
    return rows.orderBy("file", "line").limit(n)


def read_triples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines with s, r and o as strings; blank and torn lines are left out. With a limit, the first lines in order of files
    and lines."""
    rows = _lines(spark, path).withColumn("x", F.from_json("value", TRIPLE)).where("x.s is not null and x.r is not null and x.o is not null")
    return (rows if limit is None else first_lines(rows, limit)).select("x.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON lines under a schema; a torn line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_covered(spark: SparkSession, path: str) -> DataFrame:
    """Distinct source triples in the meta of training examples; torn lines are left out."""
    rows = spark.read.text(path).select(F.from_json("value", f"meta struct<source_triple: struct<{TRIPLE.replace(' ', ': ').replace(',:', ',')}>>").alias("x"))
    return rows.select("x.meta.source_triple.*").where("s is not null").distinct()


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return _lines(spark, path).count()


def read_spans(spark: SparkSession, responses: str, sources: str, task: str | None = None, split: str | None = None, limit: int | None = None) -> DataFrame:
    """Responses with their source text and labelled spans: two JSON scans and an equi-join on source_id; with a limit, the first
    by source_id, model and response."""
    own = spark.read.schema("source_id string, model string, split string, response string, labels array<struct<start: int, end: int>>").json(responses)
    texts = spark.read.schema("source_id string, task_type string, source_info string").json(sources)
    own = own.where(F.col("split") == split) if split else own
    texts = texts.where(F.col("task_type") == task) if task else texts
    rows = own.join(texts, "source_id")
    return rows if limit is None else rows.orderBy("source_id", "model", "response").limit(limit)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path, built and written first where there is none."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


_kept: dict[str, DataFrame] = {}


def knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """The table at path, cached under its path for the session."""
    if path not in _kept:
        _kept[path] = spark.read.parquet(path).cache()
    return _kept[path]


def forget_knowledge_bases() -> None:
    """Drops what knowledge_base() keeps."""
    for df in _kept.values():
        df.unpersist()
    _kept.clear()


def ingest(spark: SparkSession, source: str, target: str, limit: int | None = None) -> dict:
    """Triples of JSON lines as a table without repeats, clustered by subject, with a manifest beside it that is returned."""
    read_triples(spark, source, limit).distinct().repartition("s").sortWithinPartitions("s", "r").write.mode("overwrite").parquet(target)
    kb = spark.read.parquet(target)
    counts = manifest(kb).first()
    told = {"facts": counts.facts, "relations": counts.relations, "entities": counts.entities, "histogram": {r.r: r.n for r in relation_histogram(kb).collect()}}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{target.rstrip('/')}.manifest")
    return told


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines."""
    rows.write.mode(mode).json(path)


def write_once(rows: DataFrame, path: str, force: bool = False) -> bool:
    """Writes rows as JSON lines unless something is at path; force replaces it. Whether it wrote."""
    there = exists(rows.sparkSession, path)
    if force or not there:
        rows.write.mode("overwrite").json(path)
    return force or not there


def write_routed(rows: DataFrame, public: str, private: str, mode: str = "errorifexists") -> None:
    """Rows of private domains to a folder of their own, as JSON lines; mode ignore keeps what is there, overwrite replaces it."""
    rows.where(~F.col("private")).drop("private").write.mode(mode).json(public)
    rows.where(F.col("private")).drop("private").write.mode(mode).json(private)


def write_contract(summary: DataFrame, path: str, target: str, seed: int, config: dict[str, str] | None = None) -> None:
    """One JSON object a split from answers.split_summary: counts, accuracy with its bounds, metrics, configuration and time."""
    metrics = F.struct("abstention_rate", "confident_wrong_rate", F.col("claims_checked").alias("gate_claims_checked"), "gated_hallucination_rate", F.col("verdict_counts").alias("gate_verdict_counts"))
    none = F.when(F.col("claims_checked") == 0, F.lit("no claims could be checked, so the gated rate means nothing")).otherwise(F.lit(""))
    told = F.create_map(*(F.lit(x) for kv in ({"seed": str(seed)} | (config or {})).items() for x in kv))
    rows = summary.select("split", F.lit(target).alias("target"), "n", "correct", "accuracy", F.array("lo", "hi").alias("ci95"), told.alias("config"), metrics.alias("metrics"), none.alias("notes"), F.lit(datetime.now(timezone.utc).isoformat()).alias("timestamp"))
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All result objects below path, one a line or one a file; what isn't one is left out."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value")
    files = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path).where(F.contains(F.trim("value"), F.lit("\n"))).select("value")
    rows = lines.union(files).select(F.from_json("value", RESULT).alias("x")).select("x.*").where("split is not null and target is not null and n is not null")
    return rows.dropDuplicates(["split", "target", "timestamp"])


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.2%}"


def render_results(results: DataFrame) -> str:
    """A Markdown report of result objects: a table a split, best accuracy first, with notes; every result is in it."""
    by: dict[str, list] = {}
    for r in results.orderBy("split", F.desc("accuracy"), "target").toLocalIterator():
        by.setdefault(r.split, []).append(r)
    out = ["# Results", ""]
    for split, rows in by.items():
        out += [f"## {split}", "", "| Target | Accuracy (95% interval) | n | Gated hallucination rate |", "|-|-|-|-|"]
        notes = []
        for r in rows:
            low, high = r.ci95 or (r.accuracy, r.accuracy)
            gated = r.metrics.gated_hallucination_rate if r.metrics else None
            checked = (r.metrics.gate_claims_checked if r.metrics else 0) or 0
            out.append(f"| {r.target} | {percent(r.accuracy)} ({percent(low)} to {percent(high)}) | {r.n} | {percent(gated) if gated is not None else f'n/a ({checked} claims)'} |")
            if split == "unknowable" and r.metrics and r.metrics.confident_wrong_rate is not None:
                notes.append(f"- {r.target}: {percent(r.metrics.confident_wrong_rate)} confident answers to what can't be known")
            if r.notes:
                notes.append(f"- {r.target}: {r.notes}")
        out += ["", *notes, ""] if notes else [""]
    return "\n".join(out)


def documents_in_hash_order(spark: SparkSession, path: str, most_bytes: int, least_facts: int = 0, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, text, facts of the .md and .txt files below path with at most so many bytes and at least so many numeric facts, not
    in folders of dependencies nor named in exclude, in the order of their paths' SHA-256."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= most_bytes)
    parts = F.split("path", "/")
    rows = rows.where(F.lower("path").rlike(r"\.(md|txt)$") & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))))
    if exclude:
        rows = rows.where(~F.element_at(parts, -1).isin(*exclude))
    rows = rows.select("path", F.col("content").cast("string").alias("text")).withColumn("facts", F.regexp_count("text", F.lit(NUMERIC)))
    return rows.where(F.col("facts") >= least_facts).orderBy(F.sha2("path", 256))


def validate_examples(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """Valid and all examples in JSON lines, and the lines that aren't valid."""
    rows = _lines(spark, path).withColumn("x", F.from_json("value", EXAMPLE))
    sound = F.coalesce(is_valid(F.col("x.messages")) & F.col("x.id").isNotNull() & F.col("x.generator").isNotNull(), F.lit(False))
    rows = rows.withColumn("valid", sound)
    counts = rows.agg(F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("n")).first()
    return counts.valid, counts.n, rows.where("not valid").select("file", "line", "value")
