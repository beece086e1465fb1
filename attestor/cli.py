"""Commands: python -m attestor.cli <command> --help. Paths are of any file system that Spark reads."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import stats
from attestor.operators import answers, datagen, triples, trials
from attestor.operators.factset import FactSet
from attestor.sources import files

SPLIT = "id string, split string, question string, s string, r string, o string, expected string, meta map<string, string>"
REPLY = "id string, transcript string, reply string"


def _table(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def bench(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scores a target over a split and writes its result object. Targets: echo, or recorded:<JSON lines of id, transcript, reply>."""
    kb = files.knowledge_base(spark, a.kb)
    examples = files.read_lines(spark, a.split, SPLIT)
    if a.limit:
        examples = examples.orderBy("id").limit(a.limit)
    if a.target == "echo":
        done = answers.echoed(examples)
    elif a.target.startswith("recorded:"):
        replies = files.read_lines(spark, a.target.removeprefix("recorded:"), REPLY)
        done = answers.tool_loop(examples, kb, lambda rows: rows.join(replies, ["id", "transcript"], "left").withColumn("reply", F.coalesce("reply", F.lit(""))), a.max_rounds)
    else:
        raise SystemExit(f"unknown target {a.target!r}")
    summary = answers.split_summary(answers.scored(answers.rechecked(done, kb)))
    files.write_contract(summary, f"{a.out.rstrip('/')}/{answers.safe_name(a.target)}__seed{a.seed}", a.target, a.seed, {"limit": str(a.limit)})
    _table(summary)


def splits(spark: SparkSession, a: argparse.Namespace) -> None:
    """Builds evaluation splits that aren't there yet; without names, lists them."""
    if not a.splits:
        print("\n".join(answers.SPLITS))
        return
    kb = files.knowledge_base(spark, a.kb)
    trained = files.read_covered(spark, a.trained) if a.trained else kb.limit(0)
    held = files.read_triples(spark, a.holdout) if a.holdout else kb.limit(0)
    for name in a.splits:
        built = datagen.build_split(name, f"{a.out.rstrip('/')}/{name}", kb, trained, held, a.n, a.seed, a.force)
        print(json.dumps({"split": name, "n": built.count()}))


def results(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prints the report of all result objects below a folder."""
    print(files.render_results(files.read_results(spark, a.results)))


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Training examples of all generators as JSON lines, and their counts."""
    kb = files.read_triples(spark, a.source, a.kb_limit)
    held = files.read_triples(spark, a.holdout) if a.holdout else kb.limit(0)
    counts = {"qa": a.limit, "chains": a.limit // 4, "idk_absent": a.limit // 4, "idk_holdout": a.limit // 5, "corrupt": a.limit // 5}
    files.write_lines(datagen.all_examples(kb, kb, held, counts, a.seed), a.out, "overwrite")
    _table(datagen.generator_counts(files.read_lines(spark, a.out, files.EXAMPLE)))


def build_kb(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ingests triples and prints the manifest."""
    print(json.dumps(files.ingest(spark, a.source, a.out, a.limit)))


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Counts valid examples and prints the others' lines; fails if there are any."""
    valid, n, bad = files.validate_examples(spark, a.path)
    print(json.dumps({"valid": valid, "total": n}))
    _table(bad)
    if valid < n:
        raise SystemExit(1)


def _trials(spark: SparkSession, a: argparse.Namespace) -> tuple[FactSet, DataFrame]:
    fs = FactSet.from_json(spark, a.domain)
    texts = files.read_lines(spark, a.texts, "trial string, condition string, entity string, relation string, text string")
    said = files.read_lines(spark, a.answers, "trial string, entity string, relation string, answer string, repair string") if a.answers else None
    return fs, trials.run(fs, texts, said)


def domain_bench(spark: SparkSession, a: argparse.Namespace) -> None:
    """Leaks, over-blocks and kinds of holds of recorded trials of a fact set."""
    fs, rows = _trials(spark, a)
    _table(trials.summary(rows.withColumn("domain", F.lit(fs.domain)), ["domain"]))
    _table(trials.hold_class(rows).where("hold is not null").groupBy("hold").agg(F.count(F.lit(1)).alias("n")))


def _answered(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    fs, rows = _trials(spark, a)
    rows = trials.states_other_value(rows.withColumn("__others", F.expr("cast(array() as array<string>)")), "text", "declared", "__others", "wrong")
    adjudicated = F.col("value").isNotNull()
    return rows.select(F.lit(fs.domain).alias("domain"), adjudicated.alias("asserted"), "wrong", adjudicated.alias("adjudicated"), F.lit(False).alias("unresolved"), (F.col("status") == "VERIFIED").alias("verified"), F.when(adjudicated, F.col("status")).alias("status"))


def coverage(spark: SparkSession, a: argparse.Namespace) -> None:
    """How many of the answers that assert something reached the gate."""
    _table(trials.routing_totals(_answered(spark, a), ["domain"]))


def pilot(spark: SparkSession, a: argparse.Namespace) -> None:
    """How many answers needed no review, and breaches."""
    _table(trials.pilot_totals(_answered(spark, a), ["domain"]))


def soak(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rules that verdicts on recorded trials break; fails if there are any."""
    fs, rows = _trials(spark, a)
    own = rows.where("value is not null").select("status", "entity", F.col("value").alias("claimed_value"), "declared", "source", F.lit(fs.fingerprint()).alias("factset_fingerprint"), F.col("text").alias("passage"), F.lit(True).alias("known"))
    broken = trials.violations(own, fs.normalise)
    _table(broken)
    if broken.take(1):
        raise SystemExit(1)


def policy(spark: SparkSession, a: argparse.Namespace) -> None:
    """Verdicts on claims (s, r, o) against a knowledge base, counted, with Wilson bounds of the verified."""
    counts = triples.verify(files.read_triples(spark, a.claims), files.knowledge_base(spark, a.kb)).agg(F.count_if(F.col("status") == "VERIFIED").alias("verified"), F.count(F.lit(1)).alias("n"))
    _table(stats.with_wilson(counts, "verified", "n"))


def holdout(spark: SparkSession, a: argparse.Namespace) -> None:
    """Triples split into a held-out part of exactly the asked size and the rest."""
    rows = datagen.held_out(files.read_triples(spark, a.source), a.size, a.seed)
    files.write_lines(rows.where("not held_out").drop("held_out"), f"{a.out.rstrip('/')}/train", "overwrite")
    files.write_lines(rows.where("held_out").drop("held_out"), f"{a.out.rstrip('/')}/holdout", "overwrite")


RECORDED = (("--domain", {"required": True}), ("--texts", {"required": True}), ("--answers", {}))
COMMANDS = {
    "bench": (bench, (("--target", {"default": "echo"}), ("--split", {"required": True}), ("--kb", {"required": True}), ("--out", {"required": True}), ("--limit", {"type": int, "default": 0}), ("--max-rounds", {"type": int, "default": answers.ROUNDS}), ("--seed", {"type": int, "default": 0}))),
    "splits": (splits, (("--splits", {"nargs": "*", "choices": answers.SPLITS}), ("--kb", {}), ("--trained", {}), ("--holdout", {}), ("--out", {}), ("--n", {"type": int, "default": 1000}), ("--seed", {"type": int, "default": 0}), ("--force", {"action": "store_true"}))),
    "results": (results, (("--results", {"required": True}),)),
    "generate": (generate, (("--source", {"required": True}), ("--out", {"required": True}), ("--limit", {"type": int, "default": 1000}), ("--kb-limit", {"type": int}), ("--holdout", {}), ("--seed", {"type": int, "default": 0}))),
    "build-kb": (build_kb, (("--source", {"required": True}), ("--out", {"required": True}), ("--limit", {"type": int}))),
    "validate": (validate, (("path", {}),)),
    "domain-bench": (domain_bench, RECORDED), "coverage": (coverage, RECORDED), "pilot": (pilot, RECORDED), "soak": (soak, RECORDED),
    "policy": (policy, (("--claims", {"required": True}), ("--kb", {"required": True}))),
    "holdout": (holdout, (("--source", {"required": True}), ("--out", {"required": True}), ("--size", {"type": int, "default": 1000}), ("--seed", {"type": int, "default": 0}))),
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="attestor")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        own = commands.add_parser(name, help=(f.__doc__ or "").splitlines()[0])
        for flag, settings in options:
            own.add_argument(flag, **settings)
    a = parser.parse_args(arguments)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("attestor").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
