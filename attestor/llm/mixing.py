"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source's target is its weight's share of all words, at most EPOCHS times its own words, the excess going to the others by
weight. The words up to the target are taken in complete epochs of all documents first; what remains is filled in the order
of the keys -ln(u) / w, with u from a hash of the document and w its quality weight, so that each prefix of that order is a
weighted sample without replacement.

No source's documents meet in one task: keys fall into many ranges of equal expected weight, one row of sums for each source
and range gives where each range begins, and only the documents inside a range are summed one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import materialised, table

#: Weights of the sources in their order, repeating, and the most epochs of a source.
WEIGHTS, EPOCHS = (5, 2, 1), 3
#: Expected documents in one range of keys.
RANGE_DOCS = 4096
SEED = 17


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Between 0.25 and 1: the share of characters that are neither digits nor marks, squared."""
    marks = "0123456789!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"
    share = F.length(F.translate(text, marks, "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(0.25 + 0.75 * share * share, F.lit(0.25))


def targets(sources: DataFrame) -> DataFrame:
    """source_key, source_size, target from one row a source: source_key, source, source_size, n.

    With r = EPOCHS * size / weight, a source is full if the level at which all sources with smaller r are full lies above its
    r; the level is what is left of all words over what is left of all weights.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1)
    rows = sources.withColumn("weight", weight.cast("double")).withColumn("most", EPOCHS * F.col("source_size").cast("double"))
    rows = rows.withColumn("r", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("r", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level).withColumn("full", F.col("r") <= F.col("level"))
    share = F.min(F.when(~F.col("full"), F.struct("r", "source_key", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * share)
    return rows.select("source_key", "source_size", target.alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs (doc_id, text, source).

    taken counts words: complete epochs and, for documents before the target in the order of keys, one more; of the document at
    the target only the words up to it. copies counts whole rows, where that document is taken if half of it fits. Null sources are one source, the last; null texts have size 0;
    repeated rows stay and are sampled on their own; rows without a doc_id are hashed by their text alone. An empty table
    gives an empty result. The same rows give the same result whatever their order or partitions.
    """
    return _mix(docs)


def _mix(docs: DataFrame, carried: tuple[Column, ...] = ()) -> DataFrame:
    """mix() with further columns of each row."""
    hashed = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text"))
    u = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(1 << 53)
    source_key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), source_key.alias("source_key"), words(F.col("text")).alias("size"),
        (-F.log(u) / quality(F.col("text"))).alias("key"), hashed.alias("hash"), *carried,
    )
    rows = materialised(rows, "mix")
    sources = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    count = rows.count()
    # k / (1 + k) spreads the keys: no range holds more than a few times the mean.
    place = F.floor(F.col("key") / (1 + F.col("key")) * (1 + count // RANGE_DOCS)).cast("long")
    rows = rows.withColumn("range", place)
    epochs = F.floor(F.try_divide(F.col("target"), F.col("source_size"))).cast("long")
    goal = targets(sources).withColumn("epochs", F.coalesce(epochs, F.lit(0))).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = rows.groupBy("source_key", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    placed = rows.join(sums.join(goal, "source_key"), ["source_key", "range"])
    inside = Window.partitionBy("source_key", "range").orderBy("key", "hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("base") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = placed.withColumn("left", left)
    more = ((F.col("left") > 0) & (F.col("left") >= F.col("size") / 2)).cast("long")
    part = F.least(F.greatest(F.floor("left"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), (F.col("epochs") + more).alias("copies"), *rows.columns[6:-1])


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; rows without a doc_id and with a repeated one are rows of their own."""
    taken = _mix(docs, (F.struct(*docs.columns).alias("row"),)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).drop("copies")
