"""Connected components over an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import HOT, join_hot, materialised, release

#: Parts into which the nodes of one label are dealt.
PARTS = 8


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges(a, b): label is the smallest node that can be reached from node.

    Every round takes the smallest label among the neighbours (partially aggregated before the shuffle, so that a hub's
    edges never meet in one task) and then the label of the label, so that a path of n edges takes about log2(n) rounds.
    Labels are written to the shared folder each round, which cuts the lineage and survives a lost executor.
    """
    # Both directions come from one evaluation of the links: which links of a group are given may depend on the order in which
    # rows arrive, and the directions of two evaluations need not belong together.
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = materialised(edges.where("a <> b").select(F.inline(F.array(way("a", "b"), way("b", "a")))).distinct(), "edges")
    labels = materialised(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    # A hub's edges and the nodes of a large component share a key of the two joins below: the first is split by hubs, if there
    # are any, the second by a part of each node's hash, for which labels are repeated.
    degrees = both.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    hubs = (degrees.agg(F.max("n")).first()[0] or 0) > HOT
    while True:
        of_b = labels.withColumnRenamed("node", "b")
        met = join_hot(both, of_b.join(degrees, "b"), "b") if hubs else both.join(of_b, "b")
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"), F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int").alias("part"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        done = materialised(least.join(up, ["label", "part"]).select("node", "old", F.least("label", "up").alias("label")), "labels")
        changed = done.where("label <> old").limit(1).count()
        release(labels)
        labels, path = done.select("node", "label"), done.materialised_at
        labels.materialised_at = path
        if not changed:
            release(both)
            return labels
