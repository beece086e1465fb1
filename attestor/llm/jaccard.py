"""Near copies by SimHash; the exact Jaccard similarity of shingle sets then says which of the pairs that it finds are links.

A text's set holds the 64-bit hashes of its shingles. Texts with one set are one node. The SimHash fingerprint of a set has
64 WORDS bits: a bit is set if it is in over half of the hashes, mixed anew for each word. Two sets of equal size at a
similarity s have the cosine 2 s / (1 + s), so of their bits the share arccos(2 s / (1 + s)) / pi differs on average: 0.15 at
0.8. Fingerprints within `most_bits` of each other are sought by simhash.links, which lets pairs of that share meet. The nodes
of each component of these loose links then meet with their texts, and only pairs that are verified on the whole sets are
links. A component of many or long texts is dealt out in blocks, one task for each pair of blocks, so every pair of it meets
in some task and no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import materialised, per_batch, release
from attestor.llm.components import components
from attestor.llm.simhash import _binary, _distance, _mix, _words, links, majority_bits

#: 64-bit words of a fingerprint, and standard deviations of the number of differing bits that a loose link may have above the mean.
WORDS, ABOVE = 4, 4.75
#: Buckets of fingerprints up to PAIRS are compared in vectors; larger ones than SEARCHED are dealt out.
PAIRS, SEARCHED = 256, 20_000
#: Most nodes and bytes of text in a block.
BLOCK, BLOCK_BYTES = 2000, 16 << 20
#: Hashes that are sought in a set at once, but for a longer set.
SOUGHT = 1 << 18

FLIP = np.random.default_rng(80).integers(0, 1 << 63, WORDS, dtype=np.uint64)


def differing(similarity: tuple[int, int]) -> float:
    """Share of bits that differ on average at a similarity part / whole."""
    part, whole = similarity
    return acos(2 * part / (part + whole)) / pi


def most_bits(similarity: tuple[int, int]) -> int:
    """Most differing bits of a loose link."""
    p, bits = differing(similarity), 64 * WORDS
    return int(bits * p + ABOVE * sqrt(bits * p * (1 - p)))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text with fewer words is one shingle, without words none."""
    from xxhash import xxh64_digest

    w = (text or b"").lower().split()
    if len(w) <= words:
        own = [b" ".join(w)] if w else []
    else:
        own = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, own)), ">u8").astype(np.uint64))


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """WORDS uint64 for each set; those of an empty set are 0."""
    flat, sizes = np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)
    return np.stack([majority_bits(_mix(flat ^ x), sizes) for x in FLIP], axis=1)


def in_common(own: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes of each of the sets, none of them empty, are in own."""
    sizes = np.array([len(x) for x in sets], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SOUGHT)) + 1
    out = []
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sets)], strict=True):
        flat = np.concatenate(sets[s:e])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        out.append(np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[s:e]) - sizes[s:e]))
    return np.concatenate(out)


def search(words: np.ndarray, most: int, verify) -> list[tuple[int, int]]:
    """Links that connect all rows which are within so many bits and which verify(row, others) confirms."""
    found, left = [], np.arange(len(words))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _distance(words[left], words[x]) <= most
            if near.any():
                near[near] = verify(x, left[near])
            found += [(x, y) for y in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return found


def _grouped(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    """Tables of whole groups of the first column, by which the batches are sorted; a new one begins at so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    n = taken = 0
    for batch in batches:
        held.append(batch)
        n, taken = n + batch.num_rows, taken + batch.nbytes
        if n < rows and taken < size:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        key = whole.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield whole.slice(0, cut)
            whole = whole.slice(cut).combine_chunks()
        held = whole.to_batches()
        n, taken = whole.num_rows, sum(b.nbytes for b in held)
    if n:
        yield pa.Table.from_batches(held)


def verified_links(texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """a, b: links that join every two nodes of a group whose sets are as similar; texts: group, node, fp, text."""
    part, whole = similarity
    most = most_bits(similarity)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, 4096, 32 << 20):
            group, node, text = t.column(0).to_numpy(), t.column(1).to_pylist(), t.column(3)
            fps = _words(t.column(2).combine_chunks(), WORDS)
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            a, b = [], []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s < 2:
                    continue
                sets = [shingle_set(x, words) for x in text.slice(s, e - s).to_pylist()]
                sizes = np.array([len(x) for x in sets], np.int64)

                def verify(x: int, others: np.ndarray, sets=sets, sizes=sizes) -> np.ndarray:
                    both = in_common(sets[x], [sets[y] for y in others])
                    return whole * both >= part * (sizes[others] + sizes[x] - both)

                for x, y in search(fps[s:e], most, verify):
                    a.append(node[s + x])
                    b.append(node[s + y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return texts.repartition("group").sortWithinPartitions("group").mapInArrow(f, "a binary, b binary")


def text_key(text: F.Column) -> F.Column:
    """Digest of a text, null like the empty one."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit("").cast("binary"))))


def near_copies(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """doc_id, text_key, label for every row of docs (doc_id, text): rows have one label if links join their texts.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least part / whole. Null and blank texts have
    the empty set, which is one node.
    """
    def sketch(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, words) for t in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "text_key": batch.column(1), "bytes": [len(t or b"") for t in batch.column(2).to_pylist()], "n": [len(s) for s in sets], "node": [blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "fp": _binary(set_fingerprints(sets))}

    rows = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary"))
    own = materialised(per_batch(rows, "doc_id long, text_key binary, bytes long, n long, node binary, fp binary", sketch, 256), "sketches")
    first = F.min(F.struct("text_key", "doc_id")).alias("first")
    by_set = own.where("n > 0").groupBy("node").agg(first, F.max("bytes").alias("bytes"), F.first("fp").alias("fp"))
    nodes = materialised(by_set.select("node", "first.text_key", F.col("first.doc_id").alias("rep"), "bytes", "fp"), "nodes")
    fps = materialised(nodes.select("fp").distinct(), "fingerprints")
    loose = components(links(fps, most_bits(similarity), 64 * WORDS, differing(similarity), PAIRS, SEARCHED))
    release(fps)
    # Sets with one fingerprint are linked too; what is alone needs no text.
    labelled = nodes.join(loose.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES, F.lit(1))).cast("long")
    groups = labelled.groupBy("label").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1").drop("nodes")
    sizes = materialised(labelled.join(groups, "label").select("label", "node", "text_key", "rep", "fp", "blocks"), "groups")
    release(nodes)
    release(loose)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = sizes.select("label", "node", "text_key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node", "text_key", "fp", F.xxhash64("label", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"))
    # One row stands for a text, known by its doc_id too, so that the copies of a text aren't one task's.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    wanted = sizes.select(F.col("text_key").alias("of"), "rep")
    chosen = rows.join(wanted, (F.col("text_key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    texts = chosen.groupBy("text_key").agg(F.first("text").alias("text"))
    met = dealt.join(texts, "text_key").select("group", "node", "fp", "text")
    joined = components(verified_links(met, words, similarity))
    return own.select("doc_id", "text_key", "node").join(joined, "node", "left").select("doc_id", "text_key", F.coalesce("label", "node").alias("label"))
