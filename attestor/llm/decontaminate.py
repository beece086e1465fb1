"""Benchmark decontamination: Wu-Manber search for every 13-word window of the benchmark in all texts.

Texts become lower-case words joined by single spaces, so that a window is a byte string with a space at either end. For the
patterns of a length class, with m the shortest length, a table holds for the hash of each block of up to 8 bytes how far a
window of m bytes that ends in the block can move on. Where that is 0, the block ends the first m bytes of some pattern;
buckets by those last bytes and the first ones select the patterns that are then compared in full. Many stretches of the
text move in step, one vector operation each.
"""

from __future__ import annotations

from collections import defaultdict
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from attestor.llm.common import per_batch, table

WORDS = 13
#: Most bytes of benchmark text in one pass; a larger benchmark takes more passes over each batch of texts, one after another.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are searched at once, and bytes per stretch.
BATCH_BYTES, STRETCH = 8 << 20, 2048

#: Letters, digits and all bytes from 0x80 stay, A-Z become a-z, others become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BITS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def fold(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows(words: list[bytes], size: int = WORDS) -> list[tuple[bytes, int]]:
    """The windows of an item as byte strings, with their numbers of words."""
    if not words:
        return []
    n = min(size, len(words))
    return [(b" " + b" ".join(words[i : i + n]) + b" ", n) for i in range(len(words) - n + 1)]


def _load(buffer: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The size (up to 8) bytes from each position as one number. The buffer has 8 spare bytes."""
    words = np.ndarray(len(buffer) - 7, "<u8", buffer.data, strides=(1,))
    return words[at] & np.uint64((1 << 8 * size) - 1)


def _hash(block: np.ndarray) -> np.ndarray:
    return ((block * MULTIPLIER) >> np.uint64(64 - BITS)).astype(np.int64)


class LengthClass:
    """Tables for patterns of which the shortest has m bytes."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.size = size = min(8, m)
        self.shift = np.full(1 << BITS, min(m - size + 1, 65535), np.uint16)
        heads = np.zeros((len(patterns), m + 8), np.uint8)
        heads[:, :m] = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        flat, first = heads.ravel(), np.arange(len(patterns)) * (m + 8)
        for end in range(size, m + 1):
            np.minimum.at(self.shift, _hash(_load(flat, first + end - size, size)), min(m - end, 65535))
        self.keys = np.unique(self._key(_load(flat, first, size), _load(flat, first + m - size, size)))
        self.by_head: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            self.by_head[p[:m]].append(p)

    @staticmethod
    def _key(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        return (prefix * MULTIPLIER) ^ (suffix >> np.uint64(7)) ^ (suffix << np.uint64(57))

    def find(self, buffer: np.ndarray, raw: bytes, n: int) -> list[tuple[int, bytes]]:
        """Start and pattern of all occurrences in the first n bytes."""
        m, size = self.m, self.size
        if n < m:
            return []
        cuts = np.arange(m, n + 1, STRETCH)
        at, stop = cuts.copy(), np.minimum(cuts + STRETCH, n + 1)  # ends of the windows
        maybe = []
        while len(at):
            move = self.shift[_hash(_load(buffer, at - size, size))].astype(np.int64)
            hit = move == 0
            if hit.any():
                maybe.append(at[hit] - m)
            at = at + np.maximum(move, 1)
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        if not maybe:
            return []
        start = np.concatenate(maybe)
        key = self._key(_load(buffer, start, size), _load(buffer, start + m - size, size))
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = []
        for s in start[self.keys[place] == key].tolist():
            for p in self.by_head.get(raw[s : s + m], ()):
                if raw.startswith(p, s):
                    found.append((s, p))
        return found


class Matcher:
    """All windows of a block of benchmark items, in classes of lengths within a factor of two."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int = WORDS):
        self.items: dict[bytes, set[str | None]] = defaultdict(set)
        self.words: dict[bytes, int] = {}
        for item, text in items:
            for p, n in windows(fold(text), size):
                self.items[p].add(item)
                self.words[p] = n
        by_length = defaultdict(list)
        for p in self.words:
            by_length[len(p).bit_length()].append(p)
        self.classes = [LengthClass(x) for x in by_length.values()]

    def find(self, docs: list[list[bytes]]) -> list[list[tuple[int, bytes]]]:
        """First word and pattern of the occurrences in each document, given its words."""
        found: list[list[tuple[int, bytes]]] = [[] for _ in docs]
        begin = 0
        while begin < len(docs):
            end, parts, total = begin, [], 0
            while end < len(docs) and (end == begin or total < BATCH_BYTES):
                parts.append(b" " + b" ".join(docs[end]) + b" ")
                total += len(parts[-1]) + 1
                end += 1
            raw = b"\n".join(parts)
            buffer = np.frombuffer(raw + bytes(8), np.uint8)
            offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
            spaces: dict[int, np.ndarray] = {}
            for c in self.classes:
                for s, p in c.find(buffer, raw, len(raw)):
                    d = int(np.searchsorted(offsets, s, "right")) - 1
                    if d not in spaces:
                        spaces[d] = np.flatnonzero(np.frombuffer(parts[d], np.uint8) == 32)
                    found[begin + d].append((int(np.searchsorted(spaces[d], s - offsets[d])), p))
            begin = end
        return found


_matchers: dict[str, Matcher] = {}


def _matcher(block, size: int) -> Matcher:
    """One matcher for each block and worker process."""
    if block.id not in _matchers:
        _matchers.clear()
        _matchers[block.id] = Matcher(block.value, size)
    return _matchers[block.id]


class _Block:
    """A broadcast block of items with an identity that survives pickling."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> list[tuple[str | None, bytes]]:
        return self.broadcast.value


def _blocks(benchmark: DataFrame) -> list[_Block]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    sc, blocks, own, size = benchmark.sparkSession.sparkContext, [], [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").toLocalIterator():
        own.append((r.item_id, bytes(r.text)))
        size += len(r.text)
        if size >= BLOCK_BYTES:
            blocks.append(_Block(sc.broadcast(own), uuid4().hex))
            own, size = [], 0
    return [*blocks, _Block(sc.broadcast(own), uuid4().hex)]


def without_overlap(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """docs without the rows in which a full window of the benchmark occurs, or which are contaminated() by shorter items too.

    Rows are searched where they are read and keep all their columns; with one block of the benchmark there is one pass. From
    block to block goes which words are hit, or that a row is out; rows are dropped after the last block.
    """
    names, fields, blocks = docs.columns, docs.schema, _blocks(benchmark)
    state = StructType([*fields, StructField("__hit", BinaryType()), StructField("__out", BooleanType())])
    for i, block in enumerate(blocks):
        def run(batches, block=block, first=not i, last=i == len(blocks) - 1):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    matcher = _matcher(block, size)
                    texts = [fold((t or "").encode()) for t in part.column(names.index("text")).to_pylist()]
                    before = [[None] * len(texts)] * 2 if first else [part.column(len(names) + k).to_pylist() for k in (0, 1)]
                    hits, outs = [], []
                    for words, found, hit, out in zip(texts, matcher.find(texts), *before, strict=True):
                        h = np.zeros(len(words) if found else 0, np.uint8) if hit is None else np.frombuffer(hit, np.uint8).copy()
                        for begin, p in found:
                            h[begin : begin + matcher.words[p]] = 1
                        full = any(matcher.words[p] == size for _, p in found)
                        n = int(h.sum())
                        outs.append(bool(out or full or (n and 20 * n >= len(words))))
                        hits.append(h.tobytes() if n and not outs[-1] else None)
                    own = pa.RecordBatch.from_arrays(part.columns[: len(names)], schema=pa.schema(list(part.schema)[: len(names)]))
                    if last:
                        yield own.filter(pa.array([not x for x in outs], pa.bool_()))
                    else:
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(hits, pa.binary()), pa.array(outs, pa.bool_())], schema=pa.schema([*own.schema, ("__hit", pa.binary()), ("__out", pa.bool_())]))

        docs = docs.mapInArrow(run, fields if i == len(blocks) - 1 else state)
    return docs


def overlaps(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, n_words, n_hit, n_full, items.

    A word inside any occurrence of a window of benchmark (item_id, text) is hit; n_full counts the words hit by windows of the
    full size. An item with fewer words is one window; without words, none. items: distinct ids, as strings in order, of the
    items with occurring windows; an item without an id counts for words, not as an item. Null or blank texts have no words.
    Repeated rows stay; other columns aren't read.
    """
    blocks = _blocks(benchmark)
    state = "doc_id long, text binary, hit binary, full binary, items array<string>"

    def search(block: _Block, first: bool):
        def f(batch: pa.RecordBatch) -> dict:
            matcher = _matcher(block, size)
            docs = [fold(t) for t in batch.column(1).to_pylist()]
            hits, fulls, names = [], [], []
            before = [[None] * len(docs)] * 3 if first else [batch.column(i).to_pylist() for i in (2, 3, 4)]
            for words, found, hit, full, items in zip(docs, matcher.find(docs), *before, strict=True):
                h = np.frombuffer(hit, np.uint8).copy() if hit is not None else np.zeros(len(words) if found else 0, np.uint8)
                g = np.frombuffer(full, np.uint8).copy() if full is not None else h.copy()
                if found and not len(h):
                    h, g = np.zeros(len(words), np.uint8), np.zeros(len(words), np.uint8)
                own = set(items or ())
                for at, p in found:
                    h[at : at + matcher.words[p]] = 1
                    if matcher.words[p] == size:
                        g[at : at + size] = 1
                    own |= matcher.items[p] - {None}
                hits.append(h.tobytes())
                fulls.append(g.tobytes())
                names.append(sorted(own))
            return {"doc_id": batch.column(0), "text": batch.column(1), "n_words": [len(w) for w in docs], "hit": hits, "full": fulls, "items": names}

        return f

    def count(columns: dict) -> dict:
        return {
            "doc_id": columns["doc_id"],
            "n_words": columns["n_words"],
            "n_hit": [sum(h) for h in columns["hit"]],
            "n_full": [sum(h) for h in columns["full"]],
            "items": columns["items"],
        }

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    for i, b in enumerate(blocks[:-1]):
        out = per_batch(out, state, search(b, not i), 512)
    last = search(blocks[-1], len(blocks) == 1)
    return per_batch(out, "doc_id long, n_words long, n_hit long, n_full long, items array<string>", lambda batch: count(last(batch)), 512)


def contaminated() -> F.Column:
    """At least one hit word, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )
