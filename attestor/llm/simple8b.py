"""Token ids in Simple-8b words: 64 bits hold a 4-bit selector and as many equally wide ids as fit.

A shard file holds a header, a directory of documents, offsets of blocks and the blocks:

    8 bytes  magic "S8BSHARD"
    int64    shard number, documents, ids, blocks, words
    int64[]  per document: doc_id; then numbers of ids; then null marks (1: the doc_id is null)
    int64[]  per block: its first word; a block holds BLOCK ids (the last one may hold fewer)
    uint64[] words, least significant id first
    8 zero bytes

Selector s < 14 packs COUNTS[s] ids of 60 // COUNTS[s] bits; selector 15 is the escape: the next word is one id of 64 bits.
A word never reaches over a block, so each block decodes alone.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.llm.common import arrow_batches, materialised, per_batch, read_binary_files, shared_path, table, write_binary_files

#: Ids in a word for each selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 1024
#: Most ids of one shard file; a longer document has a file of its own.
SHARD_IDS = 1 << 20
MAGIC = b"S8BSHARD"
END_ID = 2
#: Chunks whose ids a worker keeps: those that it met first, so the frequent ones.
CACHE = 400_000
#: Rows in a batch between the JVM and a worker while shards are written; texts are long, and both sides hold a batch.
BATCH_ROWS = 1000


def _widths() -> list[int]:
    """Bits of an id for each selector, ascending."""
    return [60 // c for c in COUNTS]


def _limits() -> np.ndarray:
    """For each width the first id that is too wide."""
    return np.array([1 << w for w in _widths()], np.uint64)


@lru_cache(maxsize=1)
def _narrow() -> np.ndarray:
    """How many widths are too narrow for each id below 65,536."""
    return np.searchsorted(_limits(), np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of uint64 ids, and the first word of each block; all blocks advance together."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(n, dtype=np.int32) % BLOCK
    room = np.minimum(BLOCK - place, np.arange(n, 0, -1, dtype=np.int32)).astype(np.uint16)  # ids left in the block
    # How many of the widths, from the narrowest, are too narrow for the id.
    need = _narrow()[ids.astype(np.uint16)] if ids.max() < 1 << 16 else np.searchsorted(_limits(), ids, "right").astype(np.uint8)
    # The selector at each id: the last one, with counts rising, whose window stays in the block and has no id too wide. If a
    # count doesn't fit, no larger one does, so once few places are left only these are looked at.
    select = np.full(n, ESCAPE, np.uint8)
    widest, places, before = need, None, 1
    for s, c in reversed(list(enumerate(COUNTS))):
        if c > n:
            break
        level = _widths().index(60 // c)
        if places is None:
            m = n - c + 1
            for j in range(before, c):
                widest = np.maximum(widest[:m], need[j : j + m])
            fits = (widest <= level) & (room[:m] >= c)
            select[:m][fits] = s
            if 8 * np.count_nonzero(fits) < n:
                places = np.flatnonzero(fits)
                widest = widest[places]
        else:
            inside = room[places] >= c
            places, widest = places[inside], widest[inside]
            for j in range(before, c):
                widest = np.maximum(widest, need[places + j])
            fits = widest <= level
            places, widest = places[fits], widest[fits]
            select[places] = s
            if not len(places):
                break
        before = c
    stop = np.minimum((np.arange(0, n, BLOCK) + BLOCK), n)
    step = np.array([*COUNTS, 1, 1], np.int64)[select]
    # Follow the steps in all blocks at once to find where words begin.
    at, last, begins = np.arange(0, n, BLOCK), stop, np.zeros(n, bool)
    while len(at):
        begins[at] = True
        at = at + step[at]
        on = at < last
        at, last = at[on], last[on]
    first = np.flatnonzero(begins)
    chosen = select[first]
    size = 1 + (chosen == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s, c in enumerate(COUNTS):
        here = chosen == s
        if not here.any():
            continue
        start, word = first[here], np.full(int(here.sum()), s, np.uint64)
        for j in range(c):
            word |= ids[start + j] << np.uint64(4 + j * (60 // c))
        words[place[here]] = word
    raw = chosen == ESCAPE
    words[place[raw]] = ESCAPE
    words[place[raw] + 1] = ids[first[raw]]
    return words, place[np.searchsorted(first, np.arange(0, n, BLOCK))]


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a run of blocks; one vector operation for each selector and slot."""
    selector = (words & np.uint64(15)).astype(np.uint8)
    # The word after an escape is data, whatever its low bits are. Runs of 15s are resolved from their start.
    escape = np.flatnonzero(selector == ESCAPE)
    is_data = np.zeros(len(words), bool)
    previous = -2
    for e in escape.tolist():
        if not is_data[e]:
            previous = e
            if previous + 1 < len(words):
                is_data[previous + 1] = True
    counts = np.array([*COUNTS, 0, 1], np.int64)[selector]
    counts[is_data] = 0
    place = np.cumsum(counts) - counts
    ids = np.zeros(n, np.uint64)
    for s, c in enumerate(COUNTS):
        here = np.flatnonzero((selector == s) & ~is_data)
        mask, bits = np.uint64((1 << 60 // c) - 1), 60 // c
        for j in range(c if len(here) else 0):
            ids[place[here] + j] = (words[here] >> np.uint64(4 + j * bits)) & mask
    here = np.flatnonzero((selector == ESCAPE) & ~is_data)
    ids[place[here]] = words[here + 1]
    return ids


def shard_bytes(shard: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, blocks = encode(ids.astype(np.uint64))
    head = np.array([shard, len(doc_ids), len(ids), len(blocks), len(words)], "<i8")
    directory = np.array([*(d or 0 for d in doc_ids), *lengths, *(d is None for d in doc_ids), *blocks], "<i8")
    return MAGIC + head.tobytes() + directory.tobytes() + words.astype("<u8").tobytes() + bytes(8)


def read_shard(content: bytes, block: int | None = None) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """Shard number, doc_ids, lengths, and all ids or those of one block, found by its offset."""
    if content[:8] != MAGIC:
        raise ValueError("not a shard")
    shard, docs, n, blocks, words = np.frombuffer(content, "<i8", 5, 8).tolist()
    directory = np.frombuffer(content, "<i8", 3 * docs + blocks, 48)
    data = np.frombuffer(content, "<u8", words, 48 + 8 * (3 * docs + blocks))
    names = [None if null else d for d, null in zip(directory[:docs].tolist(), directory[2 * docs : 3 * docs].tolist(), strict=True)]
    offsets = directory[3 * docs :]
    if block is not None:
        end = int(offsets[block + 1]) if block + 1 < blocks else words
        ids = decode(data[int(offsets[block]) : end], min(BLOCK, n - block * BLOCK))
    else:
        ids = decode(data, n)
    return shard, names, directory[docs : 2 * docs], ids


#: In keys of chunks: the chunk begins with a newline, or with the text. Other keys stand for a space and themselves.
NEWLINE, START = "\0", "\1"


class _Chunks(dict):
    """Ids of chunks by key; a key that isn't there is encoded on the spot, and kept while there is room. KeyError where the
    white space around a chunk doesn't let it stand alone."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        # The byte-level form: bytes of printable characters stand for themselves, the others for characters from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.bytes = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - printable))}
        # Letters (of the blocks that all Unicode versions share) and ASCII marks after them, but nothing that the splitter
        # treats otherwise (digits, a quote and letters), are two pieces; the model encodes pieces without the splitter.
        self.word = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-^`{-~]*)").fullmatch
        self.newline = self.piece("\u010a")
        self.marks: dict[str, bytes] = {"": b""}

    def piece(self, form: str) -> bytes:
        """Ids of a piece in its byte-level form."""
        return array("I", [t.id for t in self.tokenize(form)]).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by the tokenizer itself."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __missing__(self, key: str) -> bytes:
        lead = key[:1]
        inner = lead > START
        m = None if inner and key.isascii() and key.isalpha() else self.word(key, not inner)
        if m is None and not (inner and key.isascii() and key.isalpha()):
            body = key if inner else key[1:]
            if body[:1].isspace() or body[-1:].isspace() or not body and lead != START:
                raise KeyError(key)
            ids = self.whole([(" " if inner else "\n" if lead == NEWLINE else "") + body])[0]
        else:
            letters, marks = m.groups() if m else (key, "")
            ids = self.get(letters) if marks and inner else None
            if ids is None:
                form = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.bytes)
                ids = self.piece("\u0120" + form) if inner else self.newline + self.piece(form) if lead == NEWLINE else self.piece(form)
            if marks:
                if (last := self.marks.get(marks)) is None:
                    last = self.piece(marks)
                    if len(self.marks) < CACHE:
                        self.marks[marks] = last
                ids += last
        if len(self) < CACHE:
            self[key] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each frequent chunk once.

    A byte-level tokenizer splits a text before it merges, and always before a single space or newline that stands between
    two characters that aren't white space. So the chunks that begin at such places can be encoded alone and their ids kept.
    A text with white space of another form is encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known = _Chunks(tokenizer)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return self.known.whole(texts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without the end id."""
        out: list[bytes | None] = []
        of = self.known.__getitem__
        for t in texts:
            try:
                out.append(None if NEWLINE in t or START in t else b"".join(map(of, (START + t.replace("\n", " " + NEWLINE)).split(" "))))
            except KeyError:
                out.append(None)
        whole = iter(self._whole([t for t, x in zip(texts, out, strict=True) if x is None]))
        return [next(whole) if x is None else x for x in out]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder for each worker process. Tasks call this by name: a cache that their own code held would be pickled with it,
    and each task would begin with an empty one."""
    return Encoder(path)


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes the ids of every text of docs (doc_id, text), each with end_id after it, in ascending doc_id order.

    Null texts are empty, rows without a doc_id come first, repeated rows stay, other columns aren't read. Texts move once,
    to ranges of doc_id; each task encodes its range in small batches and writes shard files of bounded size, whose numbers
    ascend with doc_id.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Texts of one doc_id, and those without, are dealt out by their hash.
    ordered = ordered.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        shard = TaskContext.get().partitionId() << 32
        names, parts, size = [], [], 0

        def out() -> pa.RecordBatch:
            content = shard_bytes(shard, names, [len(p) // 4 for p in parts], np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pydict({"content": pa.array([content], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                for name, ids in zip(own.column(0).to_pylist(), encoder.encode([t or "" for t in own.column(1).to_pylist()]), strict=True):
                    ids += end
                    if names and size + len(ids) // 4 > SHARD_IDS:
                        yield out()
                        shard, names, parts, size = shard + 1, [], [], 0
                    names.append(name)
                    parts.append(ids)
                    size += len(ids) // 4
        if names:
            yield out()

    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        write_binary_files(ordered.mapInArrow(run, "content binary"), "content", path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, place, doc_id, within (ids before it in its shard), n_tokens, ids_crc32 of every document in the shard files.

    As many tasks read the files as wrote them: file splits would make several times as many, and each task's own output costs
    files and the processes that set their modes.
    """
    def f(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("shard", "place", "doc_id", "within", "n_tokens", "ids_crc32")}
        for content in batch.column(0).to_pylist():
            if not content:
                continue
            shard, names, lengths, ids = read_shard(content)
            raw = ids.astype("<u4").tobytes()
            begin = np.cumsum(lengths) - lengths
            out["shard"] += [shard] * len(names)
            out["place"] += range(len(names))
            out["doc_id"] += names
            out["within"] += begin.tolist()
            out["n_tokens"] += lengths.tolist()
            out["ids_crc32"] += [zlib.crc32(memoryview(raw)[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), lengths.tolist(), strict=True)]
        return out

    schema = "shard long, place int, doc_id long, within long, n_tokens long, ids_crc32 long"
    files = read_binary_files(spark, path).select("content").coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return per_batch(files, schema, f, 1)


def starts(shards: DataFrame) -> DataFrame:
    """shards with start, the ids of all documents before each: one row a shard file is summed in order and joined again."""
    totals = shards.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.join(totals.select("shard", F.coalesce(before, F.lit(0)).alias("base")), "shard").withColumn("start", F.col("base") + F.col("within"))


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, from shard files written to the shared folder and read back."""
    spark = docs.sparkSession
    path = shared_path(spark, "shards")
    write_shards(docs, tokenizer, path)
    # What the shards say of each document is written down, as it is used twice and costs reading the shards. Files go to the
    # workers one by one: a task's batch would hold all of its files on both sides.
    with arrow_batches(spark, 1):
        directory = materialised(read_shards(spark, path), "directory")
    return starts(directory).select("doc_id", "start", "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard directory of all documents in the byte-level vocabulary."""
    import public_tokenizers

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
