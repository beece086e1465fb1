"""Compression classifier: how much better a text compresses with a dictionary of good texts than with one of bad texts.

Two zstandard dictionaries are trained on labelled texts. The differences of a text's compressed sizes with either and with
none, normalised, go through a logistic calibration that is fitted on further labelled texts and weighted to the class shares
of all labels. Nothing but these differences enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import per_batch, table

#: Labelled documents of each class that the fit takes (in the order of a hash of doc_id), of which the first share builds the
#: dictionaries and the rest calibrates. This bounds what the driver reads; counts of classes are over all labels.
PER_CLASS, DICTIONARY_SHARE = 3000, 0.6
#: Longest text in bytes for the fit, so that its bytes are bounded too. Scores read whole texts of any length.
LONGEST_FIT = 32_768
DICTIONARY_BYTES, LEVEL = 112_640, 3
THRESHOLD = 0.3


@dataclass
class Classifier:
    """Dictionaries, and a logistic function of the features standardised."""

    good: bytes
    bad: bytes
    mean: np.ndarray = field(default_factory=lambda: np.zeros(10))
    sd: np.ndarray = field(default_factory=lambda: np.ones(10))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(11))

    def __post_init__(self):
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def _compressors(self):
        import zstandard as z

        if self._made is None:
            plain = dict(level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
            self._made = [*(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), **plain) for d in (self.good, self.bad)), z.ZstdCompressor(**plain)]
        return self._made

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Bytes of each text: its own, compressed with the good dictionary, with the bad one, and with none."""
        good, bad, none = self._compressors()
        return np.array([(len(t), len(good.compress(t)), len(bad.compress(t)), len(none.compress(t))) for t in texts], np.float64).reshape(-1, 4)

    @staticmethod
    def features(sizes: np.ndarray) -> np.ndarray:
        """Differences of compressed sizes only: what the good dictionary saves against the bad one and against none, normalised
        by the text's size, its root, its compressed size, and as logarithms of ratios."""
        n, good, bad, none = sizes.T
        saved = []
        for other in (bad, none):
            ratio = np.log((other + 1) / (good + 1))
            saved += [(other - good) / (n + 20), (other - good) / np.sqrt(n + 20), (other - good) / (none + 20), ratio, ratio**2]
        return np.stack(saved, axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = (self.features(self.sizes(texts)) - self.mean) / self.sd
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))

    def calibrate(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> None:
        """Weighted logistic regression by Newton steps with a small ridge."""
        x = self.features(self.sizes(texts))
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.c_[(x - self.mean) / self.sd, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        ridge = np.diag([1e-2] * (len(w) - 1) + [0.0]) * weight.sum() / len(x)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            grad = x.T @ (weight * (p - labels)) + ridge @ w
            step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w


def held_out() -> F.Column:
    """Rows whose labels the fit never sees."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except z.ZstdError:  # too few or too short samples to train on: zstandard then takes the bytes themselves
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def fit(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """The classifier from docs (doc_id, text) and labels (doc_id, quality), or None without labels of both classes.

    Rows without a doc_id, quality or text, the held-out ones, and a doc_id with both labels are not used; a doc_id counts once.
    """
    own = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    counts = {r.quality: r.n for r in own.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64("doc_id")
    chosen = None
    for q in (0, 1):
        part = own.where(F.col("quality") == q).orderBy(order, "doc_id").limit(PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = texts.where(F.length("text") <= LONGEST_FIT)
    # The chosen rows are bounded by PER_CLASS, so they go to every executor.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(order, "doc_id").collect()
    by = {q: [bytes(r.text) for r in rows if r.quality == q] for q in (0, 1)}
    if not by[0] or not by[1]:
        return None
    cut = {q: max(1, int(len(x) * DICTIONARY_SHARE)) for q, x in by.items()}
    c = Classifier(_dictionary(by[1][: cut[1]]), _dictionary(by[0][: cut[0]]))
    rest = {q: x[cut[q] :] or x for q, x in by.items()}
    weight = np.concatenate([np.full(len(rest[q]), counts[q] / sum(counts.values()) / len(rest[q])) for q in (0, 1)]) * (len(rest[0]) + len(rest[1]))
    c.calibrate(rest[0] + rest[1], np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])]), weight)
    return c


def scores(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """doc_id, score for every row of docs (doc_id, text); null texts count as empty, repeated rows stay.

    Without a classifier (no labels of both classes) every score is 0.5, which rejects nothing.
    """
    def f(batch: pa.RecordBatch) -> dict:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "score": np.full(len(texts), 0.5) if classifier is None else classifier.score(texts)}

    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), "doc_id long, score double", f, 1024)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score below THRESHOLD, all columns kept, scored where they are read.

    Null and empty texts have a score like others; repeated rows and rows without a doc_id are scored each by itself; without
    labels of both classes all rows stay.
    """
    classifier, names = fit(docs, labels), docs.columns
    fields = docs.schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [(t or "").encode() for t in part.column(names.index("text")).to_pylist()]
                yield part if classifier is None else part.filter(pa.array(classifier.score(texts) >= THRESHOLD))

    return docs.mapInArrow(run, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a classifier fitted on the labels that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
