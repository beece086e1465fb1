"""What tasks of the pipeline hold at once is bounded in bytes, not only in rows."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from attestor.llm import common, jaccard, simhash

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("stage", ["quality", "near_dedup", "decontaminate", "tokens"])
def test_stages_pass_long_texts_in_bounded_batches(spark, tmp_path, stage):
    """2,000 texts of 10 KB, 20 MB in one partition, were one batch on either side."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "bytes": pa.array([b.nbytes], pa.int64())})

    docs = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat('word ', 2000) as text", "'en' as lang", "'web' as source", "10000L as n_chars")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", "some words of an item")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.conf.unset(NAME)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(20), str(tmp_path))
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
    finally:
        spark.conf.unset(NAME)
    assert sum(r.n for r in got) == 2000 and max(r.bytes for r in got) <= common.BATCH_BYTES + 20_000


def test_smaller_batches_of_the_session_stay(spark):
    try:
        spark.conf.set(NAME, "1m")
        common.bounded_batches(spark)
        assert spark.conf.get(NAME).removesuffix("b") in ("1m", "1048576")
    finally:
        spark.conf.unset(NAME)


def held(run) -> int:
    """Most bytes that run() has held beside what was there."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_large_buckets_are_compared_in_bounded_pieces():
    """3,000 rows near a pivot against 3,000 that are not: 64 MB of words at a time before."""
    words = np.zeros((6000, 4), np.uint64)
    words[:, 0] = np.arange(6000, dtype=np.uint64)
    words[3000:, 1:] = np.uint64(0xFFFF)
    found = []
    assert held(lambda: simhash._link_large(np.arange(6000), words, 40, lambda a, b: found.append((a, b)))) < 40 << 20
    assert sum(len(a) for a, _ in found) == 5998


def test_sets_are_compared_in_bounded_pieces():
    """400 sets of 10,000 hashes, 32 MB: they were written out whole, four times."""
    rng = random.Random(3)
    own = np.arange(0, 20_000, 2, dtype=np.uint64)
    sets = [own + np.uint64(rng.randrange(400)) for _ in range(400)] + [np.array([7], np.uint64), np.arange(0, 600_000, dtype=np.uint64), own[:1]]
    got = []
    assert held(lambda: got.append(jaccard.in_common(own, sets))) < 32 << 20
    assert got[0].tolist() == [len(np.intersect1d(own, x)) for x in sets]
