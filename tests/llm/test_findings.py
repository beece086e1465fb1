"""Cases of the second review."""

import random

import numpy as np
import pytest

from attestor.llm import common, jaccard, simhash, simple8b


def test_near_copies_are_proposed_by_simhash(spark, monkeypatch):
    """All pairs at a similarity of exactly 0.8 are found, and what proposes them are fingerprints and their links."""
    asked, links = [], simhash.links
    monkeypatch.setattr(jaccard, "links", lambda fps, *a: asked.append(a) or links(fps, *a))
    rng, docs = random.Random(4), []
    for i in range(600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(94)]
        # 90 shingles each, of which 80 are common: 80 of 100.
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:84] + [f"x{rng.randrange(10**6)}" for _ in range(10)]))]
    sets = [jaccard.shingle_set(t.encode(), 5) for _, t in docs]
    assert {(len(np.intersect1d(a, b)), len(np.union1d(a, b))) for a, b in zip(sets[::2], sets[1::2], strict=True)} == {(80, 100)}
    fps = jaccard.set_fingerprints(sets)
    assert abs(np.bitwise_count(fps[::2] ^ fps[1::2]).sum() / 600 / 64 / jaccard.WORDS - jaccard.differing((4, 5))) < 0.01
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert asked == [(jaccard.most_bits((4, 5)), 64 * jaccard.WORDS, jaccard.differing((4, 5)), jaccard.PAIRS, jaccard.SEARCHED)]
    assert set(kept) >= set(range(0, 1200, 2)) and len(kept) <= 601


@pytest.mark.parametrize(("small", "most"), [(256, 20_000), (3, 20_000), (16, 40)])
def test_links_of_repeated_partitions_equal_brute_force(spark, monkeypatch, small, most):
    """Whatever the tasks and the sizes of buckets, links join what is within tau bits; few of them are given for a large group."""
    monkeypatch.setattr(simhash, "MEETINGS", 20)
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 63, (60, 4), dtype=np.uint64)
    own = seeds[np.r_[np.zeros(500, np.int64), rng.integers(0, 60, 500)]]
    for _ in range(18):
        at, bit = np.arange(len(own)), rng.integers(0, 256, len(own))
        own[at, bit // 64] ^= np.uint64(1) << (bit % 64).astype(np.uint64)
    own = np.unique(own, axis=0)
    plain = simhash.Forest(len(own))
    plain.add(*np.nonzero(np.bitwise_count(own[:, None] ^ own[None, :]).sum(axis=2) <= 40))
    rows = spark.createDataFrame([(x.astype(">u8").tobytes(),) for x in own], "fp binary").repartition(3)
    got = simhash.links(rows, 40, 256, 0.15, small, most).collect()
    at, ours = {x.astype(">u8").tobytes(): i for i, x in enumerate(own)}, simhash.Forest(len(own))
    ours.add(*(np.array([at[bytes(r[c])] for r in got]) for c in "ab"))
    assert ours.label.tolist() == plain.label.tolist()
    assert 1 < len(set(plain.label.tolist())) < 500 and (most < 500 or len(got) < 12 * len(own))


def test_kept_rows_are_shuffled_once(spark):
    """Repeats go where the join has put the rows: no exchange stands above it. Ids of other types and nulls stay apart."""
    rows = [(None, "a b"), (None, "a b"), (0, "c d"), (None, "c d"), (0, "c d"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        kept = simhash.keep_one(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, kept.collect()), key=str)
    finally:
        spark.conf.set(name, before)
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    assert got == sorted([(None, "a b"), (0, "c d"), (3, None)], key=str)


def test_shards_are_read_in_as_many_tasks_as_wrote_them(spark):
    """And one file a batch: a worker never holds all files of its task."""
    path = common.shared_path(spark, "shards")
    own = [(simple8b.shard_bytes(i, [2 * i, 2 * i + 1], [3, 2], np.arange(i, i + 5)),) for i in range(40)]
    common.write_binary_files(spark.createDataFrame(own, "content binary"), "content", path)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        found = simple8b.read_shards(spark, path)
        assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted((r.doc_id, r.shard, r.within, r.n_tokens) for r in found.collect()) == [(d, d // 2, 3 * (d % 2), 3 - d % 2) for d in range(80)]
    finally:
        spark.conf.set(name, before)


def test_files_of_shards_go_to_workers_one_by_one(spark, monkeypatch):
    import public_tokenizers

    seen, read = [], simple8b.read_shards
    monkeypatch.setattr(simple8b, "read_shards", lambda s, path: seen.append(s.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or read(s, path))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    assert simple8b.token_table(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 20 and seen == ["1"]
