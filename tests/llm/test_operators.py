"""Each operator on awkward rows against a plain version."""

import random
import re
import zlib
from hashlib import sha1

import numpy as np
import pytest

from attestor.llm import ann, decontaminate, mixing, pii, quality, secrets, simhash, simple8b, warc

DOCS = "doc_id long, text string, source string, spans string"
AWKWARD = [(1, None, "a", "x"), (2, "", None, "x"), (3, "one two", "a", None), (3, "one two", "a", None), (None, "one two", "b", ""), (4, "z " * 30000, "b", ""), (5, " \t\n", "a", "")]


def test_pii_base_spans_equal_plain_patterns():
    plain = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("a@.-1+ 9()4") for _ in range(rng.randint(0, 50)))
        expected = []
        for kind, pattern in plain:
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                    continue
                expected.append((kind, *m.span()))
        assert [x[:3] for x in pii.spans(text) if x[0] in pii.BASE] == expected


def test_pii_long_texts_are_linear():
    assert pii.spans("a" * 300_000) == [] and pii.spans("1" * 100_000) == [] and pii.spans("a@" * 50_000) == []
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, DOCS)
    assert pii.detect(df).count() == len(AWKWARD) and secrets.detect(df).count() == len(AWKWARD)
    none = spark.createDataFrame([], DOCS)
    assert pii.detect(none).count() == 0 and secrets.detect(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0 and quality.scores(none, None).count() == 0


def test_secret_model_keeps_its_recall():
    net = secrets.trained()
    found = secrets.labelled_findings(1000, 4242)
    p, y = net.score([x[:3] for x in found]), np.array([x[3] for x in found])
    assert (p[y == 1] >= net.threshold).mean() > 0.95 and (p[y == 0] >= net.threshold).mean() < 0.05


def test_wu_manber_equals_brute_force():
    rng = random.Random(3)
    vocabulary = [b"a", b"bb", b"ccc", "été".encode(), b"the", b"of"]
    items = [(str(i), b" ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 3, 15, 20))))) for i in range(12)]
    matcher = decontaminate.Matcher(items)
    docs = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 4000))] for _ in range(4)] + [decontaminate.fold(t) for _, t in items]
    for words, found in zip(docs, matcher.find(docs), strict=True):
        expected = sorted((i, p) for p, n in matcher.words.items() for i in range(len(words) - n + 1) if b" " + b" ".join(words[i : i + n]) + b" " == p)
        assert sorted(found) == expected


def test_overlap_in_blocks_equals_one_block(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(16))) for i in range(6)] + [(None, "w0x1 w0x2"), (7, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Say w0x1 w0x2! " + " ".join(f"W1X{j}" for j in range(14))), (2, None), (3, "none here")], "doc_id long, text string")
    one = sorted(decontaminate.overlaps(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert sorted(decontaminate.overlaps(docs, bench).collect()) == one
    assert one[0].n_hit == 16 and one[0]["items"] == ["1"] and one[1].n_words == 0
    assert [r.doc_id for r in decontaminate.without_overlap(docs, bench).collect()] == [2, 3]


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 1 << 33, 1 << 63])
@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 4000])
def test_simple8b_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    if n and high == 1 << 63:
        ids[::3] = np.uint64(2**64 - 1)
    words, _ = simple8b.encode(ids)
    assert (simple8b.decode(words, n) == ids).all()
    content = simple8b.shard_bytes(9, [None, 7], [n // 2, n - n // 2], ids)
    assert simple8b.read_shard(content)[1] == [None, 7] and (simple8b.read_shard(content)[3] == ids).all()
    if n > 1024:
        assert (simple8b.read_shard(content, 1)[3] == ids[1024:2048]).all()


def test_tokens_equal_the_library(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", " ", "a  b", "a \n b", "x  y", "it's  don't 'll", "<|endoftext|> a", "é  x", "a\n\nb c", " lead", "trail ", "tab\t x", "don 't we 've", "1 000 a1 b-2", "word, word", "café. Naïve!\nNew 中文 x"]
    encoder = simple8b.Encoder(path)
    assert encoder.encode(texts) == encoder._whole(texts) and encoder.encode(texts[::-1]) == encoder._whole(texts[::-1])
    df = spark.createDataFrame([(5, "b b"), (None, None), (2, "a"), (2, "a")], "doc_id long, text string")
    rows = sorted(simple8b.token_table(df, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 2, 2, 5] and [r.start for r in rows] == [0, 1, 3, 5]
    assert rows[0].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(120)] if i % 3 == 0 else base
        docs.append((i, " ".join(w if rng.random() > 0.01 else "x" for w in base)))
    docs += [(200, None), (201, " "), (202, docs[5][1])]
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    values = {i: int.from_bytes(fp, "big") for i, (fp, _) in got.items()}
    label = {i: i for i in values}
    for _ in values:
        for a in values:
            label[a] = min(label[b] for b in values if (values[a] ^ values[b]).bit_count() <= 4)
    assert {i: c for i, (_, c) in got.items()} == label and values[200] == values[201] == 0


def test_large_buckets_lose_no_link():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    words = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for c in centres])[:, None]
    bucket = np.zeros(len(words), np.int64)
    a, b = simhash.link_buckets(bucket, words, np.zeros(len(words), np.uint64), np.ones(len(words), bool), 4)
    distinct = np.unique(words)
    number = {int(x): i for i, x in enumerate(distinct)}
    ours, plain = simhash.Forest(len(distinct)), simhash.Forest(len(distinct))
    ours.add(np.array([number[int(words[i, 0])] for i in a]), np.array([number[int(words[i, 0])] for i in b]))
    near = np.argwhere(np.bitwise_count(distinct[:, None] ^ distinct[None, :]) <= 4)
    plain.add(near[:, 0], near[:, 1])
    assert (ours.label == plain.label).all()


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 7 % 3]) for i in range(700)] + [(None, None, None)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(found) == 701 and all(0 <= r.taken <= 3 * r.size for r in found)
    targets = {r.source_size: r.target for r in found}
    assert abs(sum(targets.values()) - sum(r.size for r in found)) < 1e-6
    for size, target in targets.items():
        assert abs(sum(r.taken for r in found if r.source_size == size) - target) <= 1


def test_warc_round_trip(spark):
    rows = [(1, "u", "abc"), (2, "u\nx", "abc"), (3, None, None), (4, "v", ""), (None, "w", "zz"), (5, "é", "ü\r\n\r\nWARC/1.1\r\n"), (6, "", "abc"), (6, "", "abc")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    refers = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert refers == [(0, "response", None), (1, "revisit", 6), (2, "revisit", 6), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None), (6, "response", None)]
    assert {r.page_id: r.payload_bytes for r in got}[5] == len("ü\r\n\r\nWARC/1.1\r\n".encode())
    assert warc.digest(b"abc") == __import__("base64").b32encode(sha1(b"abc").digest()).decode()


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 16))
    vectors[100:180] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    hits = 0
    for q in range(0, 400, 20):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -score))[:20]
        hits += len(set(best.tolist()) & {got[q, k][0] for k in range(1, 21)})
    assert hits >= 0.95 * 400 and (400, 1) not in got
