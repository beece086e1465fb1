"""keep_one against brute force over all pairs."""

import random

import pytest

from attestor.llm import jaccard, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("small", [False, True])
def test_keep_one_equals_brute_force(spark, monkeypatch, small):
    if small:
        for name in ("PAIRS", "SEARCHED", "BLOCK"):
            monkeypatch.setattr(jaccard, name, 3)
    rng = random.Random(8)
    docs, base = [], []
    for i in range(400):
        if i % 4 == 0:
            base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        docs.append((i, " ".join("x" if rng.random() < (i % 4) * 0.01 else w for w in base)))
    big = [f"v{i}" for i in range(200)]
    docs += [(1000 + i, " ".join([*big[: 60 + i], f"end{i}"])) for i in range(120)]
    docs += [(2000, None), (2001, " "), (2002, "a b"), (2003, "A  b"), (2004, docs[5][1])]
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}
    near = {a: [b for b in sets if a == b or sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0] for a in sets}
    while (new := {a: min(label[b] for b in near[a]) for a in sets}) != label:
        label = new
    assert 60 < len(set(label.values())) < 400
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))
