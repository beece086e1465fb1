"""Cases that a review found."""

from collections import Counter

import numpy as np

from attestor.llm import decontaminate, licences, mixing, pii, simhash
from attestor.operators import datagen


def test_large_home_bucket_gives_what_others_take_as_known():
    high = [1 << 8 + i for i in range(48)] + [3 << 8 + i for i in range(12)]
    own = [h | 5 for h in high]
    words = np.array([4, *own, *own], np.uint64)[:, None]
    bucket = np.array([0] * 61 + [1] * 60)
    a, b = simhash.link_buckets(bucket, words, words[:, 0] & np.uint64(255), np.array([False] + [True] * 60 + [False] * 60), 4)
    assert len(a) >= 60
    joined = {x: x for x in [4, *own]}
    for _ in joined:
        for x, y in zip(words[a, 0].tolist(), words[b, 0].tolist(), strict=True):
            joined[x] = joined[y] = min(joined[x], joined[y])
    assert set(joined.values()) == {4}


def test_short_items_of_two_blocks_count_together(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item{i} word{i}") for i in range(4)], "item_id long, text string")
    fill = " ".join(f"f{i}" for i in range(70))
    docs = spark.createDataFrame([(1, f"item0 word0 {fill} item3 word3"), (2, f"item0 word0 {fill} {fill}"), (3, None), (4, f"item2 word2 item2 word2 {fill}")], "doc_id long, text string")
    one = sorted(r.doc_id for r in decontaminate.without_overlap(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    assert len(decontaminate._blocks(bench)) > 3
    assert sorted(r.doc_id for r in decontaminate.without_overlap(docs, bench).collect()) == one == [2, 3]
    flagged = decontaminate.overlaps(docs, bench).where(decontaminate.contaminated())
    assert sorted(r.doc_id for r in flagged.collect()) == [1, 4]


def test_rows_without_or_with_repeated_ids_are_kept(spark):
    text = [" ".join(f"t{i}w{j}" for j in range(30)) for i in range(6)]
    rows = [(None, text[0], "en"), (None, text[1], "en"), (7, text[2], "en"), (7, text[3], "de"), (7, text[3], "de"), (8, text[3], "en"), (None, text[2], "en"), (None, None, "en"), (None, text[4], "en"), (None, text[4], "en")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert Counter(map(tuple, got)) == Counter([(None, text[0], "en"), (None, text[1], "en"), (7, text[2], "en"), (7, text[3], "de"), (None, None, "en"), (None, text[4], "en")])


def test_mix_takes_each_row_by_itself(spark):
    rows = [(None if i % 3 == 0 else i // 4, f"{'w ' * (1 + i % 9)}{i}", "ab"[i % 2], i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    copies = sum(r.copies for r in mixing.mix(docs).collect())
    got = mixing.mixed_rows(docs).collect()
    assert len(got) == copies and max(Counter(r.n for r in got).values()) <= 3
    assert {tuple(r) for r in got} <= set(rows) and any(r.doc_id is None for r in got)


def test_licences_inside_texts(spark):
    words = licences.MIT.split()
    wrapped = "# Copyright 2020 Some One\n" + "\n".join("# " + " ".join(words[i : i + 6]) for i in range(0, len(words), 6))
    texts = ["Prose.\nReleased under the MIT License.\nMore.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
             "code\n" + wrapped + "\ncode", "// SPDX-License-Identifier: BSD-3-Clause\nx", "nothing", None, "license to thrill"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.notices(df).collect()}
    assert [got[i] for i in range(9)] == [["MIT"], ["Apache-2.0"], ["GPL-3.0"], ["CC-BY-NC-4.0"], ["MIT"], ["SPDX-BSD-3-Clause"], [], [], []]


def test_every_subject_with_a_sibling_gets_a_near_miss(spark):
    rows = [(f"n{i}", "in", f"r{i % 5}") for i in range(25)] + [("both", "in", "r0"), ("both", "in", "r1"), ("n0", "alone", "x")] + [(f"p{i}", "has", "common" if i else "rare") for i in range(100)]
    got = {(r.s, r.r): (r.o, r.wrong_o) for r in datagen.near_misses(spark.createDataFrame(rows, "s string, r string, o string")).collect()}
    assert len(got) == 25 + 1 + 100 and got["both", "in"] == ("r0", "r2") and got["p0", "has"] == ("rare", "common")
    assert all((s, r, wrong) not in rows for (s, r), (_, wrong) in got.items())


def test_iban_before_upper_case_words():
    iban = "DE89 3704 0044 0532 0130 00"
    for after in ("", " BIC COBADEFF", " EUR", " 12", " EUR 12 GB82 WEST 1234 5698 7654 32"):
        assert [x[:3] for x in pii.spans("IBAN " + iban + after) if x[0] == "iban"][:1] == [("iban", 5, 5 + len(iban))]
    two = [x for x in pii.spans(f"{iban} GB82 WEST 1234 5698 7654 32") if x[0] == "iban"]
    assert len(two) == 2
