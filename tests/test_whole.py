"""Whole reference queries on a small fixture, against plain expectations."""

import pytest

from attestor.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("whole"))
    rows = {
        "part": ([(i, f"p{i}", 10, f"Brand#{i}", 100.0 + i) for i in range(101)], "p_partkey long, p_name string, p_size int, p_brand string, p_retailprice double"),
        "supplier": ([(1, "s1", 0)], "s_suppkey long, s_name string, s_nationkey long"), "nation": ([(0, "NATION_0", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "region": ([(0, "ASIA")], "r_regionkey long, r_name string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{top}/{name}.parquet")
    return top


def test_verify_claims_all_parts(spark, tables):
    got = catalogue.verify_triples_whole(spark, tables).where("r = 'has_context'").collect()
    assert len(got) == 101 and {r.s: r.status for r in got}["p1"] == "VERIFIED"


def test_grid_has_open_ranges(spark, tables):
    got = {(r.d, r.c): r.outcome for r in catalogue.compare_grid_whole(spark, tables).collect()}
    assert set(got) == {(d, d * 7 % 101) for d in range(101)}
    assert {o for (d, c), o in got.items() if d % 5 == 3 and c % 5 == 3} == {"MATCH"}
    assert {o for (d, c), o in got.items() if d % 5 == 3 and c % 5 == 4} == {"INCOMPARABLE"}


def test_mentions_read_whole_passages(spark, monkeypatch):
    passages = spark.createDataFrame([("1/2", "Part\n7 weighs 3 kg, or was it 2 kg?")], "passage_id string, text string")
    facts = spark.createDataFrame([(f"part {i}",) for i in (2, 3, 7)], "entity string")
    monkeypatch.setattr(catalogue, "cp1", lambda *x: passages)
    monkeypatch.setattr(catalogue, "price_facts", lambda *x: facts)
    assert sorted(r.entity for r in catalogue.mentions_whole(spark, "").collect()) == ["part 2", "part 3", "part 7"]
