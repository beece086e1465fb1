"""Equal inputs are worked out once, with the same rows as when each is worked out by itself."""

from collections import Counter

from pyspark.sql import functions as F

from attestor.operators import extract, factset, gate, suggest, trials
from attestor.plans import texts as texts_plan
from attestor.session import BATCH_BYTES

CLAIMS = [
    ("Part 1", "price", "$5", None), (" part 1", "price", "$6", {}), ("part 1", "price", None, None), (None, "price", "$5", None), ("part 9", "price", "$5", None), ("part 1", None, "$5", None),
    ("part 2", "fee", "$7", {"Region": "north", "kind": "a"}), ("part 2", "fee", "$7", {"kind": "a", "Region": "north"}), ("part 2", "fee", "$8", {"region": "SOUTH"}), ("part 2", "fee", "$9", None), ("part 3", "price", "3 mg", None),
]


def tables(spark):
    facts = spark.createDataFrame(
        [(0, "part 1", "price", "$5", "it costs $5", {}, True), (1, "part 2", "fee", "$7", "north $7", {"region": "north"}, True), (2, "part 2", "fee", "$8", "south $8", {"region": "south"}, True), (3, "part 3", "price", "3-5 mg", "", {}, False)],
        "pos int, entity string, relation string, o string, source string, when map<string,string>, numeric boolean",
    )
    aliases = facts.select(F.col("entity").alias("surface"), "entity").distinct().union(spark.createDataFrame([("part 3", "part 1")], "surface string, entity string"))
    rows = [(i, *c) for i, c in enumerate(CLAIMS * 3)]
    return spark.createDataFrame(rows, "id int, entity_mention string, relation string, claimed_value string, context map<string,string>"), aliases, facts


def test_verdicts_by_shuffle_are_those_by_broadcast(spark, monkeypatch):
    claims, aliases, facts = tables(spark)
    rows = lambda: Counter(map(str, gate.gate(claims, aliases, factset.slots(facts), "f").collect()))
    few = rows()
    monkeypatch.setattr(gate, "BROADCAST_ROWS", 0)
    assert rows() == few and sum(few.values()) == 3 * (len(CLAIMS) + 1)


def test_equal_claims_are_judged_once(spark, monkeypatch):
    monkeypatch.setattr(gate, "BROADCAST_ROWS", 0)
    claims, aliases, facts = tables(spark)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    many = claims.where("id = 0").crossJoin(spark.range(500).select(F.col("id").alias("copy")))
    got = gate.gate(many, aliases, factset.slots(facts), normalise=lambda c: counted(c) if "claimed" in str(c) else c).collect()
    assert len(got) == 500 and {r.status for r in got} == {"VERIFIED"} and len({r.copy for r in got}) == 500
    assert seen.value < 10


def test_many_slots_are_counted_without_parsing(spark, monkeypatch):
    monkeypatch.setattr(gate, "BROADCAST_ROWS", 0)
    slots = factset.slots(tables(spark)[2])
    wrong = slots.select(F.raise_error(F.lit("parsed")).cast("string").alias("entity"))
    assert not gate.is_small(wrong, slots.keys)


def test_mentions_by_shuffle_are_those_by_broadcast(spark, monkeypatch):
    texts = ["Part\n7 weighs 3 kg, or 2 kg?", "Red Fox (UK) and the blue-\nbird", None, "fox red", ""]
    passages = spark.createDataFrame([(i, x) for i, x in enumerate(texts * 3)], "passage_id int, text string")
    names = spark.createDataFrame([(x, x) for x in ("part 2", "part 3", "part 7", "Red Fox (UK)", "bluebird", "Red Fox/bluebird", None)], "surface string, entity string")
    rows = lambda: Counter(map(tuple, extract.mentions(passages, names).collect()))
    few = rows()
    monkeypatch.setattr(gate, "BROADCAST_ROWS", 0)
    many = extract.mentions(passages, names)
    assert rows() == few and len(few) >= 12
    dealt = [x for x in many._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner, (word" in x]
    assert dealt and "hash" in many._jdf.queryExecution().optimizedPlan().toString()


def test_equal_values_are_corrupted_and_looked_at_once(spark):
    rows = spark.range(300).select("id", (F.col("id") % 2).alias("k"), F.lit("7 mg").alias("v"))
    made = trials.corrupted(rows, "v", "k", "wrong")
    assert {(r.k, r.wrong) for r in made.collect()} == {(0, "14 mg"), (1, "3.5 mg")} and made.columns == ["id", "k", "v", "wrong"]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    held = spark.range(300).select(F.col("id").alias("pos"), F.lit("5 kg").alias("declared"), F.lit("5 kg net").alias("claimed"))
    got = suggest.suggest_qualifiers(held, lambda c: counted(c)).collect()
    assert [(r.residue, r.n, r.example) for r in got] == [("net", 300, "5 kg net")] and seen.value < 20


def test_offsets_come_in_bounded_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(1 << 30))
        spark.createDataFrame([(1, "One. Two!")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        assert {(r.s, r.e) for r in texts_plan.sentence_offsets(spark, str(tmp_path)).collect()} == {(0, 4), (5, 9)}
        assert int(spark.conf.get(name)) <= BATCH_BYTES
    finally:
        spark.conf.set(name, before)
