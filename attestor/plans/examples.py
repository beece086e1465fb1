"""Queries of training examples and splits. Orders are those of MD5, so that other engines draw the same samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import datagen, triples
from attestor.plans.catalogue import TRIPLES_SQL, knowledge, query, t

KB = f"kb as (select distinct s, r, o from {TRIPLES_SQL})"
STATES = "st as (select s, r, count(*) as n, min(o) as answer from kb group by all)"


def _h(seed: int, salt: str, *columns: str) -> str:
    return f"md5(concat_ws('|', '{seed}', '{salt}', {', '.join(columns)}))"


def _draw(n: str, seed: int, salt: str, *columns: str) -> str:
    return f"(('0x' || {_h(seed, salt, *columns)}[1:8])::bigint % {n})"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_QUESTIONS = [(r, d, place, t) for r, by in datagen.QUESTIONS.items() for place, (d, t) in enumerate((d, t) for d, own in by.items() for t in own)]
QT = f"qt as (select * from (values {_values(_QUESTIONS)}) q(r, direction, place, template)), qn as (select r, count(*) as n from qt group by 1), qf as (select r, count(*) as n from qt where direction = 'forward' group by 1)"
ST = f"tt as (select * from (values {_values([(r, i, x) for r, own in datagen.STATEMENTS.items() for i, x in enumerate(own)])}) q(r, template_id, template))"


def numbered(seed: int, salt: str, *columns: str) -> str:
    return f"row_number() over (order by {_h(seed, salt, *columns)}, {', '.join(columns)})"


def held(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The knowledge base without a hundred held-out triples, and these."""
    rows = datagen.held_out(knowledge(spark, sf_dir).distinct(), 100, 7)
    return rows.where("not held_out").select("s", "r", "o"), rows.where("held_out").select("s", "r", "o")


HELD = f"hx as (select s, r, o, {numbered(7, 'held out', 's', 'r', 'o')} <= 100 as held_out from kb)"


@query(f"with {KB}, {HELD} select s, r, o, held_out from hx")
def holdout_split(spark, sf_dir):
    return datagen.held_out(knowledge(spark, sf_dir).distinct(), 100, 7)


@query(f"""with {KB}, own as (select r, s, list(o order by o) as own from kb group by all), m as (select max(len(own)) as most from own),
c as (select r, o, row_number() over (partition by r order by count(*) desc, o) as rank from kb group by r, o), cc as (select r, list(o order by rank) as common from c, m where rank <= most + 1 group by 1)
select s, r, own[1] as o, list_filter(common, lambda x: not list_contains(own, x))[1] as wrong_o from own join cc using (r) where len(list_filter(common, lambda x: not list_contains(own, x))) > 0""")
def near_miss_corrupt(spark, sf_dir):
    return datagen.near_misses(knowledge(spark, sf_dir))


@query(f"with {KB}, rs as (select list(distinct r order by r) as names from kb), p as (select distinct s, names[1 + {_draw('len(names)', 0, 'relation', 's')}] as r from kb, rs) select s, r from p where not exists (select 1 from kb where kb.s = p.s and kb.r = p.r)")
def unanswerable_pairs(spark, sf_dir):
    return datagen.unanswerable(knowledge(spark, sf_dir))


@query(f"""with {KB}, {QT}, a as (select kb.s, kb.r, kb.o, direction, replace(replace(template, '{{s}}', s), '{{o}}', o) as question from kb join qn using (r) join qt on qt.r = kb.r and qt.place = {_draw('qn.n', 3, 'question', 's', 'kb.r', 'o')}),
f as (select s, r, count(*) as n, min(o) as top from kb group by all), g as (select r, o, count(*) as n, min(s) as top from kb group by all),
x as (select a.*, case when direction = 'forward' then f.top else g.top end as top, 1.0 / case when direction = 'forward' then f.n else g.n end as score from a join f using (s, r) join g on g.r = a.r and g.o = a.o),
y as (select *, {numbered(3, 'qa', 's', 'r', 'o')} as i from x where score >= 0.11)
select 'qa-3-' || i as id, question, top || ' (confidence ' || printf('%.2f', score) || '). [kb:' || case when direction = 'forward' then s else top end || '/' || r || '/' || case when direction = 'forward' then top else o end || ']' as answer, direction, s, r, o from y where i <= 500""")
def qa_examples(spark, sf_dir):
    """Five hundred questions about facts, forward and reverse, with the knowledge base's first candidate as answer."""
    kb = knowledge(spark, sf_dir)
    rows = datagen.qa_examples(kb, kb, 500, 3).where(datagen.is_valid(F.col("messages")))
    return rows.select("id", "plain.question", "plain.answer", F.col("meta")["direction"].alias("direction"), F.col("meta")["s"].alias("s"), F.col("meta")["r"].alias("r"), F.col("meta")["o"].alias("o"))


@query(f"""with {KB}, {STATES}, w2 as (select a.s as start, a.r || '/' || b.r as hops, [a.s, a.answer, b.answer] as nodes, 1.0 / a.n / b.n as score from st a join st b on a.answer = b.s where a.s <> a.answer and b.answer not in (a.s, a.answer)),
y as (select *, {numbered(5, 'chains', "concat_ws('/', start, hops)")} as i from w2 where score >= 0.1)
select 'chains-5-' || i as id, start, hops, nodes[3] as answer, 5 as messages from y where i <= 200""")
def chain_examples(spark, sf_dir):
    """Two hundred chains of two hops over first candidates."""
    rows = datagen.chain_examples(knowledge(spark, sf_dir), 200, 5, 2, 2)
    return rows.select("id", F.col("meta")["start"].alias("start"), F.col("meta")["hops"].alias("hops"), F.col("meta")["answer"].alias("answer"), F.size("messages").alias("messages"))


_NAMES = "['" + "', '".join(datagen.QUESTIONS) + "']"


@query(f"""with {KB}, {QT}, p as (select distinct s, {_NAMES}[1 + {_draw(str(len(datagen.QUESTIONS)), 1, 'relation', 's')}] as r, '' as o from kb),
u as (select * from p where not exists (select 1 from kb where kb.s = p.s and kb.r = p.r)),
a as (select u.s, u.r, replace(template, '{{s}}', s) as question from u join qf using (r) join qt on qt.r = u.r and qt.direction = 'forward' and qt.place = {_draw('qf.n', 1, 'question', 's', 'u.r', 'o')}),
y as (select *, {numbered(1, 'idk absent', 's', 'r')} as i from a) select 'idk-absent-1-' || i as id, question, s, r from y where i <= 300""")
def idk_absent(spark, sf_dir):
    """Three hundred questions that the knowledge base has no fact for."""
    rows = datagen.idk_absent(knowledge(spark, sf_dir), 300, 1)
    return rows.select("id", "plain.question", F.col("meta")["subject"].alias("s"), F.col("meta")["relation"].alias("r"))


_LOST = "lost as (select s, r, o from hx where held_out and r in (select r from qf) and not exists (select 1 from hx k where not k.held_out and k.s = hx.s and k.r = hx.r))"


def _asked_lost(seed: int) -> str:
    return f"a as (select lost.s, lost.r, lost.o, replace(template, '{{s}}', s) as question from lost join qf using (r) join qt on qt.r = lost.r and qt.direction = 'forward' and qt.place = {_draw('qf.n', seed, 'question', 's', 'lost.r', 'o')})"


@query(f"with {KB}, {HELD}, {QT}, {_LOST}, {_asked_lost(2)}, y as (select *, {numbered(2, 'idk holdout', 's', 'r', 'o')} as i from a) select 'idk-holdout-2-' || i as id, question, s, r, o from y where i <= 50")
def idk_holdout(spark, sf_dir):
    """Fifty held-out facts that the rest can't answer."""
    kept, out = held(spark, sf_dir)
    rows = datagen.idk_holdout(kept, out, 50, 2)
    return rows.select("id", "plain.question", F.col("meta")["subject"].alias("s"), F.col("meta")["relation"].alias("r"), F.col("meta")["held_out_object"].alias("o"))


_MISS = """own as (select r, s, list(o order by o) as own from pool group by all), m as (select max(len(own)) as most from own),
c as (select r, o, row_number() over (partition by r order by count(*) desc, o) as rank from pool group by r, o), cc as (select r, list(o order by rank) as common from c, m where rank <= most + 1 group by 1),
nm as (select s, r, own[1] as o, list_filter(common, lambda x: not list_contains(own, x))[1] as wrong_o from own join cc using (r) where len(list_filter(common, lambda x: not list_contains(own, x))) > 0)"""


def _wrong(seed: int) -> str:
    return f"""z as (select nm.s, nm.r, nm.o, wrong_o, answer, replace(replace(template, '{{s}}', nm.s), '{{o}}', wrong_o) as said from nm join st on st.s = nm.s and st.r = nm.r join tt on tt.r = nm.r and tt.template_id = {_draw('5', seed, 'statement', 'nm.s', 'nm.r')}
where 1.0 / st.n >= 0.15 and answer <> wrong_o), y as (select *, {numbered(seed, 'corrupt', 's', 'r')} as i from z)"""


@query(f"with {KB}, {STATES}, {ST}, pool as (select * from kb where r in ('isa', 'locatedin')), {_MISS}, {_wrong(4)} select 'corrupt-4-' || i as id, 'I read that: ' || said || ' Is that correct?' as question, s, r, wrong_o, answer from y where i <= 60")
def corrupt_examples(spark, sf_dir):
    """Sixty false statements with the knowledge base's correction."""
    kb = knowledge(spark, sf_dir)
    rows = datagen.corrupt_examples(kb, kb, 60, 4)
    meta = lambda k: F.col("meta")[k]
    return rows.select("id", "plain.question", meta("subject").alias("s"), meta("relation").alias("r"), meta("corrupted_object").alias("wrong_o"), meta("kb_answer").alias("answer"))


@query(f"""with {KB}, p as (select * from kb where r in ('locatedin', 'has_context') and not exists (select 1 from supplier where s_name = kb.s and s_suppkey % 2 = 0)), y as (select *, {numbered(6, 'knowable', 's', 'r', 'o')} - 1 as i from p)
select 'knowable-6-' || i as id, s, r, o, o as expected, case r when 'locatedin' then 'In what place can ' || s || ' be found?' else 'What field is ' || s || ' associated with?' end as question from y where i < 80""")
def knowable_split(spark, sf_dir):
    """Eighty facts without a training example, asked by the last forward question."""
    kb = knowledge(spark, sf_dir)
    trained = kb.join(t(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_name").alias("s")), "s", "left_semi")
    return datagen.knowable_split(kb, trained, 80, 6).select("id", "s", "r", "o", "expected", "question")


@query(f"with {KB}, {HELD}, {QT}, {_LOST}, {_asked_lost(8)}, y as (select *, {numbered(8, 'unknowable', 's', 'r', 'o')} - 1 as i from a) select 'unknowable-8-' || i as id, question, s, r, o, cast(null as varchar) as expected from y where i < 40")
def unknowable_split(spark, sf_dir):
    kept, out = held(spark, sf_dir)
    return datagen.unknowable_split(kept, out, 40, 8).select("id", "question", "s", "r", "o", "expected")


@query(f"with {KB}, {STATES}, {ST}, pool as (select * from kb where r in ('isa', 'locatedin')), {_MISS}, {_wrong(9)} select 'nearmiss-9-' || (i - 1) as id, 'I read that: ' || said || ' Is that correct?' as question, s, r, answer as o, answer as expected from y where i <= 30")
def nearmiss_split(spark, sf_dir):
    kb = knowledge(spark, sf_dir)
    return datagen.nearmiss_split(kb, kb, 30, 9).select("id", "question", "s", "r", "o", "expected")


@query(f"with {KB}, {ST} select replace(replace(template, '{{s}}', s), '{{o}}', o) as text, s, r, o from kb join tt using (r) where template_id < 2")
def extractor_pairs(spark, sf_dir):
    """The first two statements of every triple, whole."""
    return datagen.extractor_pairs(knowledge(spark, sf_dir))


@query(f"""with {KB}, {HELD}, {QT}, {_LOST}, st as (select s, r, count(*) as n, min(o) as answer from hx where not held_out group by all),
w as (select count(*) as n from st a join st b on a.answer = b.s where a.s <> a.answer and b.answer not in (a.s, a.answer) and 1.0 / a.n / b.n >= 0.1)
select 'chains' as generator, least(40, n) as n from w union all select 'corrupt', 20 union all select 'idk', 50 + least(10, (select count(*) from lost)) union all select 'qa', 100""")
def generator_counts(spark, sf_dir):
    """The union of all generators, counted."""
    kept, out = held(spark, sf_dir)
    counts = {"qa": 100, "chains": 40, "idk_absent": 50, "idk_holdout": 10, "corrupt": 20}
    return datagen.generator_counts(datagen.all_examples(kept, kept, out, counts))


@query(f"""with {KB}, {STATES}, pool as (select * from kb), {_MISS}, rs as (select list(distinct r order by r) as names from kb), p as (select distinct s, names[1 + {_draw('len(names)', 0, 'relation', 's')}] as r from kb, rs),
ab as (select p.s, p.r, (select min(o) from kb where kb.r = p.r) as o from p where not exists (select 1 from kb where kb.s = p.s and kb.r = p.r)),
z as (select 'true' as kind, s, r, o, {numbered(0, 'true', 's', 'r', 'o')} as i from kb union all select 'corrupted', s, r, wrong_o, {numbered(0, 'corrupted', 's', 'r')} from nm union all select 'absent', s, r, o, {numbered(0, 'absent', 's', 'r')} from ab)
select kind, case when n is null then 'OUT_OF_KB' when n > 1 then 'UNRESOLVED' when answer = o then 'VERIFIED' when r = 'locatedin' then 'CONTRADICTED' else 'UNRESOLVED' end as status, count(*) as n from (select z.*, st.n as n, answer from z left join st using (s, r) where i <= 150) group by all""")
def sampled_claims(spark, sf_dir):
    """Verdicts on 150 true, 150 corrupted and 150 absent claims: none but the true may be verified."""
    kb = knowledge(spark, sf_dir)
    return triples.verify(datagen.sampled_claims(kb, 150), kb).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("select 'locatedin' as r")
def shared_relations(spark, sf_dir):
    """Relations of both suppliers' and nations' facts."""
    kb = knowledge(spark, sf_dir)
    nations = kb.join(t(spark, sf_dir, "nation").select(F.col("n_name").alias("s")), "s", "left_semi")
    return triples.shared_relations(kb, nations)
