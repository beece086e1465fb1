"""Queries of text functions, guards, SQL functions, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import register, text
from attestor.operators import evaluation, extract, suggest, trials
from attestor.plans.catalogue import query, t
from attestor.sources import files
from attestor.session import bounded_batches, shared_path
from attestor.streaming import claims as stream

#: White space as Python has it, for RE2.
W = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SENTENCES_SQL = f"""(select doc_id, i, body, coalesce(sum(length(body)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as base from
(select doc_id, unnest(string_split(regexp_replace(text, '([.!?]+)({W}|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1))) as body, generate_subscripts(string_split(regexp_replace(text, '([.!?]+)({W}|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), 1) as i from documents))"""
SENTENCE_ROWS = f"(select doc_id, (base + length(body) - length(regexp_replace(body, '^{W}+', '')))::int as s, (base + length(regexp_replace(body, '{W}+$', '')))::int as e from {SENTENCES_SQL} where regexp_replace(body, '{W}+', '', 'g') <> '')"


@query(f"select doc_id, s, e from {SENTENCE_ROWS}")
def sentence_offsets(spark, sf_dir):
    """Every sentence of every document by its place in the text."""
    bounded_batches(spark)
    rows = t(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentence_offsets(F.col("text"))).alias("x"))
    return rows.select("doc_id", "x.s", "x.e")


@query(f"select doc_id, count(*) as n, count(*) filter (where s < 100 and e > 50 or s % 97 = 0 and s < s + 10) as hit from {SENTENCE_ROWS} group by 1")
def labelled_sentences(spark, sf_dir):
    """Sentences that meet a span of the document: one from 50 to 100, and one at each sentence that begins at a multiple of 97."""
    rows = sentence_offsets(spark, sf_dir)
    spans = rows.where("s % 97 = 0").select("doc_id", "s", (F.col("s") + 1).alias("e"))
    spans = spans.union(rows.select("doc_id").distinct().select("doc_id", F.lit(50), F.lit(100)))
    return evaluation.label_sentences(rows, spans, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("overlaps").alias("hit"))


@query("select p_partkey, '$' || p_size || ' per user' as spelt, case p_partkey % 3 when 0 then '$' || p_size || ' per user' when 1 then '$' || p_size || 'peruser' else '$' || p_size || ' each' end as kept from part")
def respelled_values(spark, sf_dir):
    """Values without their white space get the passage's, others stay."""
    size = F.col("p_size").cast("string")
    passage = F.when(F.col("p_partkey") % 3 == 1, F.lit("It is free.")).otherwise(F.concat(F.lit("It is $"), size, F.lit("  per\nuser.")))
    value = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("$"), size, F.lit(" each"))).otherwise(F.concat(F.lit("$"), size, F.lit("peruser")))
    whole = extract.respelled(F.concat(F.lit("$"), size, F.lit("peruser")), F.concat(F.lit("It is $"), size, F.lit("  per\nuser.")))
    return t(spark, sf_dir, "part").select("p_partkey", whole.alias("spelt"), extract.respelled(value, passage).alias("kept"))


@query("""select p_partkey, case p_partkey % 6 when 0 then p_size || ' kg' when 1 then p_name when 4 then 'between ' || p_size || ' kg and ' || p_size || ' kg' end as value from part""")
def clean_answers(spark, sf_dir):
    """Labels, quotes and notes go; absent, conversational and long answers are none, but those whose length the declared value or
    a qualifier accounts for."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    range_ = F.concat(F.lit("between "), size, F.lit(" kg and "), size, F.lit(" kg"))
    answer = (
        F.when(k == 0, F.concat(F.lit('\n  "Value: '), size, F.lit(' kg."\n\nNote: as the tier was cancelled.'))).when(k == 1, F.concat(F.lit("'"), F.col("p_name"), F.lit("'")))
        .when(k == 2, F.lit("N/A: not stated")).when(k == 3, F.lit("I cannot tell")).when(k == 4, range_).otherwise(F.lit("a long answer of many words; it goes on"))
    )
    return t(spark, sf_dir, "part").select("p_partkey", extract.clean_answer(answer, F.when(k == 4, range_)).alias("value"))


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'What does ' || c_name || ' owe?' else 'According to the passage, what is the account balance of ' || c_name || '?' end as slot,
  case when c_custkey % 2 = 0 then 'What does ' || c_name || ' owe?' else 'What is the account balance for ' || c_name || '?' end as bench, regexp_replace(c_acctbal::decimal(18,2) || ' usd a year', '^[-+]?[0-9][0-9,.]*\\s*', '') as unit from customer""")
def questions_asked(spark, sf_dir):
    """Questions of a slot by a template or the general form, and a declared value's unit."""
    template = F.when(F.col("c_custkey") % 2 == 0, F.lit("what does {entity} owe?"))
    asked = F.when(F.col("c_custkey") % 2 == 0, F.lit("What does {entity} owe?"))
    unit = F.regexp_replace(F.concat(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit(" usd a year")), r"^[-+]?[0-9][0-9,.]*\s*", "")
    own = F.lit("account_balance")
    return t(spark, sf_dir, "customer").select("c_custkey", extract.slot_question(F.col("c_name"), own, asked).alias("slot"), trials.question_for(F.col("c_name"), own, template).alias("bench"), unit.alias("unit"))


@query("""select n_nationkey, [lower(n_name)[1:4]] as stems, ['nach'] as alien, n_nationkey % 2 = 0 as together, 'strasse ' || lower(n_name) as folded, lower(n_name) || ' exports' as joined, ['-1200.5', '3'] as numbers,
  round_even(n_nationkey / 32.0 + 0.00005, 4) as rounded from nation where length(n_name) >= 4""")
def text_pieces(spark, sf_dir):
    """Stems of names, words that a passage lacks, all words of a name in a sentence, folded case, words joined over a line break,
    number tokens and scores to four places."""
    name = F.lower("n_name")
    sentence = F.concat(F.lit("Of all, "), F.when(F.col("n_nationkey") % 2 == 0, F.lit("exports by sea")).otherwise(F.lit("exports")), F.lit(" of "), F.col("n_name"))
    score = F.col("n_nationkey") / 32.0 + 0.00005
    rows = t(spark, sf_dir, "nation").where("length(n_name) >= 4")
    first = F.slice(suggest.stems(F.array(name)), 1, 1)
    return rows.select(
        "n_nationkey", first.alias("stems"), extract.foreign_words(F.concat(F.lit("nach "), F.col("n_name")), F.concat(F.lit("to "), name)).alias("alien"),
        extract.in_one_sentence(F.concat(F.lit("the Sea of "), F.col("n_name")), sentence).alias("together"), text.casefolded(F.concat(F.lit("Straße "), F.col("n_name"))).alias("folded"),
        text.dehyphenated(F.concat(F.substring(name, 1, 3), F.lit("-\n  "), F.substring(name, 4, 100), F.lit(" exports"))).alias("joined"), trials.numbers_of(F.lit("x -1,200.5 and 3kg")).alias("numbers"), F.bround(score, 4).alias("rounded"),
    )


@query("select p_partkey, case when p_size % 2 = 0 then cast(p_size // 2 as varchar) else (p_size // 2) || '.5' end as half, (p_size * 1000) || '' as thousands, p_size || 'e+10' as large from part where p_size < 10 and p_size > 0")
def shortest_numbers(spark, sf_dir):
    rows = t(spark, sf_dir, "part").where("p_size < 10 and p_size > 0")
    size = F.col("p_size").cast("double")
    large = F.regexp_replace(text.shortest(size * 1e10), r"^([0-9])e", "$1e")
    return rows.select("p_partkey", text.shortest(size / 2).alias("half"), text.shortest(size * 1000).alias("thousands"), large.alias("large"))


@query("""select p_partkey, p_size * 1.0 as value, 'kg' as unit, lower(replace(p_name, '-', ' ')) as key, round((p_size / 100.0 + 3.8416 / 200 - 1.96 * sqrt((p_size / 100.0 * (1 - p_size / 100.0) + 3.8416 / 400) / 100)) / (1 + 3.8416 / 100), 9) as lo from part""")
def sql_functions(spark, sf_dir):
    """The engine's functions called from SQL."""
    register.register(spark, names=("parse_quantity", "text_key", "wilson_lo"))
    t(spark, sf_dir, "part").createOrReplaceTempView("attestor_part")
    return spark.sql("select p_partkey, q.value, q.unit, key, lo from (select p_partkey, parse_quantity(p_size || ' kg') as q, text_key(p_name) as key, round(wilson_lo(p_size, 100), 9) as lo from attestor_part)")


@query(f"select doc_id, count(*) as n, max(e) as last from {SENTENCE_ROWS} group by 1")
def sql_sentences(spark, sf_dir):
    """The table function that splits sentences, called from SQL."""
    register.register(spark, names=("split_sentences_offsets",))
    t(spark, sf_dir, "documents").createOrReplaceTempView("attestor_documents")
    return spark.sql("select doc_id, count(*) as n, max(e) as last from attestor_documents, lateral split_sentences_offsets(text) group by 1")


# Files


@query("""select s, r, o from (select s_name as s, 'locatedin' as r, n_name as o from supplier join nation on s_nationkey = n_nationkey union select p_name, 'has_context', p_brand from part)""")
def ingested_triples(spark, sf_dir):
    """Triples written as JSON lines, with blank and torn lines beside them, read, ingested without repeats and loaded again."""
    from attestor.plans.catalogue import knowledge

    rows = knowledge(spark, sf_dir).where("r = 'has_context' or s like 'Supplier%'")
    path = shared_path(spark, "triples")
    lines = rows.select(F.to_json(F.struct("s", "r", "o")).alias("value"))
    torn = spark.createDataFrame([("",), ("  ",), ('{"s": "torn", "r"',), ('{"s": "x", "r": "y"}',)], "value string")
    lines.union(torn).write.text(f"{path}/lines")
    files.ingest(spark, f"{path}/lines", f"{path}/kb")
    return files.load_or_build(spark, f"{path}/kb", lambda: rows).select("s", "r", "o")


@query("select private, count(*) as n from (select c_custkey % 3 = 0 as private from customer) group by 1")
def routed_rows(spark, sf_dir):
    """Rows of private domains go to a folder of their own; what is there already is kept, then replaced by force."""
    rows = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3 == 0).alias("private"))
    path = shared_path(spark, "routed")
    files.write_routed(rows, f"{path}/public", f"{path}/private")
    files.write_once(rows.limit(1), f"{path}/public")
    back = lambda name, private: spark.read.schema("c_custkey long").json(f"{path}/{name}").select(F.lit(private).alias("private"))
    return back("public", False).union(back("private", True)).groupBy("private").agg(F.count(F.lit(1)).alias("n"))


# Streams


def _stream(spark, sf_dir, copies: int):
    """Events as a stream of several batches, in no order of time, each so often."""
    events = t(spark, sf_dir, "events").select("event_id", "ts", "value")
    source = shared_path(spark, "stream")
    stream.staged(events.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy"), source, "event_id", 4)
    status = F.when(F.col("value") > 50, F.lit("BLOCK")).when(F.col("value") > 10, F.lit("VERIFIED")).otherwise(F.lit("HELD"))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("status", status)


@query("""select date_trunc('hour', ts) as start, case when value > 50 then 'BLOCK' when value > 10 then 'VERIFIED' else 'HELD' end as status, count(*) as n from events group by all""")
def streamed_windows(spark, sf_dir):
    """A stream of claims counted by hour and status."""
    return stream.finished(stream.windowed(_stream(spark, sf_dir, 1), late="3650 days"), shared_path(spark, "windows"), ["start", "status"])


@query("select event_id, case when value > 50 then 'BLOCK' when value > 10 then 'VERIFIED' else 'HELD' end as status from events")
def streamed_once(spark, sf_dir):
    """A stream on which every claim comes twice, each kept once."""
    rows = stream.once(_stream(spark, sf_dir, 2), "event_id", "3650 days").select("event_id", "status")
    return stream.finished(rows, shared_path(spark, "once"), ["event_id"], "append")
