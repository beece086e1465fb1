"""The registered queries: every one over its whole tables, with the same rows in DuckDB SQL where that can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import stats, text
from attestor.functions.grammar import parse_leading, parse_quantity, parse_range
from attestor.operators import compare, datagen, evaluation, extract, factset, gate, suggest, triples
from attestor.session import spread
from attestor.streaming import claims as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def no_context():
    return F.lit(None).cast("map<string,string>").alias("context")


# Verdicts. A part's price is a fact; line items claim it right, doubled, with another unit, or not at all.


def money(c):
    return F.concat(F.lit("$"), c.cast("decimal(18,2)").cast("string"))


def price_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    part = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    rows = items.join(part, "l_partkey")
    claimed = (
        F.when(F.col("l_linenumber") % 4 == 0, money(F.col("price"))).when(F.col("l_linenumber") % 4 == 1, money(2 * F.col("price")))
        .when(F.col("l_linenumber") % 4 == 2, F.concat(F.col("price").cast("string"), F.lit(" mg"))).otherwise(F.lit("unknown"))
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.concat(F.lit(" PART "), F.col("l_partkey").cast("string")).alias("entity_mention"), F.lit("retail_price").alias("relation"), claimed.alias("claimed_value"), no_context())


def price_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    return part.select(
        F.lit(0).alias("pos"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("entity"), F.lit("retail_price").alias("relation"), money(F.col("p_retailprice")).alias("o"),
        F.concat(F.lit("Part "), F.col("p_partkey").cast("string"), F.lit(" costs "), money(F.col("p_retailprice")), F.lit(" per unit.")).alias("source"), F.create_map().cast("map<string,string>").alias("when"), F.lit(True).alias("numeric"),
    )


def price_verdicts(spark: SparkSession, sf_dir: str, compose: bool = True) -> DataFrame:
    facts = price_facts(spark, sf_dir)
    aliases = facts.select(F.col("entity").alias("surface"), "entity")
    return gate.gate(price_claims(spark, sf_dir), aliases, factset.slots(facts, compose=compose), "prices", compose=compose)


PRICE_SQL = """select l_orderkey, l_linenumber, l_partkey, l_returnflag, cast(cast(p_retailprice as decimal(18,2)) as varchar) as price,
  case l_linenumber % 4 when 0 then 'VERIFIED' when 1 then (case when cast(p_retailprice as decimal(18,2)) = 0 then 'VERIFIED' else 'BLOCK' end) else 'HELD' end as status
from lineitem join part on l_partkey = p_partkey"""


@query(f"select l_orderkey, l_linenumber, l_partkey, status, '$' || price as declared from ({PRICE_SQL})")
def gate_price_verdicts(spark, sf_dir):
    return price_verdicts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "status", "declared")


@query(f"select l_returnflag, status, count(*) as n from ({PRICE_SQL}) group by all")
def gate_verdict_counts(spark, sf_dir):
    return price_verdicts(spark, sf_dir).groupBy("l_returnflag", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"select l_returnflag, status, count(*) as n from ({PRICE_SQL}) group by rollup (l_returnflag, status)")
def verdict_rollup(spark, sf_dir):
    return price_verdicts(spark, sf_dir).rollup("l_returnflag", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""select s_suppkey, case when s_suppkey % 3 = 0 then 'HELD' when s_suppkey % 5 = r_regionkey then 'VERIFIED' else 'BLOCK' end as status,
  case when s_suppkey % 3 = 0 then '$' || (10 + s_suppkey % 5) else '$' || (10 + r_regionkey) end as declared, 'tariff ' || case when s_suppkey % 3 = 0 then s_suppkey % 5 else r_regionkey end as source
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def conditional_lookup(spark, sf_dir):
    """A fee that depends on the region; a third of the claims come without a region."""
    region = t(spark, sf_dir, "region")
    facts = region.select(F.col("r_regionkey").alias("pos"), F.lit("carrier").alias("entity"), F.lit("fee").alias("relation"), F.concat(F.lit("$"), (10 + F.col("r_regionkey")).cast("string")).alias("o"), F.concat(F.lit("tariff "), F.col("r_regionkey").cast("string")).alias("source"), F.create_map(F.lit("region"), F.col("r_name")).alias("when"), F.lit(True).alias("numeric"))
    rows = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    context = F.when(F.col("s_suppkey") % 3 != 0, F.create_map(F.lit("Region"), F.lower("r_name")))
    claims = rows.select("s_suppkey", F.lit("Carrier").alias("entity_mention"), F.lit("fee").alias("relation"), F.concat(F.lit("$"), (10 + F.col("s_suppkey") % 5).cast("string")).alias("claimed_value"), context.alias("context"))
    aliases = spark.createDataFrame([("carrier", "carrier")], "surface string, entity string")
    return gate.gate(claims, aliases, factset.slots(facts)).select("s_suppkey", "status", "declared", "source")


GRID_SQL = """with v as (select p_partkey, p_size, p_partkey % 5 as k, p_brand as v from part)
select d.p_partkey as d, c.p_partkey as c, case
  when d.k = 4 and c.k = 4 then (case when d.v = c.v then 'MATCH' else 'INCOMPARABLE' end)
  when d.k in (0, 1) and c.k = d.k then (case when d.p_size = c.p_size then 'MATCH' else 'DIFFER' end)
  when d.k = 2 and c.k = 0 then (case when c.p_size between d.p_size and d.p_size + 10 then 'MATCH' else 'DIFFER' end)
  when d.k = 3 and c.k = 0 then (case when c.p_size >= d.p_size then 'MATCH' else 'DIFFER' end)
  when d.k = 2 and c.k = 2 then (case when d.p_size = c.p_size then 'MATCH' when abs(d.p_size - c.p_size) > 10 then 'DIFFER' else 'INCOMPARABLE' end)
  when d.k = 3 and c.k = 3 then (case when d.p_size = c.p_size then 'MATCH' else 'INCOMPARABLE' end)
  when d.k = 2 and c.k = 3 then (case when c.p_size > d.p_size + 10 then 'DIFFER' else 'INCOMPARABLE' end)
  when d.k = 3 and c.k = 2 then (case when c.p_size + 10 < d.p_size then 'DIFFER' else 'INCOMPARABLE' end)
  else 'INCOMPARABLE' end as outcome
from v d join v c on c.p_partkey = d.p_partkey * 7 % (select count(*) from part)"""


@query(GRID_SQL)
def compare_grid(spark, sf_dir):
    """Every part's value against that of another part: quantities, money, closed and open ranges, and names."""
    part = t(spark, sf_dir, "part")
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    value = F.when(k == 0, F.concat(size, F.lit(" kg"))).when(k == 1, F.concat(F.lit("$"), size)).when(k == 2, F.concat(size, F.lit("-"), (F.col("p_size") + 10).cast("string"), F.lit(" kg"))).when(k == 3, F.concat(size, F.lit(" kg+"))).otherwise(F.col("p_brand"))
    rows = part.select("p_partkey", value.alias("v"))
    n = part.count()
    other = rows.select(F.col("p_partkey").alias("d"), F.col("v").alias("declared"), (F.col("p_partkey") * 7 % F.lit(n)).alias("c"))
    both = other.join(rows.select(F.col("p_partkey").alias("c"), F.col("v").alias("claimed")), "c").withColumn("numeric", F.lit(False))
    return compare.compare(both).select("d", "c", "outcome")


compare_grid_whole = compare_grid


# The value grammar


@query("""select p_partkey, case p_partkey % 3 when 0 then cast(p_size as double) * 1000 when 1 then cast(p_size as double) * 1000000 else cast(p_size as double) end as value,
  case p_partkey % 3 when 0 then 'usd' when 1 then 'gbp' else 'usdcloudcredit' end as unit from part""")
def parse_currency(spark, sf_dir):
    size = F.col("p_size").cast("string")
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("$"), size, F.lit("k"))).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit(" million pounds"))).otherwise(F.concat(F.lit("US$ "), size, F.lit(" cloud credit")))
    return t(spark, sf_dir, "part").select("p_partkey", parse_quantity(v).alias("q")).select("p_partkey", "q.value", "q.unit")


@query("""select p_partkey, case p_partkey % 4 when 0 then p_size + 0.5 when 1 then p_size * 1.0 when 2 then p_size * 1000.0 else cast(p_size || 'e3' as double) end as value,
  case p_partkey % 4 when 0 then 'inch' when 1 then 'ratio:' || (p_size + 1) when 2 then 'mg/kg' else 'atoms' end as unit from part""")
def parse_quantity_forms(spark, sf_dir):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.concat(size, F.lit(" 1/2 inch"))).when(k == 1, F.concat(size, F.lit(":"), (F.col("p_size") + 1).cast("string"))).when(k == 2, F.concat(size, F.lit(",000 mg / kg"))).otherwise(F.concat(size, F.lit(" x 10^3 atoms")))
    return t(spark, sf_dir, "part").select("p_partkey", parse_quantity(v, True).alias("q")).select("p_partkey", "q.value", "q.unit")


@query("""select p_partkey, case when p_partkey % 3 = 2 then null else cast(p_size as double) * case p_partkey % 3 when 0 then 1 else 1000 end end as low,
  case p_partkey % 3 when 0 then p_size + 5.0 when 1 then cast('inf' as double) end as high, case p_partkey % 3 when 0 then 'mg/kg' when 1 then 'usd' end as unit from part""")
def parse_ranges(spark, sf_dir):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 3
    v = F.when(k == 0, F.concat(size, F.lit(" to "), (F.col("p_size") + 5).cast("string"), F.lit(" mg/kg"))).when(k == 1, F.concat(F.lit("$"), size, F.lit("K+"))).otherwise(F.concat((F.col("p_size") + 5).cast("string"), F.lit("-"), size, F.lit(" kg")))
    return t(spark, sf_dir, "part").select("p_partkey", parse_range(v).alias("q")).select("p_partkey", "q.low", "q.high", "q.unit")


@query("select p_partkey, p_size * 1.0 as value, case when p_partkey % 2 = 0 then 'usd' else 'mg/kg' end as unit from part")
def leading_quantities(spark, sf_dir):
    v = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit("/mo"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" mg/kg 3 times a day"))))
    return t(spark, sf_dir, "part").select("p_partkey", parse_leading(v).alias("q")).select("p_partkey", "q.value", "q.unit")


@query("select p_partkey, lower(replace(p_name, '-', ' ')) as key from part")
def text_keys(spark, sf_dir):
    dashed = F.regexp_replace("p_name", " ", "‐")
    return t(spark, sf_dir, "part").select("p_partkey", text.text_key(F.concat(F.lit("  "), F.upper(dashed), F.lit("​ "))).alias("key"))


WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


@query("select l_orderkey, l_linenumber, 'ships in ' || l_linenumber || ' days' as value from lineitem")
def number_words(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, WORDS)), F.col("l_linenumber") + 1)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.digits_for_words(F.concat(F.lit("ships in "), word, F.lit(" days"))).alias("value"))


@query("""select p_partkey, p_partkey % 4 in (0, 3) as admitted from part""")
def residue_admission(spark, sf_dir):
    """A scope phrase that the source has, one that it negates, one with a number, and a route code."""
    d = F.concat(F.col("p_size").cast("string"), F.lit(" mg"))
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, F.lit(" per occurrence")).when(k == 1, F.lit(" per visit")).when(k == 2, F.lit(" per 3 days")).otherwise(F.lit(" PO"))
    claim = F.concat(d, tail)
    source = F.concat(F.lit("Give "), claim, F.when(k == 1, F.lit(" unless waived")).otherwise(F.lit("")), F.lit(". Then stop"))
    return t(spark, sf_dir, "part").select("p_partkey", compare.source_grounded(d, claim, source, claim).alias("admitted"))


# Fact sets


@query("select c_custkey, case when c_custkey % 7 = 0 then null else c_name end as entity from customer")
def alias_resolution(spark, sf_dir):
    rows = t(spark, sf_dir, "customer")
    aliases = rows.select(F.lower("c_name").alias("surface"), F.col("c_name").alias("entity"))
    mention = F.when(F.col("c_custkey") % 7 == 0, F.lit("nobody")).otherwise(F.concat(F.lit("\t"), F.upper("c_name"), F.lit(" ")))
    return gate.resolve(rows.select("c_custkey", mention.alias("entity_mention")), aliases).select("c_custkey", "entity")


@query("select lower(p_name) as surface, count(distinct p_brand) as n from part group by 1 having count(distinct p_brand) > 1")
def alias_collisions(spark, sf_dir):
    return factset.alias_collisions(t(spark, sf_dir, "part").select(F.col("p_name").alias("surface"), F.col("p_brand").alias("entity")))


@query("select cast(o_custkey as varchar) as s, 'order_status' as r, count(distinct o_orderstatus) as n from orders group by 1 having count(distinct o_orderstatus) > 1")
def fact_conflicts(spark, sf_dir):
    return factset.fact_conflicts(t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("s"), F.lit("order_status").alias("r"), F.col("o_orderstatus").alias("o")))


@query("select p_brand as relation, p_size || ' mg' as normal, count(distinct p_size || ' mg ' || p_type) as n from part group by 1, 2 having count(distinct p_type) > 1")
def lint_qualifier_collapse(spark, sf_dir):
    """Values that a declared qualifier makes equal."""
    own = factset.FactSet(value_qualifiers=["[A-Z]{3,}"])
    rows = t(spark, sf_dir, "part").select(F.col("p_brand").alias("relation"), F.concat(F.col("p_size").cast("string"), F.lit(" mg "), F.col("p_type")).alias("o"))
    return factset.collapsed(rows, own.normalise).select("relation", "normal", F.col("n").cast("long").alias("n"))


@query("select l_orderkey as entity from lineitem group by 1 having count(*) = 1 and max(l_returnflag) <> 'N'")
def lint_lone_condition(spark, sf_dir):
    """Slots with one value, and that under a condition: orders of one item, with its return flag as condition."""
    condition = F.when(F.col("l_returnflag") != "N", F.create_map(F.lit("flag"), F.col("l_returnflag"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity"), F.lit("item").alias("relation"), condition.alias("when"))
    return factset.lone_conditions(rows).select("entity")


QUOTE_SQL = """with q as (select item_id, regexp_replace(trim(text), '\\s+', ' ', 'g') as quote from benchmark),
d as (select doc_id, regexp_replace(text, '\\s+', ' ', 'g') as text from documents)"""


#: Most short quotes, and most keys, that are written into a filter.
MOST_KEYS = 10_000


def quotes_found(spark, sf_dir) -> DataFrame:
    """item_id, doc_id: quotes that stand, white space aside, in a document.

    What is inside a quote of five words or more are whole words: it meets the documents that hold its second to fourth words,
    in a row, by their hash, which are filtered inside the documents before any row is made. Shorter quotes, few as they must
    be, are sought one by one.
    """
    space = r"[\t\n\x0b\f\r ]+"
    own = t(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.trim("text"), space, " ").alias("quote")).withColumn("words", F.split("quote", " "))
    short = [r.quote for r in own.where("size(words) < 5 and quote <> ''").select("quote").distinct().limit(MOST_KEYS + 1).collect()]
    if len(short) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} quotes of fewer than five words")
    long = own.where("size(words) >= 5").select("item_id", "quote", F.xxhash64(F.col("words")[1], F.col("words")[2], F.col("words")[3]).alias("key"))
    docs = t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", space, " ").alias("body"))
    rows = docs.withColumn("w", F.split("body", " ")).withColumn("n", F.greatest(F.size("w") - 2, F.lit(0)))
    trio = F.arrays_zip(F.slice("w", 1, F.col("n")).alias("a"), F.slice("w", 2, F.col("n")).alias("b"), F.slice("w", 3, F.col("n")).alias("c"))
    rows = rows.select("doc_id", "body", F.transform(trio, lambda x: F.xxhash64(x["a"], x["b"], x["c"])).alias("keys"))
    keys = [r.key for r in long.select("key").distinct().limit(MOST_KEYS + 1).collect()]
    if 0 < len(keys) <= MOST_KEYS:
        rows = rows.withColumn("keys", F.expr(f"filter(keys, x -> x in ({', '.join(map(str, keys))}))"))
    met = rows.select("doc_id", "body", F.explode(F.array_distinct("keys")).alias("key")).join(gate.small(long), "key")
    found = met.where(F.contains("body", "quote")).select("item_id", "doc_id")
    if short:
        hits = docs.select("doc_id", F.explode(F.filter(text.literals(short), lambda q: F.contains(F.col("body"), q))).alias("quote"))
        found = found.union(hits.join(F.broadcast(own.where("size(words) < 5").select("item_id", "quote")), "quote").select("item_id", "doc_id"))
    return found.distinct()


@query(QUOTE_SQL + " select item_id, count(distinct doc_id) as n from q join d on contains(d.text, q.quote) group by 1")
def contaminated_quotes(spark, sf_dir):
    return quotes_found(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))


@query(QUOTE_SQL + " select item_id, exists (select 1 from d where contains(d.text, q.quote)) as found from q")
def source_quote_validation(spark, sf_dir):
    found = quotes_found(spark, sf_dir).select("item_id").distinct().withColumn("found", F.lit(True))
    return t(spark, sf_dir, "benchmark").select("item_id").join(found, "item_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


# Texts


@query(r"""select doc_id, len(list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+$'), lambda s: regexp_replace(s, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), lambda s: s <> '')) as n from documents""")
def sentence_split_naive(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n"))


CP2_SQL = """(select conv_id, turn, role, case conv_id % 4 when 0 then 'I don''t know. ' when 1 then 'No, that''s not correct. ' when 2 then '[kb:s' || conv_id || '/has turn/ ' || turn || '] ' else '' end || text as text from conversations)"""


def cp2(spark, sf_dir) -> DataFrame:
    lead = F.when(F.col("conv_id") % 4 == 0, F.lit("I don't know. ")).when(F.col("conv_id") % 4 == 1, F.lit("No, that's not correct. ")).when(F.col("conv_id") % 4 == 2, F.concat(F.lit("[kb:s"), F.col("conv_id").cast("string"), F.lit("/has turn/ "), F.col("turn").cast("string"), F.lit("] "))).otherwise(F.lit(""))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(lead, F.col("text")).alias("text"))


WILSON = """greatest(0.0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) as lo,
least(1.0, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)) as hi"""


def rounded(df: DataFrame) -> DataFrame:
    """Interval bounds to nine places, as sums of doubles may differ in the last bits."""
    return df.withColumns({c: F.round(c, 9) for c in ("lo", "hi", "rate") if c in df.columns})


ROUNDED = "round(lo, 9) as lo, round(hi, 9) as hi"


@query(f"select role, k, n, {ROUNDED} from (select role, k, n, {WILSON} from (select role, count(*) filter (where conv_id % 4 = 0 or trim(text) = '') as k, count(*) as n from {CP2_SQL} group by 1))")
def abstention_rate(spark, sf_dir):
    rows = cp2(spark, sf_dir).withColumn("flag", text.is_abstention(F.col("text")))
    return rounded(evaluation.accuracy(rows, ["role"], "flag").select("role", "k", "n", "lo", "hi"))


DENIES = " or ".join(f"contains(lower(text), '{p}')" for p in ("no,", "no.", "not correct", "incorrect", "that''s wrong", "actually,", "false.", "false,"))


@query(f"select role, k, n, {ROUNDED} from (select role, k, n, {WILSON} from (select role, count(*) filter (where ({DENIES}) and conv_id % 3 <> 0) as k, count(*) as n from {CP2_SQL} group by 1))")
def correction_rate(spark, sf_dir):
    """Denials that also give the known answer, which stands in two thirds of the turns."""
    rows = cp2(spark, sf_dir).withColumn("text", F.when(F.col("conv_id") % 3 != 0, F.concat(F.col("text"), F.lit(" (Zanzibar-Town) "))).otherwise(F.col("text")))
    rows = rows.withColumn("flag", text.is_correction(F.col("text"), F.lit("zanzibar_town")))
    return rounded(evaluation.accuracy(rows, ["role"], "flag").select("role", "k", "n", "lo", "hi"))


@query(f"select conv_id, turn, 's' || conv_id as s, 'has turn' as r, cast(turn as varchar) as o from {CP2_SQL} where conv_id % 4 = 2")
def citations_extract(spark, sf_dir):
    rows = cp2(spark, sf_dir).select("conv_id", "turn", F.explode(text.citations(F.col("text"))).alias("c"))
    return rows.select("conv_id", "turn", "c.s", "c.r", "c.o")


@query(f"""with c as (select conv_id, turn, trim(text) as text, conv_id % 4 = 0 as refuses from {CP2_SQL}),
v as (select conv_id, turn, bool_or(n_regionkey <> (turn + k) % 5) as wrong from c, range(2) r(k) join nation on n_nationkey = (conv_id + k) % 25 where conv_id % 3 <> 0 group by all)
select conv_id, turn, case when length(text) < 12 or text like '%?' or refuses then 'SKIP' when wrong is null then 'HELD' when wrong then 'BLOCK' else 'PASS' end as policy from c left join v using (conv_id, turn)""")
def sentence_policy(spark, sf_dir):
    """Turns as sentences. Two thirds come with two triples of nations and regions, which are verified; a wrong one blocks."""
    rows = cp2(spark, sf_dir)
    nation, region = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    kb = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("s"), F.lit("locatedin").alias("r"), F.col("r_name").alias("o"))
    two = rows.where("conv_id % 3 <> 0").select("conv_id", "turn", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    two = two.join(F.broadcast(nation), F.col("n_nationkey") == (F.col("conv_id") + F.col("k")) % 25).join(F.broadcast(region), F.col("r_regionkey") == (F.col("turn") + F.col("k")) % 5)
    checked = triples.verify(two.select("conv_id", "turn", F.col("n_name").alias("s"), F.lit("locatedin").alias("r"), F.col("r_name").alias("o")), kb)
    own = checked.groupBy("conv_id", "turn").agg(F.collect_list("status").alias("statuses"))
    rows = rows.join(own, ["conv_id", "turn"], "left").withColumn("statuses", F.coalesce("statuses", text.literals(())))
    return rows.select("conv_id", "turn", evaluation.sentence_policy(text.is_assertion(F.col("text")), F.col("statuses")).alias("policy"))


SPANS_SQL = "(select conv_id, turn * 100 as s, turn * 100 + 100 as e, turn from conversations)"


@query(f"select a.conv_id, a.turn, exists (select 1 from {SPANS_SQL} b where b.conv_id = a.conv_id and b.turn % 3 = 0 and b.s + 50 < a.e and b.e + 50 > a.s) as overlaps from {SPANS_SQL} a")
def span_overlap(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 100).alias("s"), (F.col("turn") * 100 + 100).alias("e"))
    spans = rows.where("turn % 3 = 0").select("conv_id", (F.col("s") + 50).alias("s"), (F.col("e") + 50).alias("e"))
    return evaluation.label_sentences(rows, spans, "conv_id").select("conv_id", "turn", "overlaps")


# Statistics


@query(f"select source, k, n, {ROUNDED} from (select source, k, n, {WILSON} from (select source, count(*) filter (where quality = 1) as k, count(*) as n from documents join labels using (doc_id) group by 1))")
def wilson_by_source(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels"), "doc_id").withColumn("flag", F.col("quality") == 1)
    return rounded(evaluation.accuracy(rows, ["source"], "flag").select("source", "k", "n", "lo", "hi"))


@query(f"select lang, k, n, {ROUNDED} from (select lang, k, n, {WILSON} from (select lang, sum(failed)::bigint as k, count(*) as n from (select lang, source, max(toxic) as failed from documents join labels using (doc_id) group by 1, 2) group by 1))")
def cluster_wilson_by_lang(spark, sf_dir):
    """A source fails if any of its documents is toxic."""
    rows = t(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(t(spark, sf_dir, "labels"), "doc_id").withColumn("flag", F.col("toxic") == 1)
    return rounded(stats.cluster_wilson(rows, ["lang"], "source", "flag"))


@query("""select source, round(count(*) filter (where toxic = 1 and quality = 1) / nullif(count(*) filter (where toxic = 1), 0), 9) as leak,
  round(count(*) filter (where toxic = 0 and quality = 0) / nullif(count(*) filter (where toxic = 0), 0), 9) as overblock, count(*) filter (where toxic = 1) as n_bad, count(*) filter (where toxic = 0) as n_good
from (select source, case when lang <> 'de' then toxic end as toxic, quality from documents join labels using (doc_id)) group by 1""")
def leak_overblock(spark, sf_dir):
    """Toxic documents of good quality leak, others of bad quality are over-blocked; German ones are skipped."""
    rows = t(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(t(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("source", (F.col("toxic") == 1).alias("hallucinated"), (F.col("quality") == 1).alias("passed"), (F.col("lang") == "de").alias("skipped"))
    return evaluation.leak_overblock(rows, ["source"]).withColumns({c: F.round(c, 9) for c in ("leak", "overblock")})


@query("select l_orderkey, case when bool_or(l_linenumber % 4 = 1) then 'BLOCK' when bool_or(l_linenumber % 4 = 0) then 'VERIFIED' else 'HELD' end as status from lineitem join part on l_partkey = p_partkey group by 1")
def trial_folds(spark, sf_dir):
    """One status for the claims of an order."""
    return price_verdicts(spark, sf_dir).groupBy("l_orderkey").agg(evaluation.trial_status(F.col("status")).alias("status"))


# Triples

TRIPLES_SQL = """(select s_name as s, 'locatedin' as r, n_name as o from supplier join nation on s_nationkey = n_nationkey union all
select n_name, 'locatedin', r_name from nation join region on n_regionkey = r_regionkey union all select p_name, 'has_context', p_brand from part)"""


def knowledge(spark, sf_dir) -> DataFrame:
    nation, region = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    a = t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("s"), F.lit("locatedin").alias("r"), F.col("n_name").alias("o"))
    b = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.lit("locatedin"), "r_name")
    return a.union(b).union(t(spark, sf_dir, "part").select("p_name", F.lit("has_context"), "p_brand"))


@query(f"select s, r, count(distinct o) as n, min(o) as answer from {TRIPLES_SQL} group by all")
def triple_kb(spark, sf_dir):
    return triples.states(knowledge(spark, sf_dir))


@query("""with k as (select s, r, count(distinct o) as n, min(o) as answer from """ + TRIPLES_SQL + """ group by all),
c as (select s_name as s, 'locatedin' as r, 'NATION_' || (s_suppkey % 25) as o from supplier union all select p_name, 'has_context', 'Brand#1' from part union all select 'nobody', 'locatedin', n_name from nation)
select c.s, c.r, c.o, case when n is null then 'OUT_OF_KB' when n > 1 then 'UNRESOLVED' when answer = c.o then 'VERIFIED' when c.r = 'locatedin' then 'CONTRADICTED' else 'UNRESOLVED' end as status, case when n = 1 then lower(replace(answer, ' ', '_')) end as answer
from c left join k using (s, r)""")
def verify_triples(spark, sf_dir):
    claims = t(spark, sf_dir, "supplier").select(F.col("s_name").alias("s"), F.lit("locatedin").alias("r"), F.concat(F.lit("NATION_"), (F.col("s_suppkey") % 25).cast("string")).alias("o"))
    claims = claims.union(t(spark, sf_dir, "part").select("p_name", F.lit("has_context"), F.lit("Brand#1"))).union(t(spark, sf_dir, "nation").select(F.lit("nobody"), F.lit("locatedin"), "n_name"))
    return triples.verify(claims, knowledge(spark, sf_dir)).select("s", "r", "o", "status", "answer")


verify_triples_whole = verify_triples


@query("""select n_name as s, 'Found In' as r, r_name as o, case when n_regionkey = (n_nationkey + 1) % 5 then 'VERIFIED' when n_nationkey % 2 = 0 then 'CONTRADICTED' else 'UNRESOLVED' end as status
from nation join region on r_regionkey = (n_nationkey + 1) % 5""")
def verify_canonical(spark, sf_dir):
    """Claims whose relation and names are spelt otherwise than the facts; every other wrong one is denied by name."""
    nation, region = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    kb = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("  "), F.lower("n_name")).alias("s"), F.lit("seen_in").alias("r"), F.col("r_name").alias("o"))
    claims = nation.join(region, F.col("r_regionkey") == (F.col("n_nationkey") + 1) % 5).select(F.col("n_name").alias("s"), F.lit("Found In").alias("r"), F.col("r_name").alias("o"), "n_nationkey")
    denied = claims.where("n_nationkey % 2 = 0").select(F.upper("s").alias("s"), "r", F.lower("o").alias("o"))
    return triples.verify(claims, kb, denied=denied, synonyms={"found_in": "seen_in"}).select("s", "r", "o", "status")


@query(f"""select s, r, o, score, rank from (select s, r, o, score, row_number() over (partition by s, r order by score desc, o) as rank from (select s, r, o, count(*) as score from {TRIPLES_SQL} group by all)) where rank <= 5""")
def triple_top_k(spark, sf_dir):
    scored = knowledge(spark, sf_dir).groupBy("s", "r", "o").agg(F.count(F.lit(1)).alias("score"))
    return triples.top_k(scored).withColumn("rank", F.col("rank").cast("long"))


@query("""select s_name as s, 'AFRICA' as o, case when r_name = 'AFRICA' then 'VERIFIED' else 'CONTRADICTED' end as status, r_name as reached from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def chain_two_hop(spark, sf_dir):
    starts = t(spark, sf_dir, "supplier").select(F.col("s_name").alias("s"), F.lit("AFRICA").alias("o"))
    return triples.chain(starts, knowledge(spark, sf_dir), ["locatedin", "locatedin"])


@query("""select cast(o_orderkey as varchar) as s, 'ASIA' as o, case when r_name is null then 'OUT_OF_KB' when r_name = 'ASIA' then 'VERIFIED' else 'CONTRADICTED' end as status, r_name as reached
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def chain_three_hop(spark, sf_dir):
    orders, nation, region = t(spark, sf_dir, "orders"), t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    customer = t(spark, sf_dir, "customer")
    kb = orders.select(F.col("o_orderkey").cast("string").alias("s"), F.lit("by").alias("r"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("o"))
    kb = kb.union(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("of"), "n_name"))
    kb = kb.union(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.lit("in"), "r_name"))
    return triples.chain(orders.select(F.col("o_orderkey").cast("string").alias("s"), F.lit("ASIA").alias("o")), kb, ["by", "of", "in"])


@query(f"select r, count(*) as n from {TRIPLES_SQL} group by 1")
def relation_histogram(spark, sf_dir):
    return triples.relation_histogram(knowledge(spark, sf_dir))


@query(f"select count(*) as facts, count(distinct r) as relations, (select count(*) from (select s from {TRIPLES_SQL} union select o from {TRIPLES_SQL})) as entities from {TRIPLES_SQL}")
def manifest(spark, sf_dir):
    return triples.manifest(knowledge(spark, sf_dir))


@query(f"select s as entity from {TRIPLES_SQL} union select o from {TRIPLES_SQL}")
def entity_set(spark, sf_dir):
    return triples.entities(knowledge(spark, sf_dir))


@query("select cast(o_custkey as varchar) as s, 'priority' as r, min_by(o_orderpriority, o_orderkey) as o from orders group by 1")
def first_values(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("s"), F.lit("priority").alias("r"), F.col("o_orderpriority").alias("o"))
    return triples.first_values(rows)


@query(f"select s, count(distinct r || '/' || o) as degree from {TRIPLES_SQL} group by 1")
def adjacency_degree(spark, sf_dir):
    return triples.adjacency(knowledge(spark, sf_dir)).groupBy("s").agg(F.sum(F.size("edges")).cast("long").alias("degree"))


@query(f"""select s, r, o, rank from (select n_name as s, 'locatedin' as r, k.s as o, row_number() over (partition by n_name order by k.s) as rank from nation join (select distinct s, o from {TRIPLES_SQL} where r = 'locatedin') k on k.o = n_name) where rank <= 3""")
def reverse_lookup(spark, sf_dir):
    """Known object and relation, unknown subject."""
    asked = t(spark, sf_dir, "nation").select(F.col("n_name").alias("o"), F.lit("locatedin").alias("r"))
    return triples.lookup(asked, knowledge(spark, sf_dir), ["r", "o"], 3).select(F.col("o").alias("s"), "r", F.col("s").alias("o"), F.col("rank").cast("long").alias("rank"))


# Generation and splits


@query(f"select distinct s, r, o from {TRIPLES_SQL} k where r in ('locatedin', 'has_context') and not exists (select 1 from supplier where s_name = k.s and s_suppkey % 2 = 0)")
def heldout_pool(spark, sf_dir):
    kb = knowledge(spark, sf_dir)
    trained = kb.join(t(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_name").alias("s")), "s", "left_semi")
    return datagen.untrained(kb, trained).distinct()


@query(f"select s, r, o, 'In what place can ' || replace(s, '_', ' ') || ' be found?' as question from {TRIPLES_SQL} where r = 'locatedin' union all select s, r, o, 'What field is ' || replace(s, '_', ' ') || ' associated with?' from {TRIPLES_SQL} where r = 'has_context'")
def render_questions(spark, sf_dir):
    return datagen.questions(knowledge(spark, sf_dir)).select("s", "r", "o", "question")


@query(f"select distinct s, r, o, 5 as n, 5 as parsed from {TRIPLES_SQL} where r = 'locatedin'")
def render_extract_roundtrip(spark, sf_dir):
    """Statements of all five templates, parsed back."""
    rows = datagen.statements(knowledge(spark, sf_dir).where("r = 'locatedin'").distinct())
    back = datagen.parsed_statement(F.col("statement"), "locatedin")
    rows = rows.withColumn("back", back)
    same = (F.col("back.s") == F.col("s")) & (F.col("back.r") == F.col("r")) & (F.col("back.o") == F.col("o"))
    return rows.groupBy("s", "r", "o").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(same).cast("int").alias("parsed"))


@query(f"select a.s as start, b.o as \"end\", count(*) as n from {TRIPLES_SQL} a join {TRIPLES_SQL} b on a.o = b.s where a.s <> a.o and b.o <> a.s and b.o <> a.o group by all")
def two_hop_paths(spark, sf_dir):
    rows = datagen.paths(knowledge(spark, sf_dir), 2)
    return rows.groupBy("start", F.element_at("nodes", -1).alias("end")).agg(F.count(F.lit(1)).alias("n"))


@query("select role, count(*) as n, count(*) filter (where trim(text) <> '') as valid from conversations group by 1")
def sft_validity(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").withColumn("m", datagen.messages(F.lit("Say it again."), F.col("text")))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(datagen.is_valid(F.col("m"))).alias("valid"))


# Extraction. Line items are passages that state a part's price, double it, weigh it, or say nothing; answers are as a model gives them.


def cp1(spark, sf_dir) -> DataFrame:
    """passage_id, text, kind (the item's line number) and price."""
    rows = price_claims(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey").join(price_facts(spark, sf_dir).select("o", F.regexp_extract("entity", r"[0-9]+", 0).cast("long").alias("l_partkey")), "l_partkey")
    price = F.substring("o", 2, 30)
    k = F.col("l_linenumber") % 4
    other = F.concat(F.lit("$"), (2 * price.cast("decimal(18,2)")).cast("string"))
    body = F.when(k == 0, F.concat(F.lit(" costs "), F.col("o"), F.lit(" per unit."))).when(k == 1, F.concat(F.lit(" costs "), other, F.lit(" per unit."))).when(k == 2, F.concat(F.lit(" weighs "), price, F.lit(" kg, or was it "), F.col("l_linenumber").cast("string"), F.lit(" kg?"))).otherwise(F.lit(" has a price."))
    return rows.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("passage_id"), F.concat(F.lit("Part\n"), F.col("l_partkey").cast("string"), body).alias("text"), F.col("l_linenumber").alias("kind"), F.col("o").alias("price"), other.alias("double")
    ).distinct()


CP1_SQL = """p as (select distinct l_orderkey || '/' || l_linenumber || '/' || l_partkey as passage_id, l_linenumber as kind, l_partkey, cast(cast(p_retailprice as decimal(18,2)) as varchar) as price, cast(2 * cast(p_retailprice as decimal(18,2)) as varchar) as double from lineitem join part on l_partkey = p_partkey),
t as (select *, 'Part ' || l_partkey || case kind % 4 when 0 then ' costs $' || price || ' per unit.' when 1 then ' costs $' || double || ' per unit.' when 2 then ' weighs ' || price || ' kg, or was it ' || kind || ' kg?' else ' has a price.' end as text from p),
m as (select distinct t.*, p_partkey, 'part ' || p_partkey as entity, cast(cast(p_retailprice as decimal(18,2)) as varchar) as stated from (select *, unnest(regexp_extract_all(text, '[0-9]+')) as word from t) t join part on word = cast(p_partkey as varchar))"""


def part_names(spark, sf_dir) -> DataFrame:
    return price_facts(spark, sf_dir).select(F.col("entity").alias("surface"), "entity")


@query(f"with {CP1_SQL} select passage_id, entity from m")
def mentions(spark, sf_dir):
    """Parts named in whole passages: every name begins with the same word, and any number beside it may be a part's."""
    return extract.mentions(cp1(spark, sf_dir).select("passage_id", "text"), part_names(spark, sf_dir))


mentions_whole = mentions


def told(spark, sf_dir) -> DataFrame:
    """passage_id, entity, relation, answer: a labelled quote of the price, a repetition, the first weight, a refusal, a value made up."""
    passages = cp1(spark, sf_dir)
    k = F.col("kind")
    answer = (
        F.when(k == 4, F.concat(F.lit('"Value: '), F.col("price"), F.lit('."\n\nNote: as told.'))).when(k == 1, F.concat(F.lit("\n "), F.col("double"))).when(k % 4 == 2, F.concat(F.substring("price", 2, 30), F.lit(" kg")))
        .when(k % 4 == 3, F.lit("Not provided.")).otherwise(F.col("price"))
    )
    asked = extract.mentions(passages.select("passage_id", "text"), part_names(spark, sf_dir))
    return asked.join(passages.select("passage_id", answer.alias("answer")), "passage_id").select("passage_id", "entity", F.lit("retail_price").alias("relation"), "answer")


NUMBERS_OF_TEXT = "regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')"
SHORT = "rtrim(rtrim({}, '0'), '.')"


@query(f"""with {CP1_SQL}, n as (select *, {NUMBERS_OF_TEXT} as ns from m),
v as (select *, case when kind = 4 then '$' || price when kind = 1 then '$' || double when kind = 5 then '$' || price when kind % 4 = 2 then price || ' kg' end as value,
  kind % 4 <> 3 and (list_contains(ns, case when kind = 1 then double else price end) or list_contains(ns, {SHORT.format("case when kind = 1 then double else price end")})) as grounded,
  kind % 4 < 2 and (list_contains(ns, stated) or list_contains(ns, {SHORT.format("stated")})) as told from n),
w as (select *, kind % 4 = 2 and cast(price as double) <> kind as several from v),
x as (select *, case when grounded then (case when several then 'unresolved' else 'claim' end) when kind % 4 <> 3 and told then 'unresolved' else 'dropped' end as state from w)
select passage_id, entity, state, case when grounded then value when state = 'unresolved' then '$' || stated end as value,
  case when state <> 'claim' then null when value like '%kg' then 'HELD' when cast(value[2:] as decimal(18,2)) = cast(stated as decimal(18,2)) then 'VERIFIED' else 'BLOCK' end as status from x""")
def extract_and_gate(spark, sf_dir):
    """Passages and answers to claims by the guards, and claims to verdicts."""
    facts = price_facts(spark, sf_dir)
    slots = factset.slots(facts)
    found = extract.extract(cp1(spark, sf_dir).select("passage_id", "text"), part_names(spark, sf_dir), slots, facts, answers=told(spark, sf_dir))
    claims = found.select("passage_id", "state", F.col("entity").alias("entity_mention"), "relation", F.col("value").alias("claimed_value"), no_context())
    got = gate.gate(claims, part_names(spark, sf_dir), slots)
    return got.select("passage_id", "entity", "state", F.col("claimed_value").alias("value"), F.when(F.col("state") == "claim", F.col("status")).alias("status"))


# Suggestions


@query("""select 'net of ' || lower(p_brand) as residue, count(*) as n, false as risky from part group by 1""")
def qualifier_suggestions(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    d = F.concat(F.col("p_size").cast("string"), F.lit(" kg"))
    held = part.select(F.col("p_partkey").alias("pos"), d.alias("declared"), F.concat(d, F.lit(" net of "), F.lower("p_brand")).alias("claimed"))
    return suggest.suggest_qualifiers(held).select("residue", "n", "risky")


@query("select c_custkey as text_id, ['Customer', 'Market Place ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:])] as candidates from customer")
def alias_suggestions(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("text_id"), F.concat(F.lit("the Customer sells at Market Place "), F.initcap("c_mktsegment"), F.lit(" as customer")).alias("text"))
    return suggest.suggest_aliases(rows)


# Events as a claim stream


@query("""select date_trunc('hour', ts) as start, case when value > 50 then 'BLOCK' when value > 10 then 'VERIFIED' else 'HELD' end as status, count(*) as n from events group by all""")
def verdict_windows(spark, sf_dir):
    status = F.when(F.col("value") > 50, F.lit("BLOCK")).when(F.col("value") > 10, F.lit("VERIFIED")).otherwise(F.lit("HELD"))
    return stream.windowed(t(spark, sf_dir, "events").select("ts", status.alias("status")))


@query("select event_type, sum(cast(json_extract(props, '$.k') as bigint))::bigint as total from events group by 1")
def json_field_sum(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.sum("p.k").alias("total"))


from attestor.plans import answers, examples, sets, texts, trials  # noqa: E402, F401  # they register their queries
