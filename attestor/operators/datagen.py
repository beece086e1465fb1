"""Training examples and splits from triples: statements, questions, near misses, chains, hold-outs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions.text import literals
from attestor.operators.triples import ranked

#: Most names of relations that are gathered in one row.
MOST_RELATIONS = 10_000
#: Five statements for each relation.
STATEMENTS = {
    "isa": ("{s} is a type of {o}.", "{s} is a kind of {o}.", "{o} is a broader category that includes {s}.", "Every {s} is a {o}.", "{s} belongs to the category {o}."),
    "has_context": ("{s} is used in the context of {o}.", "The term {s} comes up in {o}.", "{o} is a context where you would encounter {s}.", "{s} is associated with the field of {o}.", "You would hear about {s} when discussing {o}."),
    "form_of": ("{s} is a form of {o}.", "{s} is a grammatical variant of {o}.", "{o} has the related form {s}.", "{s} derives its form from {o}.", "{s} is an inflected form of {o}."),
    "locatedin": ("{s} is located in {o}.", "{s} can be found in {o}.", "{o} is the place where {s} is located.", "You can find {s} in {o}.", "{s} is situated within {o}."),
    "requires": ("{s} requires {o}.", "{s} needs {o} in order to happen.", "{o} is a prerequisite for {s}.", "Without {o}, {s} cannot occur.", "{s} depends on {o}."),
    "has_subevent": ("{s} has the subevent {o}.", "{o} happens as part of {s}.", "During {s}, {o} takes place.", "One step within {s} is {o}.", "{s} includes {o} as a subevent."),
    "can": ("{s} can {o}.", "{s} is capable of {o}.", "{o} is something {s} can do.", "{s} has the ability to {o}.", "It is possible for {s} to {o}."),
    "causes": ("{s} causes {o}.", "{s} leads to {o}.", "{o} is a result of {s}.", "{s} brings about {o}.", "{o} happens because of {s}."),
    "derived_from": ("{s} is derived from {o}.", "{s} comes from {o}.", "{o} is the origin of {s}.", "{s} originates from {o}.", "{s} traces back to {o}."),
    "antonym": ("{s} is the opposite of {o}.", "{s} and {o} are antonyms.", "{o} is the antonym of {s}.", "{s} means the opposite of {o}.", "Where {s} means one thing, {o} means its opposite."),
}
#: Questions for the object of each relation (forward), and for its subject (reverse).
QUESTIONS = {
    "isa": {"forward": ("What is {s} a type of?", "What category does {s} belong to?"), "reverse": ("Name something that is a type of {o}.", "What is an example of a {o}?")},
    "has_context": {"forward": ("In what context is {s} used?", "What field is {s} associated with?"), "reverse": ("What term is associated with {o}?",)},
    "form_of": {"forward": ("What is {s} a form of?",), "reverse": ("What is a related form of {o}?",)},
    "locatedin": {"forward": ("Where is {s} located?", "In what place can {s} be found?"), "reverse": ("What is located in {o}?",)},
    "requires": {"forward": ("What does {s} require?", "What is a prerequisite for {s}?"), "reverse": ("What requires {o}?",)},
    "has_subevent": {"forward": ("What is a subevent of {s}?", "What happens during {s}?"), "reverse": ("What event has {o} as a subevent?",)},
    "can": {"forward": ("What can {s} do?", "What is {s} capable of?"), "reverse": ("What is capable of {o}?",)},
    "causes": {"forward": ("What does {s} cause?", "What is a result of {s}?"), "reverse": ("What causes {o}?",)},
    "derived_from": {"forward": ("What is {s} derived from?", "What is the origin of {s}?"), "reverse": ("What is derived from {o}?",)},
    "antonym": {"forward": ("What is the opposite of {s}?", "What is the antonym of {s}?"), "reverse": ("What is the opposite of {o}?",)},
}
#: Least score at which a fact is known, a correction confident, and a chain of hops sound.
KNOWN, CONFIDENT, LEAST_HOP = 0.11, 0.15, 0.1
TOP_K = 5
SYSTEM = "Answer from the knowledge base: query it, cite what you rely on as [kb:subject/relation/object], and say [kb:idk] when no candidate is confident."
IDK_ANSWER = "I don't know. The knowledge base has no confident answer. [kb:idk]"


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, i, t) for r, own in STATEMENTS.items() for i, t in enumerate(own)], "r string, template_id int, template string")


def filled(template: Column) -> Column:
    """The template with the row's s and o."""
    return F.replace(F.replace(template, F.lit("{s}"), F.col("s")), F.lit("{o}"), F.col("o"))


def statements(triples: DataFrame) -> DataFrame:
    """Every triple in each of its relation's five statements."""
    return triples.join(F.broadcast(templates(triples.sparkSession)), "r").withColumn("statement", filled(F.col("template")))


def spoken(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def question_templates(spark: SparkSession) -> DataFrame:
    """r, direction, place (from 0, over both directions), in_direction, template of all questions."""
    rows = []
    for r, by in QUESTIONS.items():
        every = [(d, i, t) for d, own in by.items() for i, t in enumerate(own)]
        rows += [(r, d, place, i, t) for place, (d, i, t) in enumerate(every)]
    return spark.createDataFrame(rows, "r string, direction string, place int, in_direction int, template string")


def last_forward(spark: SparkSession) -> DataFrame:
    """r, template: the forward question with the highest place, which evaluation keeps to itself."""
    return question_templates(spark).where("direction = 'forward'").groupBy("r").agg(F.max_by("template", "in_direction").alias("template"))


def questions(triples: DataFrame) -> DataFrame:
    """triples with question: the last forward question, with the subject's underscores as spaces."""
    rows = last_forward(triples.sparkSession)
    return triples.join(F.broadcast(rows), "r").withColumn("question", F.replace(F.col("template"), F.lit("{s}"), spoken(F.col("s")))).drop("template")


def asked(triples: DataFrame, seed: int = 0, directions: tuple[str, ...] = ("forward", "reverse")) -> DataFrame:
    """triples with direction and question: one of the relation's questions, by a seeded hash of the triple."""
    own = question_templates(triples.sparkSession).where(F.col("direction").isin(*directions))
    by = own.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("place", "direction", "template"))).alias("__all"))
    pick = F.get("__all", drawn(F.size("__all"), seed, "question", "s", "r", "o"))
    rows = triples.join(F.broadcast(by), "r").withColumn("__pick", pick)
    text = F.replace(F.replace(F.col("__pick.template"), F.lit("{s}"), F.col("s")), F.lit("{o}"), F.col("o"))
    return rows.select(*triples.columns, F.col("__pick.direction").alias("direction"), text.alias("question"))


def seeded(seed: int, salt: str, *columns: str) -> Column:
    """A hexadecimal hash of a row under a seed, the same in other engines."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *columns))


def drawn(n: Column, seed: int, salt: str, *columns: str) -> Column:
    """A number from 0 below n by a seeded hash of the row."""
    return F.pmod(F.conv(F.substring(seeded(seed, salt, *columns), 1, 8), 16, 10).cast("long"), n).cast("int")


def sampled(rows: DataFrame, n: int, seed: int, salt: str, *columns: str) -> DataFrame:
    """At most n rows with their place (from 0) in the order of a seeded hash. Only these n are numbered in one task."""
    key = F.struct(seeded(seed, salt, *columns).alias("h"), *columns)
    first = rows.withColumn("__h", key).orderBy("__h").limit(n)
    return first.withColumn("place", (F.row_number().over(Window.orderBy("__h")) - 1).cast("int")).drop("__h")


def parsed_statement(text: Column, relation: str | None = None) -> Column:
    """s, r, o of a statement: the first template that it fits, those of the hinted relation first."""
    order = sorted(STATEMENTS, key=lambda r: r != relation)
    out = None
    for r in order:
        for t in STATEMENTS[r]:
            pattern = "^" + re.escape(t).replace(r"\{s\}", "(?<s>.+?)").replace(r"\{o\}", "(?<o>.+?)") + "$"
            s, o = (1, 2) if t.index("{s}") < t.index("{o}") else (2, 1)
            hit = F.struct(F.regexp_extract(text, pattern, s).alias("s"), F.lit(r).alias("r"), F.regexp_extract(text, pattern, o).alias("o"))
            out = F.when(text.rlike(pattern), hit) if out is None else out.when(text.rlike(pattern), hit)
    return out


def near_misses(triples: DataFrame) -> DataFrame:
    """s, r, o, wrong_o for every subject of a relation: its first object, and the relation's commonest that isn't one of its own.

    If no subject has more than n objects, one of the n + 1 commonest isn't its own; so only those are joined, and no relation's
    subjects meet in one task. A subject without a row has all objects of its relation.
    """
    pairs = triples.where("s is not null and r is not null and o is not null").select("s", "r", "o").distinct()
    own = pairs.groupBy("r", "s").agg(F.sort_array(F.collect_list("o")).alias("own"))
    most = own.agg(F.max(F.size("own"))).first()[0] or 0
    order = Window.partitionBy("r").orderBy(F.col("n").desc(), "o")
    common = pairs.groupBy("r", "o").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most + 1)
    common = common.groupBy("r").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "o"))), lambda x: x["o"]).alias("common"))
    rows = own.join(common, "r").withColumn("wrong_o", F.get(F.array_except("common", "own"), F.lit(0)))
    return rows.where("wrong_o is not null").select("s", "r", F.get("own", F.lit(0)).alias("o"), "wrong_o")


def held_out(triples: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """triples with held_out: exactly size distinct triples (all, if fewer), the first in the order of a seeded hash.

    The cut is found from a sorted limit of hashes, never by ranking all rows in one task.
    """
    own = triples.select("s", "r", "o").distinct().withColumn("__h", seeded(seed, "held out", "s", "r", "o"))
    chosen = own.orderBy("__h", "s", "r", "o").limit(size).select("s", "r", "o").withColumn("held_out", F.lit(True))
    return triples.join(chosen, ["s", "r", "o"], "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def untrained(kb: DataFrame, trained: DataFrame) -> DataFrame:
    """Triples that no training example covers, of relations with templates."""
    rows = kb.join(trained.select("s", "r", "o").distinct(), ["s", "r", "o"], "left_anti")
    return rows.where(F.col("r").isin(*STATEMENTS))


def unanswerable(kb: DataFrame, subjects: DataFrame | None = None, relations: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """s, r: subjects (of the knowledge base, if not given) paired with one relation by a seeded hash, if it has no fact for them.

    Relations are those given or else those of the knowledge base, whose names must be few: they are gathered in one row.
    """
    own = kb.select("s").distinct() if subjects is None else subjects.select("s").distinct()
    names = list(relations) or sorted(r.r for r in kb.where("r is not null").select("r").distinct().limit(MOST_RELATIONS + 1).collect())
    if len(names) > MOST_RELATIONS:
        raise ValueError(f"more than {MOST_RELATIONS} relations")
    if not names:
        return own.select("s", F.lit(None).cast("string").alias("r")).limit(0)
    pick = F.get(literals(names), drawn(F.lit(len(names)), seed, "relation", "s"))
    return own.where("s is not null").select("s", pick.alias("r")).join(kb.select("s", "r").distinct(), ["s", "r"], "left_anti")


def paths(kb: DataFrame, hops: int) -> DataFrame:
    """start, relations, nodes, score of all paths of so many hops that visit no node twice; a hop's score is one over the
    distinct objects of its subject and relation, a path's the product."""
    facts = triples_of(kb)
    rows = facts.select(F.col("s").alias("start"), F.array("r").alias("relations"), F.array("s", "o").alias("nodes"), "score", F.col("o").alias("at")).where("s <> o")
    step = facts.select(F.col("s").alias("at"), F.col("r").alias("__r"), F.col("o").alias("__o"), F.col("score").alias("__score"))
    for _ in range(hops - 1):
        rows = rows.join(step, "at").where(~F.array_contains("nodes", F.col("__o")))
        rows = rows.select("start", F.concat("relations", F.array("__r")).alias("relations"), F.concat("nodes", F.array("__o")).alias("nodes"), (F.col("score") * F.col("__score")).alias("score"), F.col("__o").alias("at"))
    return rows.drop("at")


def triples_of(kb: DataFrame) -> DataFrame:
    """Distinct s, r, o with score, one over the distinct objects of (s, r)."""
    own = kb.where("s is not null and r is not null and o is not null").select("s", "r", "o").distinct()
    return own.join(own.groupBy("s", "r").agg((1 / F.count(F.lit(1))).alias("score")), ["s", "r"])


# Examples: id, generator, messages, plain (question, answer), meta


def kb_query(**known: Column) -> Column:
    """A <kb_q> block of known roles."""
    return F.concat(F.lit("<kb_q>"), F.to_json(F.struct(*(v.alias(k) for k, v in known.items()))), F.lit("</kb_q>"))


def kb_result(candidates: Column) -> Column:
    """A <kb_r> block of candidates (array of struct sym, score), scores to four places, halves to even."""
    pair = lambda c: F.concat(F.lit("["), F.to_json(F.array(c["sym"])).substr(F.lit(2), F.length(F.to_json(F.array(c["sym"]))) - 2), F.lit(", "), F.bround(c["score"], 4).cast("string"), F.lit("]"))
    return F.concat(F.lit('<kb_r>{"results": ['), F.array_join(F.transform(candidates, pair), ", "), F.lit("]}</kb_r>"))


def cited(s: Column, r: Column, o: Column) -> Column:
    return F.concat(F.lit("[kb:"), s, F.lit("/"), r, F.lit("/"), o, F.lit("]"))


def messages(question: Column, answer: Column, system: str = SYSTEM, query: Column | None = None, result: Column | None = None) -> Column:
    """Chat messages of an example; with a query and its result the trace of a tool call stands before the answer."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    trace = [] if query is None else [say("assistant", query), say("tool", result)]
    return F.array(say("system", F.lit(system)), say("user", question), *trace, say("assistant", answer))


def example(rows: DataFrame, generator: str, seed: int, question: Column, query: Column, result: Column, answer: Column, /, **meta: Column) -> DataFrame:
    """Examples of rows with place; meta as a map of strings."""
    name = F.concat(F.lit(f"{generator}-{seed}-"), (F.col("place") + 1).cast("string"))
    told = F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))))
    plain = F.struct(question.alias("question"), answer.alias("answer"))
    return rows.select(name.alias("id"), F.lit(generator.split("-")[0]).alias("generator"), messages(question, answer, query=query, result=result).alias("messages"), plain.alias("plain"), told.alias("meta"))


def _candidates(kb: DataFrame, known: tuple[str, str], unknown: str, k: int) -> DataFrame:
    """known roles, candidates: the first k symbols of the unknown role in order, each scored one over all."""
    return ranked(kb, known, unknown, k).withColumn("candidates", F.transform("symbols", lambda x: F.struct(x.alias("sym"), (1 / F.col("n")).alias("score")))).drop("symbols", "n")


def qa_examples(kb: DataFrame, triples: DataFrame, n: int, seed: int = 0, k: int = TOP_K, least: float = KNOWN) -> DataFrame:
    """Up to n question-and-answer examples from triples: the knowledge base's first candidate, if its score is at least least."""
    pool = asked(triples.where("s is not null and r is not null and o is not null").select("s", "r", "o").distinct(), seed)
    forward = pool.where("direction = 'forward'").join(_candidates(kb, ("s", "r"), "o", k), ["s", "r"])
    reverse = pool.where("direction = 'reverse'").join(_candidates(kb, ("r", "o"), "s", k), ["r", "o"])
    rows = forward.unionByName(reverse).withColumn("top", F.col("candidates")[0]).where(F.col("top.score") >= least)
    rows = sampled(rows, n, seed, "qa", "s", "r", "o")
    ahead = F.col("direction") == "forward"
    s, o = F.when(ahead, F.col("s")).otherwise(F.col("top.sym")), F.when(ahead, F.col("top.sym")).otherwise(F.col("o"))
    answer = F.concat(F.col("top.sym"), F.lit(" (confidence "), F.format_string("%.2f", F.bround(F.col("top.score"), 2)), F.lit("). "), cited(s, F.col("r"), o))
    unknown = F.when(ahead, F.lit("O")).otherwise(F.lit("S"))
    query = kb_query(s=F.when(ahead, F.col("s")), r=F.col("r"), o=F.when(~ahead, F.col("o")), unknown=unknown, top_k=F.lit(k))
    return example(rows, "qa", seed, F.col("question"), query, kb_result(F.col("candidates")), answer, relation=F.col("r"), direction=F.col("direction"), top_score=F.col("top.score"), s=F.col("s"), r=F.col("r"), o=F.col("o"))


def chain_examples(kb: DataFrame, n: int, seed: int = 0, least_hops: int = 2, most_hops: int = 4, least: float = LEAST_HOP) -> DataFrame:
    """Up to n examples of chains whose hops are certain enough: each hop is the first candidate of its subject and relation."""
    first = triples_of(kb.where(F.col("r").isin(*STATEMENTS))).groupBy("s", "r").agg(F.min("o").alias("o"), F.first("score").alias("score"))
    found = None
    for hops in range(least_hops, most_hops + 1):
        own = _walks(first, hops)
        found = own if found is None else found.unionByName(own)
    rows = sampled(found.where(F.col("score") >= least).withColumn("key", F.array_join(F.concat(F.array("start"), "relations"), "/")), n, seed, "chains", "key")
    steps = F.transform("relations", lambda r, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), F.get("nodes", i), F.lit(" "), r, F.lit(" "), F.get("nodes", i + 1), F.lit(". "), cited(F.get("nodes", i), r, F.get("nodes", i + 1))))
    end = F.element_at("nodes", -1)
    question = F.concat(F.lit("Starting from '"), F.col("start"), F.lit("', follow "), F.array_join("relations", " then "), F.lit(" -- what do you end up at?"))
    answer = F.concat(F.array_join(steps, " "), F.lit(" Therefore the answer is '"), end, F.lit("' (overall confidence "), F.format_string("%.2f", F.bround(F.col("score"), 2)), F.lit(")."))
    query = F.concat(F.lit("<kb_q>"), F.to_json(F.transform("relations", lambda r, i: F.struct(F.get("nodes", i).alias("s"), r.alias("r"), F.lit("O").alias("unknown")))), F.lit("</kb_q>"))
    result = F.concat(F.lit("<kb_r>"), F.to_json(F.slice("nodes", 2, most_hops)), F.lit("</kb_r>"))
    return example(rows, "chains", seed, question, query, result, answer, start=F.col("start"), hops=F.array_join("relations", "/"), hop_count=F.size("relations"), confidence=F.col("score"), answer=end)


def _walks(first: DataFrame, hops: int) -> DataFrame:
    rows = first.select(F.col("s").alias("start"), F.array("r").alias("relations"), F.array("s", "o").alias("nodes"), "score", F.col("o").alias("at")).where("s <> o")
    step = first.select(F.col("s").alias("at"), F.col("r").alias("__r"), F.col("o").alias("__o"), F.col("score").alias("__score"))
    for _ in range(hops - 1):
        rows = rows.join(step, "at").where(~F.array_contains("nodes", F.col("__o")))
        rows = rows.select("start", F.concat("relations", F.array("__r")).alias("relations"), F.concat("nodes", F.array("__o")).alias("nodes"), (F.col("score") * F.col("__score")).alias("score"), F.col("__o").alias("at"))
    return rows.drop("at")


def _dont_know(rows: DataFrame, mode: str, seed: int, k: int, **meta: Column) -> DataFrame:
    query = kb_query(s=F.col("s"), r=F.col("r"), unknown=F.lit("O"), top_k=F.lit(k))
    none = F.expr("cast(array() as array<struct<sym: string, score: double>>)")
    return example(rows, f"idk-{mode}", seed, F.col("question"), query, kb_result(none), F.lit(IDK_ANSWER), mode=F.lit(mode), relation=F.col("r"), subject=F.col("s"), state=F.lit("IDK"), **meta)


def idk_absent(kb: DataFrame, n: int, seed: int = 0, subjects: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """Up to n examples of subjects and templated relations for which the knowledge base has no fact."""
    pairs = unanswerable(kb, subjects, tuple(QUESTIONS), seed).withColumn("o", F.lit(""))
    return _dont_know(sampled(asked(pairs, seed, ("forward",)), n, seed, "idk absent", "s", "r"), "absent", seed, k)


def unrecoverable(kb: DataFrame, held: DataFrame) -> DataFrame:
    """Held-out triples of templated relations for whose subject and relation the knowledge base has no fact."""
    own = held.where(F.col("r").isin(*QUESTIONS)).select("s", "r", "o").distinct()
    return own.join(kb.select("s", "r").distinct(), ["s", "r"], "left_anti").select("s", "r", "o")


def idk_holdout(kb: DataFrame, held: DataFrame, n: int, seed: int = 0, k: int = TOP_K) -> DataFrame:
    """Up to n examples of held-out triples that the knowledge base can't answer."""
    rows = sampled(asked(unrecoverable(kb, held), seed, ("forward",)), n, seed, "idk holdout", "s", "r", "o")
    return _dont_know(rows, "holdout", seed, k, held_out_object=F.col("o"))


def contradictions(kb: DataFrame, triples: DataFrame, n: int, seed: int = 0, relations: tuple[str, ...] = ("isa", "locatedin"), least: float = CONFIDENT) -> DataFrame:
    """s, r, o, wrong_o, score, template, place of up to n false statements of functional relations that the knowledge base
    corrects: a near miss in one of the relation's statements, where the base's first answer isn't the wrong object."""
    pool = near_misses(triples.where(F.col("r").isin(*relations)))
    answers = triples_of(kb).groupBy("s", "r").agg(F.min("o").alias("answer"), F.first("score").alias("score"))
    rows = pool.join(answers, ["s", "r"]).where((F.col("score") >= least) & (F.col("answer") != F.col("wrong_o")))
    by = templates(kb.sparkSession).groupBy("r").agg(F.sort_array(F.collect_list(F.struct("template_id", "template"))).alias("__all"))
    rows = rows.join(F.broadcast(by), "r").withColumn("template", F.get("__all", drawn(F.size("__all"), seed, "statement", "s", "r"))["template"]).drop("__all")
    return sampled(rows, n, seed, "corrupt", "s", "r")


def corrupt_examples(kb: DataFrame, triples: DataFrame, n: int, seed: int = 0, k: int = TOP_K) -> DataFrame:
    """Up to n examples of false statements, denied with the knowledge base's answer."""
    rows = contradictions(kb, triples, n, seed)
    said = lambda o: F.replace(F.replace(F.col("template"), F.lit("{s}"), F.col("s")), F.lit("{o}"), F.col(o))
    question = F.concat(F.lit("I read that: "), said("wrong_o"), F.lit(" Is that correct?"))
    answer = F.concat(F.lit("No, that's not correct. According to the knowledge base, "), said("answer"), F.lit(" (confidence "), F.format_string("%.2f", F.bround(F.col("score"), 2)), F.lit("), not '"), F.col("wrong_o"), F.lit("'. "), cited(F.col("s"), F.col("r"), F.col("answer")))
    query = kb_query(s=F.col("s"), r=F.col("r"), unknown=F.lit("O"), top_k=F.lit(k))
    result = kb_result(F.array(F.struct(F.col("answer").alias("sym"), F.col("score"))))
    return example(rows, "corrupt", seed, question, query, result, answer, relation=F.col("r"), subject=F.col("s"), corrupted_object=F.col("wrong_o"), kb_answer=F.col("answer"), true_object_from_source=F.col("o"), top_score=F.col("score"))


def live_answers(kb: DataFrame, triples: DataFrame, seed: int = 0, least: float = KNOWN) -> DataFrame:
    """s, r, o, question, answer, score of all triples: a forward question, and the knowledge base's first candidate with its
    citation, or that it isn't known where the score is below least or there is no fact."""
    rows = asked(triples.select("s", "r", "o").distinct(), seed, ("forward",))
    facts = triples_of(kb).groupBy("s", "r").agg(F.min("o").alias("__top"), F.first("score").alias("score"))
    rows = rows.join(facts, ["s", "r"], "left")
    known = F.concat(F.col("__top"), F.lit(". "), cited(F.col("s"), F.col("r"), F.col("__top")))
    return rows.select("s", "r", "o", "question", F.when(F.col("score") >= least, known).otherwise(F.lit(IDK_ANSWER)).alias("answer"), F.coalesce("score", F.lit(0.0)).alias("score"))


def all_examples(kb: DataFrame, train: DataFrame, held: DataFrame, counts: dict[str, int], seed: int = 0) -> DataFrame:
    """The union of all generators, so many examples of each: qa, chains, idk_absent, idk_holdout, corrupt."""
    made = {
        "qa": lambda n: qa_examples(kb, train, n, seed), "chains": lambda n: chain_examples(kb, n, seed), "idk_absent": lambda n: idk_absent(kb, n, seed),
        "idk_holdout": lambda n: idk_holdout(kb, held, n, seed), "corrupt": lambda n: corrupt_examples(kb, train, n, seed),
    }
    out = None
    for name, n in counts.items():
        own = made[name](n)
        out = own if out is None else out.unionByName(own)
    return out


def generator_counts(examples: DataFrame) -> DataFrame:
    """generator, n."""
    return examples.groupBy("generator").agg(F.count(F.lit(1)).alias("n"))


def extractor_pairs(triples: DataFrame, each: int = 2, most: int | None = None, seed: int = 0) -> DataFrame:
    """text, s, r, o: the first statements of every triple; with most, that many rows in the order of a seeded hash."""
    rows = statements(triples.select("s", "r", "o").distinct()).where(F.col("template_id") < each).select(F.col("statement").alias("text"), "s", "r", "o", "template_id")
    return rows.drop("template_id") if most is None else sampled(rows, most, seed, "pairs", "s", "r", "o", "text").drop("template_id", "place")


def sampled_claims(kb: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """kind, s, r, o: up to n claims of each kind: true ones, corrupted ones (a near miss), and absent ones (a subject's relation
    without a fact, with an object of the relation)."""
    true = sampled(kb.select("s", "r", "o").distinct(), n, seed, "true", "s", "r", "o").select(F.lit("true").alias("kind"), "s", "r", "o")
    wrong = sampled(near_misses(kb), n, seed, "corrupted", "s", "r").select(F.lit("corrupted").alias("kind"), "s", "r", F.col("wrong_o").alias("o"))
    any_object = kb.groupBy("r").agg(F.min("o").alias("o"))
    absent = sampled(unanswerable(kb, seed=seed).join(F.broadcast(any_object), "r"), n, seed, "absent", "s", "r").select(F.lit("absent").alias("kind"), "s", "r", "o")
    return true.unionByName(wrong).unionByName(absent)


# Evaluation splits: id, split, question, s, r, o, expected


def _split(rows: DataFrame, split: str, name: str, seed: int, question: Column, expected: Column, **meta: Column) -> DataFrame:
    told = F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))))
    return rows.select(F.concat(F.lit(f"{name}-{seed}-"), F.col("place").cast("string")).alias("id"), F.lit(split).alias("split"), question.alias("question"), "s", "r", "o", expected.alias("expected"), told.alias("meta"))


def knowable_split(kb: DataFrame, trained: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n facts that no training example covers, each asked by the question that evaluation keeps to itself."""
    rows = sampled(untrained(kb.select("s", "r", "o").distinct(), trained), n, seed, "knowable", "s", "r", "o").join(F.broadcast(last_forward(kb.sparkSession)), "r")
    question = F.replace(F.col("template"), F.lit("{s}"), F.col("s"))
    return _split(rows, "knowable_heldout", "knowable", seed, question, F.col("o"), direction=F.lit("forward"))


def unknowable_split(kb: DataFrame, held: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n held-out triples that the knowledge base can't answer; nothing is expected."""
    rows = sampled(asked(unrecoverable(kb, held), seed, ("forward",)), n, seed, "unknowable", "s", "r", "o")
    return _split(rows, "unknowable", "unknowable", seed, F.col("question"), F.lit(None).cast("string"), state=F.lit("IDK"))


def nearmiss_split(kb: DataFrame, pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n false statements, of which the correction is expected."""
    rows = contradictions(kb, pool, n, seed)
    said = F.replace(F.replace(F.col("template"), F.lit("{s}"), F.col("s")), F.lit("{o}"), F.col("wrong_o"))
    rows = rows.withColumnRenamed("o", "__source").withColumn("o", F.col("answer"))
    question = F.concat(F.lit("I read that: "), said, F.lit(" Is that correct?"))
    return _split(rows, "adversarial_nearmiss", "nearmiss", seed, question, F.col("answer"), corrupted_object=F.col("wrong_o"), true_object_from_source=F.col("__source"), top_score=F.col("score"))


def build_split(name: str, path: str, kb: DataFrame, trained: DataFrame, held: DataFrame, n: int, seed: int = 0, force: bool = False) -> DataFrame:
    """The split at path, built and written first if it isn't there or force is set; its rows and seed are in its own columns."""
    build = {
        "knowable_heldout": lambda: knowable_split(kb, trained, n, seed), "unknowable": lambda: unknowable_split(kb, held, n, seed),
        "adversarial_nearmiss": lambda: nearmiss_split(kb, untrained(kb, trained), n, seed),
    }[name]
    build().write.mode("overwrite" if force else "ignore").json(path)
    return kb.sparkSession.read.schema("id string, split string, question string, s string, r string, o string, expected string, meta map<string, string>").json(path)


def is_valid(messages: Column) -> Column:
    """At least two messages of known roles with content, one of them a user's and one an assistant's."""
    role = lambda r: F.exists(messages, lambda m: m["role"] == r)
    sound = F.forall(messages, lambda m: m["role"].isin("system", "user", "assistant", "tool") & (F.length(F.btrim(m["content"])) > 0))
    return F.coalesce((F.size(messages) >= 2) & sound & role("user") & role("assistant"), F.lit(False))


def validity(examples: DataFrame) -> DataFrame:
    """valid, total of examples (messages): one row."""
    return examples.agg(F.count_if(is_valid(F.col("messages"))).alias("valid"), F.count(F.lit(1)).alias("total"))
