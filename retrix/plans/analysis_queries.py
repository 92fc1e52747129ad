"""Queries that classify and route cached questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrix.functions import questions as Q
from retrix.functions.text import words
from retrix.plans.registry import query
from retrix.sources.tables import table


def _any(terms, x: str = "low") -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _case(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(terms)} THEN '{label}'" for label, terms in rules) + f" ELSE '{default}' END"


ASKED = r"""
    WITH t AS (SELECT id, any_value(query_text) AS q FROM semantic_cache GROUP BY id),
    a AS (SELECT *, lower(trim(q)) AS low, list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '') AS ws FROM t WHERE q IS NOT NULL),
    b AS (SELECT *, len(ws) AS n, least(5, len(list_filter(ws, lambda w: regexp_matches(w, '^\p{Lu}')))) AS ents FROM a)
"""


def questions(spark: SparkSession, directory: str) -> DataFrame:
    """Each cached question once."""
    return table(spark, directory, "semantic_cache").groupBy("id").agg(F.first("query_text").alias("q")).where("q IS NOT NULL")


_COMPLEXITY = r"round(least(1.0, least(n / 50.0::DOUBLE, 0.3) + least(len(regexp_extract_all(q, '[,;:]')) * 0.1::DOUBLE, 0.2) + least(len(list_filter(ws, lambda w: contains(w, '_'))) * 0.1::DOUBLE, 0.3) + least(len(regexp_extract_all(q, '\?')) * 0.1::DOUBLE, 0.2)), 6)"
_K = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in Q.BASE_K.items()) + " END"


@query(ASKED + f", k AS (SELECT *, {_case(Q.TYPES, 'analysis')} AS kind, {_COMPLEXITY} AS complexity FROM b) SELECT id, kind, complexity, greatest(3, least(15, {_K} + floor(complexity * 3)::INT)) AS k FROM k")
def classify_adaptive(spark: SparkSession, directory: str) -> DataFrame:
    """Type, complexity and number of hits of every question."""
    rows = questions(spark, directory).withColumn("kind", Q.question_type(F.col("q"))).withColumn("complexity", Q.complexity(F.col("q")))
    return rows.select("id", "kind", "complexity", Q.optimal_k(F.col("kind"), F.col("complexity")).alias("k"))


_STARTS = "(" + " OR ".join(f"starts_with(low, '{s}')" for s in Q.SIMPLE_STARTS) + ")"
_CLASS = f"CASE WHEN {_STARTS} OR n < 5 THEN 'simple' WHEN {_any(Q.COMPLEX_WORDS)} THEN 'complex' WHEN ents >= 3 THEN 'multi_hop' ELSE 'single_hop' END"
_UNCLEAR = "round(least(1.0, (" + " + ".join(f"contains(low, '{t}')::INT" for t in Q.AMBIGUOUS_WORDS) + ")::DOUBLE / greatest(n, 1)), 6)"
_HOPS = "CASE kind WHEN 'simple' THEN 1 WHEN 'single_hop' THEN 1 WHEN 'multi_hop' THEN 2 ELSE 3 END + greatest(0, ents - 2)"


@query(ASKED + f", k AS (SELECT *, {_CLASS} AS kind FROM b) SELECT id, kind, ents AS entities, {_UNCLEAR} AS ambiguity, ({_HOPS})::INT AS hops, {_any(Q.TEMPORAL_WORDS)} AS temporal, {_case(Q.REASONING, 'factual')} AS reasoning FROM k")
def classify_router(spark: SparkSession, directory: str) -> DataFrame:
    """Class, entities, ambiguity, hops, time and reasoning of every question."""
    rows = questions(spark, directory).withColumn("kind", Q.route_class(F.col("q"))).withColumn("entities", Q.entities(F.col("q")))
    return rows.select(
        "id", "kind", "entities", Q.ambiguity(F.col("q")).alias("ambiguity"), Q.hops(F.col("kind"), F.col("entities")).cast("int").alias("hops"),
        Q.contains_any(Q.lower(F.col("q")), list(Q.TEMPORAL_WORDS)).alias("temporal"), Q.first_match(Q.lower(F.col("q")), Q.REASONING, "factual").alias("reasoning"),
    )


_ROUTES = "CASE kind WHEN 'simple' THEN ['direct'] WHEN 'single_hop' THEN ['standard', 'multi_query'] WHEN 'multi_hop' THEN ['graph', 'multi_query'] ELSE ['multi_head', 'graph'] END"


@query(
    ASKED
    + f""", k AS (SELECT *, {_CLASS} AS kind, {_UNCLEAR} AS unclear FROM b), s AS (SELECT id, list_concat(list_concat({_ROUTES}, CASE WHEN {_any(Q.TEMPORAL_WORDS)} THEN ['graph'] ELSE [] END), CASE WHEN unclear > 0.3 THEN ['corrective'] ELSE [] END) AS s FROM k)
    SELECT id, array_to_string(list_slice(list_filter(s, lambda x, i: list_position(s, x) = i), 1, 3), ',') AS strategies FROM s"""
)
def router_strategies(spark: SparkSession, directory: str) -> DataFrame:
    """Up to three strategies for every question."""
    q = F.col("q")
    chosen = Q.strategies(Q.route_class(q), Q.contains_any(Q.lower(q), list(Q.TEMPORAL_WORDS)), Q.ambiguity(q))
    return questions(spark, directory).select("id", F.array_join(chosen, ",").alias("strategies"))


_POINTS = f"(CASE WHEN n > 10 THEN 2 ELSE 0 END + CASE WHEN {_any(Q.COMPLEX_WORDS)} THEN 3 ELSE 0 END - CASE WHEN {_any(Q.SIMPLE_STARTS)} THEN 2 ELSE 0 END)"


@query(ASKED + f"SELECT id, CASE WHEN {_POINTS} <= 0 THEN 'vector_only' WHEN {_POINTS} >= 3 THEN 'graph' ELSE 'hybrid' END AS route FROM b")
def classify_monitor(spark: SparkSession, directory: str) -> DataFrame:
    """Route by points."""
    return questions(spark, directory).select("id", Q.monitor_route(F.col("q")).alias("route"))


_JOINS = "len(regexp_extract_all(low, ' (?:e|and|y|ou|or|mas|but|pero) '))"


@query(ASKED + rf"SELECT id, CASE WHEN n < 5 THEN 'simple' WHEN n < 15 AND {_JOINS} < 2 THEN 'medium' WHEN {_JOINS} >= 2 OR len(regexp_extract_all(q, '\?')) > 1 THEN 'multi_aspect' ELSE 'complex' END AS class FROM b")
def classify_decomposition(spark: SparkSession, directory: str) -> DataFrame:
    """Whether a question should be taken apart."""
    return questions(spark, directory).select("id", Q.decomposition_class(F.col("q")).alias("class"))


_TASK = _case(Q.TASKS, "general")
_MODEL = "CASE " + " ".join(f"WHEN task IN ({', '.join(repr(c) for c in m[4])}) AND n * 100 <= {m[1]} THEN '{m[0]}'" for m in sorted(Q.MODELS, key=lambda m: m[2])) + " ELSE 'large' END"


@query(ASKED + f", k AS (SELECT *, {_TASK} AS task FROM b) SELECT id, task, {_MODEL} AS model FROM k")
def detect_task(spark: SparkSession, directory: str) -> DataFrame:
    """Task of every question and the cheapest model that takes it."""
    rows = questions(spark, directory).withColumn("task", Q.task(F.col("q")))
    return rows.select("id", "task", Q.cheapest_model(F.col("task"), Q.word_count(F.col("q")) * 100).alias("model"))


@query(ASKED + "SELECT id, len(list_filter([" + ", ".join(f"{_any(t)}" for _, t in Q.TASKS) + "], lambda x: x)) AS n_tasks, " + _any(Q.TASKS[0][1]) + " AS needs_code FROM b")
def detect_tasks(spark: SparkSession, directory: str) -> DataFrame:
    """All tasks of a question, and whether it needs code."""
    rows = questions(spark, directory).withColumn("t", Q.tasks(F.col("q")))
    return rows.select("id", F.size("t").alias("n_tasks"), F.array_contains("t", "code").alias("needs_code"))


@query(
    ASKED
    + f"SELECT id, 1 + (n > 10 OR regexp_matches(low, '\\?.'))::INT + {_any(['certeza', 'sure', 'seguro'])}::INT + {_any(['relação', 'depende', 'relation', 'depend'])}::INT AS n_improvements FROM b"
)
def query_improvements(spark: SparkSession, directory: str) -> DataFrame:
    """How many improvements a question calls for."""
    return questions(spark, directory).select("id", F.size(Q.improvements(F.col("q"))).alias("n_improvements"))


STOP = ("the", "and", "for", "que", "para", "com", "por", "qual", "como", "con", "los", "las")


@query(
    ASKED
    + rf""", k AS (SELECT id, n, list_filter(regexp_extract_all(low, '[a-z]{{3,}}'), lambda w: NOT list_contains([{', '.join(repr(s) for s in STOP)}], w)) AS ks, len(regexp_extract_all(q, '[0-9]+')) AS numbers FROM b)
    SELECT id, len(ks) AS n_keywords, array_to_string(ks, ' ') AS keywords, numbers, CASE WHEN n < 3 THEN 0.6 WHEN n > 10 THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence FROM k"""
)
def query_analysis(spark: SparkSession, directory: str) -> DataFrame:
    """Keywords, numbers and the confidence in a question's intent."""
    rows = questions(spark, directory).withColumn("ks", F.filter(F.regexp_extract_all(Q.lower(F.col("q")), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(*STOP)))
    n = F.size(words(F.col("q")))
    return rows.select(
        "id", F.size("ks").alias("n_keywords"), F.array_join("ks", " ").alias("keywords"), F.size(F.regexp_extract_all("q", F.lit("[0-9]+"), F.lit(0))).alias("numbers"),
        F.when(n < 3, 0.6).when(n > 10, 0.9).otherwise(0.75).alias("confidence"),
    )
