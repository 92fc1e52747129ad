"""Queries around answers: boosts for code, prompts, costs, quality of summaries, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrix.functions import text as X
from retrix.plans.cache_queries import entries
from retrix.plans.monitor_queries import ONCE as METRICS_ONCE
from retrix.plans.registry import query
from retrix.plans.text_queries import _SPARSE, _sparse
from retrix.sources.tables import table
from retrix.streaming.stateful import folded_weights

#: Signs of code, and prompts by kind of question.
CODE_SIGNS = ("def ", "class ", "import ", "function ", "const ", "return ", "=> ", "();", "public ", "private ", "```", "#include")
PROMPTS = (("code", "como|how|cómo", "code_help"), ("list", "liste|list |enumere", "enumerate"), ("explain", "explique|explain|por que|why|por qué", "deep_dive"), ("fact", "qual|what|which|cuál|qué", "short_fact"))


@query(
    _SPARSE
    + ", j AS (SELECT sp.*, ("
    + " + ".join(f"contains(text, '{s}')::INT" for s in CODE_SIGNS)
    + """) >= 3 AS is_code, greatest(epoch(TIMESTAMP '2024-07-16' - created_at) / 86400.0::DOUBLE, 0) AS age FROM sp JOIN documents USING (doc_id) WHERE rank <= 10),
    b AS (SELECT *, round(score * CASE WHEN is_code THEN 1.2 ELSE 1 END * least(1 + 0.2 * exp(-age / 30), 1.5), 6) AS boosted FROM j)
    SELECT query_id, doc_id, is_code, boosted FROM b"""
)
def rerank_code_boost(spark: SparkSession, directory: str) -> DataFrame:
    """Lexical hits raised for code and for being recent."""
    docs = table(spark, directory, "documents").select("doc_id", "text", "created_at")
    hits = _sparse(spark, directory).where("rank <= 10").join(docs, "doc_id")
    is_code = X.count_contained(F.col("text"), list(CODE_SIGNS)) >= 3
    age = F.greatest((F.unix_micros(F.lit("2024-07-16 00:00:00").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86_400_000_000, F.lit(0.0))
    boost = F.when(is_code, 1.2).otherwise(1.0) * F.least(1 + 0.2 * F.exp(-age / 30), F.lit(1.5))
    return hits.select("query_id", "doc_id", is_code.alias("is_code"), F.round(F.col("score") * boost, 6).alias("boosted"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{k}'" for k, p, _ in PROMPTS) + " ELSE 'general' END"


@query(
    f"WITH t AS (SELECT id, any_value(query_text) AS q FROM semantic_cache GROUP BY id), k AS (SELECT id, {_KIND} AS kind FROM t WHERE q IS NOT NULL) SELECT id, kind, CASE kind "
    + " ".join(f"WHEN '{k}' THEN '{p if p != 'deep_dive' else 'short_fact'}'" for k, _, p in PROMPTS)
    + " ELSE 'short_fact' END AS prompt FROM k"
)
def prompt_select(spark: SparkSession, directory: str) -> DataFrame:
    """Kind of every question and the prompt for a quick answer, which is never a deep one."""
    rows = table(spark, directory, "semantic_cache").groupBy("id").agg(F.first("query_text").alias("q")).where("q IS NOT NULL")
    kind = None
    for name, pattern, _ in PROMPTS:
        condition = F.lower("q").rlike(pattern)
        kind = F.when(condition, name) if kind is None else kind.when(condition, name)
    rows = rows.withColumn("kind", kind.otherwise("general"))
    registry = F.create_map(*(x for name, _, prompt in PROMPTS if prompt != "deep_dive" for x in (F.lit(name), F.lit(prompt))))
    return rows.select("id", "kind", F.coalesce(registry[F.col("kind")], F.lit("short_fact")).alias("prompt"))


@query(r"SELECT doc_id, round(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 0.0001::DOUBLE, 9) AS cost FROM documents WHERE text IS NOT NULL")
def embedding_cost(spark: SparkSession, directory: str) -> DataFrame:
    """Estimated cost of embedding every document, by its words."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.round(F.size(X.words(F.col("text"))) * F.lit(0.0001), 9).alias("cost"))


_LEAD = r"array_to_string(list_slice(string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), 1, 3), ' ')"
_LONG = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: length(w) > 4))"


@query(
    f"WITH s AS (SELECT doc_id, {_LONG.format('text')} AS o, {_LONG.format(_LEAD)} AS k, len(list_filter(regexp_split_to_array({_LEAD}, '\\s+'), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, round(0.5 + CASE WHEN n BETWEEN 50 AND 200 THEN 0.2 ELSE 0 END + least(0.3, CASE WHEN len(o) = 0 THEN 0 ELSE 0.3 * len(list_intersect(k, o))::DOUBLE / len(o) END), 6) AS quality FROM s"
)
def summary_quality(spark: SparkSession, directory: str) -> DataFrame:
    """Quality of the lead summaries: length, and how many of the text's longer words they keep."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL").withColumn("s", X.lead(F.col("text")))
    long = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 4))
    rows = docs.select("doc_id", long("text").alias("o"), long("s").alias("k"), F.size(X.words(F.col("s"))).alias("n"))
    kept = F.when(F.size("o") == 0, 0.0).otherwise(0.3 * F.size(F.array_intersect("k", "o")) / F.size("o"))
    return rows.select("doc_id", F.round(0.5 + F.when(F.col("n").between(50, 200), 0.2).otherwise(0.0) + F.least(F.lit(0.3), kept), 6).alias("quality"))


@query(METRICS_ONCE + " SELECT query_id, ts, left(query_text, 200) AS query_text FROM m ORDER BY ts DESC, query_id DESC LIMIT 10000")
def interactions_recent(spark: SparkSession, directory: str) -> DataFrame:
    """The latest ten thousand interactions, as the learning loop holds them."""
    from retrix.operators import monitor

    rows = monitor.recent(monitor.once(table(spark, directory, "query_metrics")), 10_000)
    return rows.select("query_id", "ts", F.left("query_text", F.lit(200)).alias("query_text"))


@query(METRICS_ONCE + ", f AS (SELECT model_used, ts, query_id, user_feedback > 2.5 AS good FROM m WHERE user_feedback IS NOT NULL AND model_used IS NOT NULL) SELECT model_used, count(*) AS n, round(avg(good::INT), 6) AS rate FROM f GROUP BY model_used")
def feedback_success(spark: SparkSession, directory: str) -> DataFrame:
    """Share of good feedback by model."""
    from retrix.operators import monitor

    rows = monitor.once(table(spark, directory, "query_metrics")).where("user_feedback IS NOT NULL AND model_used IS NOT NULL")
    return rows.groupBy("model_used").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("user_feedback") > 2.5).cast("int")), 6).alias("rate"))


@query(
    METRICS_ONCE
    + """, f AS (SELECT routing_strategy, ts::DATE AS day, avg(user_feedback / 5) AS s FROM m WHERE user_feedback IS NOT NULL AND routing_strategy IS NOT NULL GROUP BY ALL),
    l AS (SELECT routing_strategy, list(s ORDER BY day) AS fs FROM f GROUP BY routing_strategy)
    SELECT routing_strategy, round(list_reduce(list_prepend(0.5::DOUBLE, fs), lambda w, s: least(1.0::DOUBLE, greatest(0.1::DOUBLE, w + 0.1::DOUBLE * (s - 0.5)))), 9) AS weight FROM l"""
)
def feedback_weights(spark: SparkSession, directory: str) -> DataFrame:
    """Weight of every routing strategy after its feedback by day, kept between 0.1 and 1 at every step."""
    from retrix.operators import monitor

    rows = monitor.once(table(spark, directory, "query_metrics")).where("user_feedback IS NOT NULL AND routing_strategy IS NOT NULL")
    daily = rows.groupBy("routing_strategy", F.to_date("ts").alias("day")).agg(F.avg(F.col("user_feedback") / 5).alias("satisfaction"))
    return folded_weights(daily, "routing_strategy", "day", "satisfaction")


@query(
    "WITH c AS (SELECT id, adaptation_history AS h FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_accessed DESC NULLS LAST) AS n FROM semantic_cache) WHERE n = 1) SELECT CASE WHEN h IS NULL OR h = '[]' THEN 'none' ELSE 'adapted' END AS state, count(*) AS n FROM c GROUP BY state"
)
def adaptation_state(spark: SparkSession, directory: str) -> DataFrame:
    """Entries that have been adapted."""
    state = F.when(F.col("adaptation_history").isNull() | (F.col("adaptation_history") == "[]"), "none").otherwise("adapted")
    return entries(spark, directory).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(METRICS_ONCE + ", w AS (SELECT model_used, query_id, ts, lag(ts) OVER (PARTITION BY model_used ORDER BY ts, query_id) AS before FROM m) SELECT model_used, count(*) AS n, max(epoch_us(ts - before)) AS longest_gap FROM w GROUP BY model_used")
def model_gaps(spark: SparkSession, directory: str) -> DataFrame:
    """The longest time (microseconds) without a query, by model."""
    from retrix.operators import monitor

    before = F.lag("ts").over(Window.partitionBy("model_used").orderBy("ts", "query_id"))
    rows = monitor.once(table(spark, directory, "query_metrics")).withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp")))
    return rows.groupBy("model_used").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("longest_gap"))
