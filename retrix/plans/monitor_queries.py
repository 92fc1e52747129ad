"""Queries over query metrics and events: summaries, alerts, routing, budgets and windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrix.operators import monitor as M
from retrix.plans.registry import query
from retrix.sources.tables import table

ONCE = "WITH m AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY received_at NULLS FIRST) AS n FROM query_metrics) WHERE n = 1)"
_VALID = "CASE WHEN NOT isnan({0}) AND {0} >= 0 THEN {0} END"
_LATENCY = _VALID.format("total_latency")
_COST = _VALID.format("estimated_cost")


def _metrics(spark: SparkSession, directory: str) -> DataFrame:
    return M.once(table(spark, directory, "query_metrics"))


@query(
    ONCE
    + f""", r AS (SELECT *, {_LATENCY} AS l FROM m ORDER BY ts DESC, query_id DESC LIMIT 1000)
    SELECT count(*) AS queries, round(avg(l), 6) AS mean_latency, round(quantile_cont(l, 0.5), 9) AS p50, round(quantile_cont(l, 0.95), 9) AS p95, round(quantile_cont(l, 0.99), 9) AS p99,
           round(avg(cache_hit::INT), 6) AS hit_rate FROM r"""
)
def monitor_summary(spark: SparkSession, directory: str) -> DataFrame:
    """Means, percentiles and hit rate of the latest thousand queries."""
    value = M.valid(F.col("total_latency"))
    last = M.recent(_metrics(spark, directory), 1000)
    parts = [F.round(F.percentile(value, q), 9).alias(name) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return last.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(value), 6).alias("mean_latency"), *parts, F.round(F.avg(F.col("cache_hit").cast("int")), 6).alias("hit_rate"))


@query(
    ONCE
    + """, long AS (UNPIVOT (SELECT embedding_latency, retrieval_latency, reranking_latency, generation_latency FROM m) ON COLUMNS(*) INTO NAME component VALUE v)
    SELECT component, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.95), 9) AS p95 FROM long WHERE NOT isnan(v) AND v >= 0 GROUP BY component"""
)
def component_latency(spark: SparkSession, directory: str) -> DataFrame:
    """Mean and 95th percentile of every component's latency."""
    rows = _metrics(spark, directory).select(F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("v")) for c in M.COMPONENTS))).alias("x")).select("x.*")
    rows = rows.where(~F.isnan("v") & (F.col("v") >= 0))
    return rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.percentile("v", 0.95), 9).alias("p95"))


@query(ONCE + f"SELECT routing_strategy, count(*) AS n, round(avg({_LATENCY}), 6) AS mean_latency, round(avg((relevance_score > 0.7)::INT), 6) AS success FROM m GROUP BY routing_strategy HAVING count(*) >= 100")
def strategy_success(spark: SparkSession, directory: str) -> DataFrame:
    """Latency and success of every routing strategy with a hundred samples."""
    grouped = _metrics(spark, directory).groupBy("routing_strategy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(M.valid(F.col("total_latency"))), 6).alias("mean_latency"), F.round(F.avg((F.col("relevance_score") > 0.7).cast("int")), 6).alias("success")
    )
    return grouped.where("n >= 100")


@query(
    ONCE
    + f""", s AS (SELECT model_used AS complexity, routing_strategy, round(avg((relevance_score > 0.7)::INT) / (1 + avg({_LATENCY}) / 10), 9) AS score
         FROM m WHERE model_used IS NOT NULL AND routing_strategy IS NOT NULL GROUP BY ALL)
    SELECT complexity, routing_strategy, score FROM (SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY score DESC NULLS LAST, routing_strategy) AS n FROM s) WHERE n = 1"""
)
def routing_optimization(spark: SparkSession, directory: str) -> DataFrame:
    """The best strategy of every class: success over one plus a tenth of the latency."""
    rows = _metrics(spark, directory).where("model_used IS NOT NULL AND routing_strategy IS NOT NULL")
    score = F.round(F.avg((F.col("relevance_score") > 0.7).cast("int")) / (1 + F.avg(M.valid(F.col("total_latency"))) / 10), 9)
    scored = rows.groupBy(F.col("model_used").alias("complexity"), "routing_strategy").agg(score.alias("score"))
    window = Window.partitionBy("complexity").orderBy(F.desc_nulls_last("score"), "routing_strategy")
    return scored.withColumn("n", F.row_number().over(window)).where("n = 1").drop("n")


@query(ONCE + f"SELECT routing_strategy, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share, round(avg({_LATENCY}), 6) AS mean_latency FROM m GROUP BY routing_strategy")
def routing_stats(spark: SparkSession, directory: str) -> DataFrame:
    """How often every strategy is used."""
    rows = _metrics(spark, directory)
    grouped = rows.groupBy("routing_strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(M.valid(F.col("total_latency"))), 6).alias("mean_latency"))
    total = grouped.agg(F.sum("n").alias("total")).first()["total"] or 1  # one row
    return grouped.select("routing_strategy", "n", F.round(F.col("n") / F.lit(float(total)), 9).alias("share"), "mean_latency")


@query(
    ONCE
    + f""", r AS (SELECT *, {_LATENCY} AS l FROM m ORDER BY ts DESC, query_id DESC LIMIT 100), a AS (SELECT quantile_cont(l, 0.95) AS p95, avg(memory_used_mb) AS mb, count(*) AS n, avg((l IS NULL)::INT) AS errors FROM r)
    SELECT round(p95, 6) AS p95, round(mb, 6) AS memory, p95 > 5.0 AS latency_alert, n > 100 AND errors > 0.05 AS error_alert, mb > 8192 AS memory_alert FROM a"""
)
def alerts(spark: SparkSession, directory: str) -> DataFrame:
    """Alerts over the latest hundred queries: latency, errors, memory."""
    value = M.valid(F.col("total_latency"))
    last = M.recent(_metrics(spark, directory), 100)
    a = last.agg(F.percentile(value, 0.95).alias("p"), F.avg("memory_used_mb").alias("mb"), F.count(F.lit(1)).alias("n"), F.avg(value.isNull().cast("int")).alias("errors"))
    return a.select(F.round("p", 6).alias("p95"), F.round("mb", 6).alias("memory"), (F.col("p") > 5.0).alias("latency_alert"), ((F.col("n") > 100) & (F.col("errors") > 0.05)).alias("error_alert"), (F.col("mb") > 8192).alias("memory_alert"))


@query(
    ONCE
    + f""", w AS (SELECT query_id, avg(cache_hit::INT) OVER (PARTITION BY ts::DATE ORDER BY ts, query_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hits,
        avg({_LATENCY}) OVER (PARTITION BY ts::DATE ORDER BY ts, query_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS latency FROM m)
    SELECT query_id, CASE WHEN hits > 0.7 THEN 'cached' WHEN latency > 2 THEN 'vector_only' ELSE 'classify' END AS strategy FROM w"""
)
def adaptive_strategy(spark: SparkSession, directory: str) -> DataFrame:
    """Strategy by the last twenty queries' hits and the last ten's latency, within a day."""
    rows = _metrics(spark, directory).withColumn("day", F.to_date("ts"))
    hits = M.trailing_mean(rows, F.col("cache_hit").cast("int"), ["day"], ["ts", "query_id"], 20)
    latency = M.trailing_mean(rows, M.valid(F.col("total_latency")), ["day"], ["ts", "query_id"], 10)
    return rows.select("query_id", F.when(hits > 0.7, "cached").when(latency > 2, "vector_only").otherwise("classify").alias("strategy"))


@query(ONCE + f"SELECT query_id, round(avg({_LATENCY}) OVER (PARTITION BY model_used ORDER BY ts, query_id ROWS UNBOUNDED PRECEDING) + 1e-10, 6) AS running FROM m")
def running_mean(spark: SparkSession, directory: str) -> DataFrame:
    """Running mean of the latency by model (the small addend settles ties of rounding)."""
    rows = _metrics(spark, directory).withColumn("day", F.to_date("ts"))
    held = M.running_mean(rows, M.valid(F.col("total_latency")), "model_used", ["ts", "query_id"], "mean")
    return held.select("query_id", F.round(F.col("mean") + 1e-10, 6).alias("running"))


@query(ONCE + f"SELECT model_used, grouping(model_used)::INT AS total, count(*) AS calls, sum(tokens_input + tokens_output)::BIGINT AS tokens, round(sum({_COST}), 9) AS cost FROM m GROUP BY ROLLUP (model_used)")
def provider_usage(spark: SparkSession, directory: str) -> DataFrame:
    """Calls, tokens and cost by model, with a total."""
    rows = _metrics(spark, directory)
    return rows.rollup("model_used").agg(
        F.grouping("model_used").cast("int").alias("total"), F.count(F.lit(1)).alias("calls"), F.sum(F.col("tokens_input") + F.col("tokens_output")).alias("tokens"), F.round(F.sum(M.valid(F.col("estimated_cost"))), 9).alias("cost")
    )


@query(ONCE + "SELECT query_id, ts, model_used, total_latency FROM m ORDER BY ts DESC, query_id DESC LIMIT 100")
def export_last(spark: SparkSession, directory: str) -> DataFrame:
    """The latest hundred queries, as they are exported."""
    return M.recent(_metrics(spark, directory), 100).select("query_id", "ts", "model_used", "total_latency")


@query(
    ONCE
    + f""", c AS (SELECT query_id, ts, sum(coalesce({_COST}, 0)) OVER (PARTITION BY ts::DATE ORDER BY ts, query_id ROWS UNBOUNDED PRECEDING) AS spent FROM m)
    SELECT ts::DATE AS day, count(*) FILTER (spent <= 0.5) AS within, count(*) FILTER (spent > 0.5) AS refused FROM c GROUP BY day"""
)
def daily_budget(spark: SparkSession, directory: str) -> DataFrame:
    """Queries within and beyond a budget of 0.5 a day, in order of time."""
    rows = _metrics(spark, directory).withColumn("day", F.to_date("ts"))
    spent = M.running(rows, {"spent": M.valid(F.col("estimated_cost"))}, ["day"], F.hour("ts"), ["ts", "query_id"])
    return spent.groupBy("day").agg(F.count_if(F.col("spent") <= 0.5).alias("within"), F.count_if(F.col("spent") > 0.5).alias("refused"))


@query(
    ONCE
    + """, w AS (SELECT query_id, time_bucket(INTERVAL 60 seconds, ts) AS minute, row_number() OVER (PARTITION BY time_bucket(INTERVAL 60 seconds, ts) ORDER BY ts, query_id) AS n,
        sum(tokens_input) OVER (PARTITION BY time_bucket(INTERVAL 60 seconds, ts) ORDER BY ts, query_id ROWS UNBOUNDED PRECEDING) AS tokens FROM m)
    SELECT count(*) AS queries, count(*) FILTER (n <= 60 AND tokens <= 1500) AS allowed, count(DISTINCT minute) AS minutes FROM w"""
)
def rate_limit(spark: SparkSession, directory: str) -> DataFrame:
    """Requests that a limit of 60 requests and 1500 tokens a minute lets through."""
    rows = _metrics(spark, directory).withColumn("minute", F.window("ts", "60 seconds")["start"])
    counted = M.running(rows, {"n": F.lit(1), "tokens": F.col("tokens_input")}, ["minute"], F.second("ts"), ["ts", "query_id"])
    return counted.agg(F.count(F.lit(1)).alias("queries"), F.count_if((F.col("n") <= 60) & (F.col("tokens") <= 1500)).alias("allowed"), F.countDistinct("minute").alias("minutes"))


@query(
    """
    WITH w AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, event_type, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 hour, ts) ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT hour, string_agg(event_type, '>' ORDER BY n) AS sequence, count(*) AS k FROM w WHERE n <= 3 GROUP BY hour HAVING count(*) >= 3)
    SELECT sequence, count(*) AS windows, round(least(count(*) / 10.0::DOUBLE, 1), 6) AS confidence FROM s GROUP BY sequence HAVING count(*) >= 3
    """
)
def hourly_sequences(spark: SparkSession, directory: str) -> DataFrame:
    """Sequences of the first three events of an hour that come in three hours or more."""
    rows = table(spark, directory, "events").select(F.window("ts", "1 hour")["start"].alias("hour"), "ts", "event_id", "event_type")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("hour").orderBy("ts", "event_id"))).where("n <= 3")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "event_type"))), lambda x: x["event_type"]), ">")
    by_hour = first.groupBy("hour").agg(joined.alias("sequence"), F.count(F.lit(1)).alias("k")).where("k >= 3")
    return by_hour.groupBy("sequence").agg(F.count(F.lit(1)).alias("windows"), F.round(F.least(F.count(F.lit(1)) / 10, F.lit(1.0)), 6).alias("confidence")).where("windows >= 3")


@query(
    """
    WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 minutes THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS begins, max(ts) AS ends FROM s GROUP BY ALL
    """
)
def sessions(spark: SparkSession, directory: str) -> DataFrame:
    """Sessions of a user: a gap of more than half an hour begins another."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, directory, "events").select("user_id", "event_id", "ts", F.lag("ts").over(window).alias("before"))
    fresh = F.when(F.col("ts") - F.col("before") <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    marked = rows.withColumn("session", F.sum(fresh).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))


@query(ONCE + f"SELECT coalesce(nullif(cache_type, ''), 'none') AS level, count(*) AS n, round(avg({_LATENCY}), 6) AS mean_latency, sum(cache_hit::INT)::BIGINT AS hits FROM m GROUP BY level")
def cache_levels(spark: SparkSession, directory: str) -> DataFrame:
    """Use of the cache's levels."""
    rows = _metrics(spark, directory).withColumn("level", F.coalesce(F.nullif("cache_type", F.lit("")), F.lit("none")))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(M.valid(F.col("total_latency"))), 6).alias("mean_latency"), F.sum(F.col("cache_hit").cast("int")).alias("hits"))


@query(
    """
    SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY CUBE (l_returnflag, l_linestatus)
    """
)
def pricing_cube(spark: SparkSession, directory: str) -> DataFrame:
    """Totals of line items over all combinations of two flags."""
    rows = table(spark, directory, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 4).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
    )
