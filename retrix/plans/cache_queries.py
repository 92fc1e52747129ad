"""Queries over the cache: look-ups, statistics, expiry, eviction, adaptation, warming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrix.operators import search
from retrix.operators.writes import latest, upsert
from retrix.plans.registry import query
from retrix.sources.tables import table

ONCE = "WITH c AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_accessed DESC NULLS LAST) AS n FROM semantic_cache) WHERE n = 1)"
AS_OF = 1720000000.0
DAY = 86400.0


def entries(spark: SparkSession, directory: str) -> DataFrame:
    """Each entry once, as last accessed."""
    return latest(table(spark, directory, "semantic_cache"), ["id"], F.desc_nulls_last("last_accessed"))


@query(ONCE + "SELECT sha256(lower(trim(query_text))) AS key, count(*) AS entries, min(id) AS id, max(access_count) AS accesses FROM c WHERE query_text IS NOT NULL GROUP BY key")
def cache_keys(spark: SparkSession, directory: str) -> DataFrame:
    """Entries by the key of exact look-ups: the hash of the trimmed question in lower case."""
    rows = entries(spark, directory).where("query_text IS NOT NULL")
    return rows.groupBy(F.sha2(F.lower(F.trim("query_text")), 256).alias("key")).agg(F.count(F.lit(1)).alias("entries"), F.min("id").alias("id"), F.max("access_count").alias("accesses"))


@query(ONCE + ", asked AS (SELECT id AS query_id, sha256(lower(trim(query_text))) AS key FROM c WHERE id % 100 = 0) SELECT query_id, min(c.id) AS entry FROM asked JOIN c ON sha256(lower(trim(c.query_text))) = key WHERE created_at + 30 * 86400.0 > 1717500000.0 GROUP BY query_id")
def cache_lookup_exact(spark: SparkSession, directory: str) -> DataFrame:
    """Exact look-up of the stated questions among entries that have not expired."""
    rows = entries(spark, directory).withColumn("key", F.sha2(F.lower(F.trim("query_text")), 256))
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "key")
    return asked.join(rows.where(F.col("created_at") + 30 * DAY > 1717500000.0), "key").groupBy("query_id").agg(F.min("id").alias("entry"))


_GOOD = "len(query_embedding) = 64 AND NOT list_bool_or([isnan(x) FOR x IN query_embedding])"


@query(
    ONCE
    + f""", v AS (SELECT id, query_embedding::DOUBLE[] AS e FROM c WHERE {_GOOD} AND list_bool_or([x <> 0 FOR x IN query_embedding])),
    s AS (SELECT a.id AS query_id, b.id AS entry, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id)
    SELECT query_id, entry, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) AS n FROM s WHERE score >= 0.85) WHERE n = 1"""
)
def cache_semantic_top1(spark: SparkSession, directory: str) -> DataFrame:
    """The most similar other entry of each stated question, if it is similar enough."""
    good = entries(spark, directory).where("size(query_embedding) = 64 AND forall(query_embedding, x -> NOT isnan(x)) AND exists(query_embedding, x -> x <> 0)")
    hits = search.top_cosine(good, "id", "query_embedding", good.where("id % 100 = 0"), "id", "query_embedding", 2)
    best = search.ranked(hits.where("query_id <> doc_id AND score >= 0.85").drop("rank"), ["query_id"], "score", "doc_id", 1)
    return best.select("query_id", F.col("doc_id").alias("entry"), "score")


@query(
    ONCE
    + """ SELECT count(*) AS entries, round(avg(access_count), 6) AS mean_access, round(avg(confidence_score), 6) AS mean_confidence, sum(tokens_saved)::BIGINT AS tokens,
    round(sum(cost_savings), 6) AS savings, round(0.4 * avg((access_count > 1)::INT) + 0.3 * avg(confidence_score) + 0.3 * avg((response_quality_score > 0.5)::INT), 6) AS effectiveness FROM c"""
)
def cache_effectiveness(spark: SparkSession, directory: str) -> DataFrame:
    """Effectiveness: 0.4 of the hit rate, 0.3 of the confidence, 0.3 of the warmed share."""
    rows = entries(spark, directory)
    value = 0.4 * F.avg((F.col("access_count") > 1).cast("int")) + 0.3 * F.avg("confidence_score") + 0.3 * F.avg((F.col("response_quality_score") > 0.5).cast("int"))
    return rows.agg(
        F.count(F.lit(1)).alias("entries"), F.round(F.avg("access_count"), 6).alias("mean_access"), F.round(F.avg("confidence_score"), 6).alias("mean_confidence"),
        F.sum("tokens_saved").alias("tokens"), F.round(F.sum("cost_savings"), 6).alias("savings"), F.round(value, 6).alias("effectiveness"),
    )


@query(ONCE + "SELECT id, access_count FROM c ORDER BY access_count DESC, id LIMIT 10")
def cache_most_used(spark: SparkSession, directory: str) -> DataFrame:
    """The ten entries used most."""
    return entries(spark, directory).orderBy(F.desc("access_count"), "id").limit(10).select("id", "access_count")


@query(ONCE + f"SELECT id FROM c WHERE NOT (created_at < {AS_OF} - 30 * {DAY} AND access_count < 3)")
def cache_cleanup(spark: SparkSession, directory: str) -> DataFrame:
    """Entries that stay when old and little used ones are removed."""
    return entries(spark, directory).where(~((F.col("created_at") < AS_OF - 30 * DAY) & (F.col("access_count") < 3))).select("id")


@query(ONCE + "SELECT id, last_accessed FROM c ORDER BY last_accessed DESC, id LIMIT 1000")
def cache_lru(spark: SparkSession, directory: str) -> DataFrame:
    """The thousand entries that memory holds."""
    return entries(spark, directory).orderBy(F.desc("last_accessed"), "id").limit(1000).select("id", "last_accessed")


@query(
    ONCE
    + """, k AS (SELECT id, sha256(lower(trim(query_text))) AS key FROM c WHERE query_text IS NOT NULL), l1 AS (SELECT key, min(id) AS e FROM k WHERE id % 3 = 0 GROUP BY key), l2 AS (SELECT key, min(id) AS e FROM k WHERE id % 3 = 1 GROUP BY key), l3 AS (SELECT key, min(id) AS e FROM k GROUP BY key)
    SELECT CASE WHEN l1.e IS NOT NULL THEN 'memory' WHEN l2.e IS NOT NULL THEN 'table' ELSE 'remote' END AS level, count(*) AS n
    FROM k LEFT JOIN l1 USING (key) LEFT JOIN l2 USING (key) LEFT JOIN l3 USING (key) GROUP BY level"""
)
def cache_read_through(spark: SparkSession, directory: str) -> DataFrame:
    """Which of three levels answers: the first that has the key."""
    rows = entries(spark, directory).where("query_text IS NOT NULL").select("id", F.sha2(F.lower(F.trim("query_text")), 256).alias("key"))
    level = lambda condition, name: rows.where(condition).groupBy("key").agg(F.min("id").alias(name))
    joined = rows.join(level("id % 3 = 0", "l1"), "key", "left").join(level("id % 3 = 1", "l2"), "key", "left").join(level("true", "l3"), "key", "left")
    return joined.groupBy(F.when(F.col("l1").isNotNull(), "memory").when(F.col("l2").isNotNull(), "table").otherwise("remote").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    ONCE
    + """ SELECT id, CASE WHEN similarity_threshold >= 0.95 OR similarity_threshold < 0.75 THEN 'verbatim' WHEN similarity_threshold >= 0.9 THEN 'template' WHEN similarity_threshold >= 0.8 THEN 'contextual' ELSE 'verbatim' END AS adaptation FROM c"""
)
def cache_adaptation(spark: SparkSession, directory: str) -> DataFrame:
    """How an answer is adapted at a similarity: verbatim near the ends, else by the first rule that holds."""
    s = F.col("similarity_threshold")
    rule = F.when((s >= 0.95) | (s < 0.75), "verbatim").when(s >= 0.9, "template").when(s >= 0.8, "contextual").otherwise("verbatim")
    return entries(spark, directory).select("id", rule.alias("adaptation"))


TEMPLATES = ("Como {}", "O que é {}", "Exemplo de {}", "Por que {}", "Quando usar {}", "Diferença entre {}")
_PREDICTED = (
    ONCE
    + ", p AS (SELECT id, unnest(["
    + ", ".join("'" + t.replace("{}", "") + "' || query_text" for t in TEMPLATES)
    + "]) AS predicted, round(0.7 * response_quality_score, 9) AS confidence FROM c WHERE query_text IS NOT NULL)"
)


def _predicted(spark: SparkSession, directory: str) -> DataFrame:
    rows = entries(spark, directory).where("query_text IS NOT NULL")
    variants = F.array(*(F.concat(F.lit(t.replace("{}", "")), F.col("query_text")) for t in TEMPLATES))
    return rows.select("id", F.explode(variants).alias("predicted"), F.round(0.7 * F.col("response_quality_score"), 9).alias("confidence"))


@query(_PREDICTED + "SELECT id, count(*) AS predictions, max(confidence) AS confidence FROM p WHERE confidence > 0.5 GROUP BY id")
def cache_predictions(spark: SparkSession, directory: str) -> DataFrame:
    """Predicted questions that are worth warming."""
    return _predicted(spark, directory).where("confidence > 0.5").groupBy("id").agg(F.count(F.lit(1)).alias("predictions"), F.max("confidence").alias("confidence"))


@query(_PREDICTED + "SELECT id, predicted, confidence FROM p WHERE confidence >= 0.6 ORDER BY confidence DESC, id, predicted LIMIT 10")
def cache_warming(spark: SparkSession, directory: str) -> DataFrame:
    """The ten predictions that are warmed next."""
    return _predicted(spark, directory).where("confidence >= 0.6").orderBy(F.desc("confidence"), "id", "predicted").limit(10)


@query(ONCE + "SELECT id, access_count + CASE WHEN id % 100 = 0 THEN 1 ELSE 0 END AS access_count, CASE WHEN id % 100 = 0 THEN 1720000000.0::DOUBLE ELSE last_accessed END AS last_accessed FROM c")
def cache_touch(spark: SparkSession, directory: str) -> DataFrame:
    """Entries after the stated ones were read."""
    rows = entries(spark, directory).select("id", "access_count", "last_accessed")
    read = rows.where("id % 100 = 0").select("id", (F.col("access_count") + 1).alias("access_count"), F.lit(AS_OF).alias("last_accessed"))
    return upsert(rows, read, ["id"])


@query(ONCE + "SELECT coalesce(nullif(source_model, ''), 'unknown') AS model, count(*) AS entries, round(avg(confidence_score), 6) AS confidence, round(sum(processing_time_saved), 4) AS seconds FROM c GROUP BY model")
def cache_by_model(spark: SparkSession, directory: str) -> DataFrame:
    """Entries and time saved by model."""
    rows = entries(spark, directory).withColumn("model", F.coalesce(F.nullif("source_model", F.lit("")), F.lit("unknown")))
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("entries"), F.round(F.avg("confidence_score"), 6).alias("confidence"), F.round(F.sum("processing_time_saved"), 4).alias("seconds"))
