"""Queries over a memory of documents: tiers, ranking, eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrix.functions.text import token_estimate
from retrix.operators import memory as M
from retrix.operators import search
from retrix.plans.registry import query
from retrix.sources.tables import table

AS_OF = "2024-07-16 00:00:00"
SEGMENTS = rf"""
    WITH seg AS (
        SELECT doc_id, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3)::INT AS tokens, (doc_id % 10) / 10.0::DOUBLE AS importance, doc_id % 7 AS accesses,
               epoch_us(TIMESTAMP '{AS_OF}' - created_at) / 3600000000.0::DOUBLE AS age FROM documents WHERE text IS NOT NULL
    ), t AS (SELECT *, CASE WHEN age <= 240 THEN 'hot' WHEN age <= 480 THEN 'warm' ELSE 'cold' END AS tier FROM seg)
"""


def segments(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").where("text IS NOT NULL")
    age = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3_600_000_000
    rows = docs.select("doc_id", token_estimate(F.col("text")).alias("tokens"), ((F.col("doc_id") % 10) / 10).alias("importance"), (F.col("doc_id") % 7).alias("accesses"), age.alias("age"))
    return rows.withColumn("tier", M.tier(F.col("age"), 240.0))


@query(SEGMENTS + "SELECT tier, count(*) AS segments, sum(tokens)::BIGINT AS tokens FROM t GROUP BY tier")
def memory_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Segments and tokens by tier."""
    return segments(spark, directory).groupBy("tier").agg(F.count(F.lit(1)).alias("segments"), F.sum("tokens").alias("tokens"))


@query(SEGMENTS + "SELECT doc_id, tier FROM t")
def memory_tiers(spark: SparkSession, directory: str) -> DataFrame:
    """Tier of every segment."""
    return segments(spark, directory).select("doc_id", "tier")


_WORTH = "round(importance * CASE tier WHEN 'hot' THEN 3 WHEN 'warm' THEN 2 ELSE 1 END * (1 + accesses / greatest(age, 1)) / (1 + age), 9)"


@query(
    SEGMENTS
    + f""", w AS (SELECT *, {_WORTH} AS worth FROM t WHERE tokens > 0), f AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY worth, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM w)
    SELECT doc_id, tokens, freed::BIGINT AS freed_before FROM f WHERE freed < 5000"""
)
def memory_evict(spark: SparkSession, directory: str) -> DataFrame:
    """Segments that go when 5000 tokens are needed."""
    rows = segments(spark, directory).withColumn("worth", F.round(M.keep_score(F.col("importance"), F.col("tier"), F.col("accesses"), F.col("age")), 9))
    return M.evict(rows, "worth", "tokens", 5000, "doc_id").select("doc_id", "tokens", "freed_before")


@query(
    SEGMENTS
    + """, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0),
    s AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(v.e, q.e), 9) AS sim FROM v, q), top AS (SELECT * FROM s ORDER BY sim DESC, doc_id LIMIT 40)
    SELECT doc_id, round(0.6 * sim + 0.2 * importance + 0.1 / (1 + age / 24) + 0.1 * least(accesses / 10.0::DOUBLE, 1), 9) AS score FROM top JOIN t USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20"""
)
def memory_rank(spark: SparkSession, directory: str) -> DataFrame:
    """Segments by similarity, importance, age and use: 20 of the 40 most similar."""
    rows = table(spark, directory, "embeddings")
    hits = search.top_cosine(rows, "vec_id", "embedding", rows.where("vec_id = 0"), "vec_id", "embedding", 40)
    joined = hits.join(segments(spark, directory), "doc_id")
    score = F.round(M.rank_score(F.col("score"), F.col("importance"), F.col("age"), F.col("accesses")), 9)
    return joined.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
