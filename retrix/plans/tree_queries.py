"""Queries over the hierarchical index of the vectors, and over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrix.operators import tree as T
from retrix.plans.registry import query
from retrix.sources.tables import cut, kept, table
from retrix.streaming import windows


@kept
def _tree(spark: SparkSession, directory: str) -> DataFrame:
    points = table(spark, directory, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 90 + 10).alias("tokens"))
    return cut(T.build(points))


@query()
def tree_levels(spark: SparkSession, directory: str) -> DataFrame:
    """Levels of the tree."""
    return T.summary(_tree(spark, directory))


def _vectors(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query()
def tree_mixture(spark: SparkSession, directory: str) -> DataFrame:
    """Clusters of the vectors by a mixture of normal distributions, as many as the Bayes criterion prefers, and those inside each."""
    found = T.local_mixtures(_vectors(spark, directory))
    return found.groupBy("k", "cluster", "local_k", "local_cluster", F.round("silhouette", 6).alias("silhouette")).agg(F.count(F.lit(1)).alias("members"))


@query()
def tree_mixture_silhouette(spark: SparkSession, directory: str) -> DataFrame:
    """Clusters of the vectors by a mixture of normal distributions, as many as have the largest silhouette."""
    return T.mixture(_vectors(spark, directory), by="silhouette").groupBy("k", "cluster", F.round("silhouette", 6).alias("silhouette")).agg(F.count(F.lit(1)).alias("members"))


@query()
def tree_search(spark: SparkSession, directory: str) -> DataFrame:
    """Nodes of all levels for one vector, within a budget of tokens."""
    asked = table(spark, directory, "embeddings").where("vec_id = 0").first()["embedding"]
    return T.collapsed_search(_tree(spark, directory), [float(x) for x in asked])


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_windows(spark: SparkSession, directory: str) -> DataFrame:
    """Hourly counts of the events, computed as a stream over what is there."""
    return windows.hourly_counts(spark, directory)
