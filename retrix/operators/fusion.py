"""Fusion of ranked lists: reciprocal ranks, weighted sums, votes of several heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, limit: int = 20, k: int = RRF_K) -> DataFrame:
    """Fuses two ranked lists per query (``query_id``, ``doc_id``, ``rank``): 1/(k+rank) of both, a missing rank
    being one more than the list is long. Gives ``query_id``, ``doc_id``, ``score``, ``place``."""
    size = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    left = dense.select("query_id", "doc_id", F.col("rank").alias("rd"))
    right = sparse.select("query_id", "doc_id", F.col("rank").alias("rs"))
    both = left.join(right, ["query_id", "doc_id"], "full_outer").join(size(left, "nd"), "query_id", "left").join(size(right, "ns"), "query_id", "left")
    missing = lambda rank, n: F.coalesce(F.col(rank), F.coalesce(F.col(n), F.lit(0)) + 1)
    scored = both.withColumn("score", F.round(1.0 / (k + missing("rd", "nd")) + 1.0 / (k + missing("rs", "ns")), 12))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("place", F.row_number().over(window)).where(F.col("place") <= limit).select("query_id", "doc_id", "score", "place")


def weighted_fusion(hits: DataFrame, key: Column, original: Column) -> DataFrame:
    """Sums the scores of hits with the same key: weight 1 for the original query, 0.8 for variations, 0.5 for a
    missing score. Gives ``key``, ``score``, ``n_hits``, ``n_queries`` and the best hit's ``doc_id``."""
    weighted = hits.withColumn("key", key).withColumn("weighted", F.coalesce("score", F.lit(0.5)) * F.when(original, 1.0).otherwise(0.8))
    return weighted.groupBy("key").agg(
        F.round(F.sum("weighted"), 9).alias("score"),
        F.count(F.lit(1)).alias("n_hits"),
        F.countDistinct("query_id").alias("n_queries"),
        F.max_by("doc_id", F.struct("weighted", -F.col("doc_id"))).alias("doc_id"),
    )


def grouped_rrf(hits: DataFrame, key: Column, k: int = RRF_K) -> DataFrame:
    """Sums 1/(k+i+1) over the places i of hits within their group."""
    window = Window.partitionBy("key").orderBy("query_id", F.desc("score"), "doc_id")
    placed = hits.withColumn("key", key).withColumn("i", F.row_number().over(window) - 1)
    return placed.groupBy("key").agg(F.round(F.sum(1.0 / (k + F.col("i") + 1)), 12).alias("score"))


def weighted_vote(hits: DataFrame, weight: Column, heads: int) -> DataFrame:
    """Score times head weight, summed by document; the reported score is the sum over the number of heads."""
    summed = hits.groupBy("doc_id").agg(F.sum(F.col("score") * weight).alias("total"), F.sort_array(F.collect_set("head")).alias("heads"))
    return summed.select("doc_id", F.round("total", 9).alias("total"), F.round(F.col("total") / heads, 9).alias("score"), "heads")


def borda(hits: DataFrame) -> DataFrame:
    """Points by place in each head's list (n - rank, from n - 1 down to 0), summed by document."""
    sizes = hits.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(sizes, "head").groupBy("doc_id").agg(F.sum(F.col("n") - F.col("rank")).alias("points"))


def first_head_union(hits: DataFrame) -> DataFrame:
    """Each document once, with the score of the first head that has it."""
    window = Window.partitionBy("doc_id").orderBy("head", "rank")
    return hits.withColumn("n", F.row_number().over(window)).where("n = 1").select("doc_id", "score", "head")


def diversity(hits: DataFrame) -> DataFrame:
    """Mean of 1 - Jaccard over all pairs of heads' sets of documents (two empty sets count 0)."""
    sets = hits.groupBy("head").agg(F.collect_set("doc_id").alias("docs"))
    a, b = sets.select(F.col("head").alias("a"), F.col("docs").alias("x")), sets.select(F.col("head").alias("b"), F.col("docs").alias("y"))
    pairs = a.join(b, F.col("a") < F.col("b"))  # heads, of which there are a handful
    apart = 1 - F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return pairs.agg(F.round(F.avg(apart), 9).alias("diversity"), F.count(F.lit(1)).alias("pairs"))


def coverage_choice(hits: DataFrame, k: int) -> DataFrame:
    """Greedy choice in order of score: a hit is taken if its head has none yet or fewer than k // 2 are chosen;
    what is missing to k is filled in order of score. The choice depends on what was chosen, so it is a fold."""
    row = F.struct((-F.col("score")).alias("s"), F.col("head"), F.col("doc_id"))
    ordered = hits.groupBy().agg(F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.struct(F.array().cast("array<int>").alias("heads"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("i"))

    def step(state: Column, x: Column) -> Column:
        take = ~F.array_contains(state["heads"], x["head"].cast("int")) | (F.size(state["taken"]) < k // 2)
        take = take & (F.size(state["taken"]) < k)
        return F.struct(
            F.when(take, F.array_union(state["heads"], F.array(x["head"].cast("int")))).otherwise(state["heads"]).alias("heads"),
            F.when(take, F.concat(state["taken"], F.array(state["i"]))).otherwise(state["taken"]).alias("taken"),
            (state["i"] + 1).alias("i"),
        )

    chosen = ordered.withColumn("taken", F.aggregate("rows", start, step)["taken"])
    exploded = chosen.select("taken", F.posexplode("rows").alias("i", "r")).withColumn("first", F.array_contains("taken", F.col("i")))
    window = Window.partitionBy(F.lit(1)).orderBy(F.desc("first"), "i")  # the hits of one query
    return exploded.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k).select("place", F.col("r.doc_id").alias("doc_id"), F.col("r.head").alias("head"), (-F.col("r.s")).alias("score"))
