"""Queries over vectors: search, filters, writes, fusion, votes, reranking.

Queries are every row whose id is divisible by 100; the five heads of the votes are the first five of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrix.functions import vectors as V
from retrix.operators import fusion, search
from retrix.plans.registry import query
from retrix.sources.tables import table

STATED = 100
HEAD_WEIGHTS = (1.2, 1.0, 1.1, 0.9, 0.8)
HEAD_TOP = (8, 6, 5, 7, 4)
HEAD_TEMPERATURE = (0.1, 0.3, 0.2, 0.4, 0.25)

_SCORES = """
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    scored AS (
        SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label AS label, round(list_cosine_similarity(q.e, d.e), 9) AS score
        FROM v q, v d WHERE q.vec_id % 100 = 0
    )
"""


def _top(n: int, source: str = "scored", name: str = "top") -> str:
    return f"""{name} AS (
        SELECT query_id, doc_id, score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {source}
        ) WHERE rank <= {n}
    )"""


def _hits(spark: SparkSession, directory: str, k: int, where: str = "true", asking: str = "true") -> DataFrame:
    rows = table(spark, directory, "embeddings")
    return search.top_cosine(rows.where(where), "vec_id", "embedding", rows.where(f"vec_id % {STATED} = 0 AND {asking}"), "vec_id", "embedding", k)


@query(_SCORES + "," + _top(20) + "SELECT * FROM top")
def dense_topk_cosine(spark: SparkSession, directory: str) -> DataFrame:
    """The 20 most similar vectors of every stated query."""
    return _hits(spark, directory, 20)


@query(_SCORES + ", filtered AS (SELECT * FROM scored WHERE label = 3)," + _top(10, "filtered") + "SELECT * FROM top")
def dense_topk_filtered(spark: SparkSession, directory: str) -> DataFrame:
    """Search with an equality on the payload that reaches the scan."""
    return _hits(spark, directory, 10, "label = 3")


@query(
    _SCORES
    + ","
    + _top(20)
    + """
    SELECT query_id, doc_id, score, place FROM (
        SELECT t.*, row_number() OVER (PARTITION BY t.query_id ORDER BY t.rank) AS place
        FROM top t JOIN embeddings e ON e.vec_id = t.doc_id WHERE e.label IN (1, 2, 3)
    ) WHERE place <= 10
    """
)
def retrieve_with_filters_post(spark: SparkSession, directory: str) -> DataFrame:
    """Fetch twice as many, then filter: the filter sees only what was fetched."""
    payload = table(spark, directory, "embeddings").select("vec_id", "label")
    return search.post_filtered(_hits(spark, directory, 20), payload, "vec_id", F.col("label").isin(1, 2, 3), 10)


@query("SELECT count(*) AS points, count(DISTINCT label) AS labels, min(len(embedding)) AS dimension FROM embeddings")
def collection_info(spark: SparkSession, directory: str) -> DataFrame:
    """Size and shape of the collection."""
    rows = table(spark, directory, "embeddings")
    return rows.agg(F.count(F.lit(1)).alias("points"), F.countDistinct("label").alias("labels"), F.min(F.size("embedding")).alias("dimension"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 42")
def point_lookup(spark: SparkSession, directory: str) -> DataFrame:
    """One point by id."""
    return table(spark, directory, "embeddings").where("vec_id = 42").select("vec_id", "label")


@query(
    """
    SELECT vec_id, label, 'old' AS origin FROM embeddings WHERE vec_id % 7 <> 0
    UNION ALL SELECT vec_id, label + 100, 'new' FROM embeddings WHERE vec_id % 7 = 0
    UNION ALL SELECT vec_id + 1000000, label, 'new' FROM embeddings WHERE vec_id % 50 = 0
    """
)
def points_upsert(spark: SparkSession, directory: str) -> DataFrame:
    """Points after an upsert of changed and new ones."""
    from retrix.operators.writes import upsert

    rows = table(spark, directory, "embeddings").select("vec_id", "label")
    changed = rows.where("vec_id % 7 = 0").withColumn("label", F.col("label") + 100)
    added = rows.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return upsert(rows.withColumn("origin", F.lit("old")), changed.union(added).withColumn("origin", F.lit("new")), ["vec_id"])


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0")
def points_delete(spark: SparkSession, directory: str) -> DataFrame:
    """Points after deletion by a list of ids."""
    from retrix.operators.writes import delete

    rows = table(spark, directory, "embeddings").select("vec_id", "label")
    return delete(rows, rows.where("vec_id % 3 = 0").select("vec_id"), ["vec_id"])


@query(
    """
    SELECT label, pos, round(avg(x), 6) AS mean, round(max(x), 6) AS highest
    FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
    GROUP BY label, pos
    """
)
def centroid_by_label(spark: SparkSession, directory: str) -> DataFrame:
    """Mean and greatest value of every dimension by label."""
    rows = table(spark, directory, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.max(F.col("x").cast("double")), 6).alias("highest"))


@query(
    _SCORES
    + ","
    + _top(5)
    + """
    SELECT query_id, round(least(1, greatest(0, avg(list_cosine_similarity(a.e, b.e)))), 6) AS confidence FROM (
        SELECT x.query_id, x.doc_id AS i, y.doc_id AS j FROM top x JOIN top y ON x.query_id = y.query_id AND x.doc_id < y.doc_id
    ) p JOIN v a ON a.vec_id = p.i JOIN v b ON b.vec_id = p.j GROUP BY query_id
    """
)
def hit_agreement(spark: SparkSession, directory: str) -> DataFrame:
    """Mean cosine of all pairs among a query's five hits, between 0 and 1."""
    hits = _hits(spark, directory, 5)
    rows = table(spark, directory, "embeddings")
    held = hits.join(rows, hits["doc_id"] == rows["vec_id"]).select("query_id", "doc_id", "embedding")
    left, right = held, held.select(F.col("query_id"), F.col("doc_id").alias("other"), F.col("embedding").alias("b"))
    pairs = left.join(right, "query_id").where("doc_id < other")
    score = F.avg(V.cosine(F.col("embedding"), F.col("b")))
    return pairs.groupBy("query_id").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("confidence"))


@query(_SCORES + "," + _top(20) + "SELECT query_id, count(*) AS kept, round(max(score), 9) AS best FROM top WHERE score >= 0.3 GROUP BY query_id")
def quality_filter(spark: SparkSession, directory: str) -> DataFrame:
    """Hits that are similar enough to their query."""
    return _hits(spark, directory, 20).where("score >= 0.3").groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.max("score"), 9).alias("best"))


@query(
    _SCORES
    + ","
    + _top(10)
    + """
    , w AS (SELECT doc_id // 10 AS key, doc_id, query_id, score * CASE WHEN query_id = 0 THEN 1.0 ELSE 0.8 END AS weighted FROM top)
    SELECT key, round(sum(weighted), 9) AS score, count(*) AS n_hits, count(DISTINCT query_id) AS n_queries,
           arg_max(doc_id, weighted * 1e6 - doc_id / 1e9) AS doc_id
    FROM w GROUP BY key
    """
)
def multi_query_weighted(spark: SparkSession, directory: str) -> DataFrame:
    """Hits of the original query and its variations, fused by weighted sums within groups of documents."""
    return fusion.weighted_fusion(_hits(spark, directory, 10), F.floor(F.col("doc_id") / 10).cast("long"), F.col("query_id") == 0)


@query(
    _SCORES
    + ","
    + _top(10)
    + """
    , placed AS (SELECT doc_id // 10 AS key, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY query_id, score DESC, doc_id) - 1 AS i FROM top)
    SELECT key, round(sum(1.0::DOUBLE / (60 + i + 1)), 12) AS score FROM placed GROUP BY key
    """
)
def multi_query_rrf(spark: SparkSession, directory: str) -> DataFrame:
    """The same hits fused by reciprocal places within their groups."""
    return fusion.grouped_rrf(_hits(spark, directory, 10), F.floor(F.col("doc_id") / 10).cast("long"))


def _heads(spark: SparkSession, directory: str) -> DataFrame:
    """Hits of the five heads, each with its own depth."""
    depth = F.create_map(*(x for h, n in enumerate(HEAD_TOP) for x in (F.lit(h), F.lit(n))))
    hits = _hits(spark, directory, max(HEAD_TOP), asking=f"vec_id < {5 * STATED}").withColumn("head", (F.col("query_id") / STATED).cast("int"))
    return hits.where(F.col("rank") <= depth[F.col("head")]).select("head", "doc_id", "score", "rank")


_HEADS = _SCORES + "," + _top(8) + ", heads AS (SELECT (query_id // 100)::INT AS head, doc_id, score, rank FROM top WHERE query_id < 500 AND rank <= [8, 6, 5, 7, 4][query_id // 100 + 1])"


@query(_HEADS + "SELECT doc_id, round(sum(score * [1.2, 1.0, 1.1, 0.9, 0.8][head + 1]::DOUBLE), 9) AS total, round(sum(score * [1.2, 1.0, 1.1, 0.9, 0.8][head + 1]::DOUBLE) / 5, 9) AS score, list_sort(list(DISTINCT head)) AS heads FROM heads GROUP BY doc_id")
def vote_weighted(spark: SparkSession, directory: str) -> DataFrame:
    """Weighted majority of five heads."""
    weight = F.create_map(*(x for h, w in enumerate(HEAD_WEIGHTS) for x in (F.lit(h), F.lit(w))))
    return fusion.weighted_vote(_heads(spark, directory), weight[F.col("head")], 5)


@query(_HEADS + "SELECT doc_id, sum(n - rank)::BIGINT AS points FROM heads JOIN (SELECT head, count(*) AS n FROM heads GROUP BY head) USING (head) GROUP BY doc_id")
def vote_borda(spark: SparkSession, directory: str) -> DataFrame:
    """Borda count over five heads."""
    return fusion.borda(_heads(spark, directory)).withColumn("points", F.col("points").cast("long"))


@query(_HEADS + "SELECT doc_id, score, head FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY head, rank) AS n FROM heads) WHERE n = 1")
def vote_union(spark: SparkSession, directory: str) -> DataFrame:
    """Union of five heads; the first head that has a document wins."""
    return fusion.first_head_union(_heads(spark, directory))


@query(
    _HEADS
    + """, sets AS (SELECT head, list(DISTINCT doc_id) AS docs FROM heads GROUP BY head)
    SELECT round(avg(1 - len(list_intersect(a.docs, b.docs))::DOUBLE / len(list_distinct(list_concat(a.docs, b.docs)))), 9) AS diversity, count(*) AS pairs
    FROM sets a JOIN sets b ON a.head < b.head"""
)
def head_diversity(spark: SparkSession, directory: str) -> DataFrame:
    """How different the heads' results are."""
    return fusion.diversity(_heads(spark, directory))


@query(_HEADS + "SELECT head, count(*) AS docs, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM heads GROUP BY head")
def head_coverage(spark: SparkSession, directory: str) -> DataFrame:
    """Share of the results that each head gives."""
    counted = _heads(spark, directory).groupBy("head").agg(F.count(F.lit(1)).alias("docs"))
    return counted.withColumn("share", F.round(F.col("docs") / F.sum("docs").over(Window.partitionBy(F.lit(1))), 9))


@query(_HEADS + "SELECT head, doc_id, round(pow(greatest(score, 0), 1 / [0.1, 0.3, 0.2, 0.4, 0.25][head + 1]::DOUBLE), 9) AS adjusted FROM heads")
def head_temperature(spark: SparkSession, directory: str) -> DataFrame:
    """Scores sharpened by each head's temperature."""
    warmth = F.create_map(*(x for h, t in enumerate(HEAD_TEMPERATURE) for x in (F.lit(h), F.lit(t))))
    return _heads(spark, directory).select("head", "doc_id", F.round(F.pow(F.greatest("score", F.lit(0.0)), 1 / warmth[F.col("head")]), 9).alias("adjusted"))


@query()
def vote_coverage(spark: SparkSession, directory: str) -> DataFrame:
    """Greedy choice that covers the heads first."""
    return fusion.coverage_choice(_heads(spark, directory), 10)


@query(
    """
    WITH m AS (
        SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id % 100 = 0
    ), offsets(o) AS (VALUES (0), (10), (-10), (20), (-20))
    SELECT vec_id, i + o AS pos, round(sum(x / (abs(o) + 1)), 6) AS value FROM m, offsets WHERE i + o BETWEEN 0 AND 63 GROUP BY vec_id, i + o
    """
)
def temporal_projection(spark: SparkSession, directory: str) -> DataFrame:
    """Query vectors through the banded matrix of the temporal head: offsets 0, 10 and 20 weigh 1/(offset + 1)."""
    rows = table(spark, directory, "embeddings").where(f"vec_id % {STATED} = 0").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    spread = rows.select("vec_id", "i", "x", F.explode(F.array(*map(F.lit, (0, 10, -10, 20, -20)))).alias("o")).where("i + o BETWEEN 0 AND 63")
    return spread.groupBy("vec_id", (F.col("i") + F.col("o")).alias("pos")).agg(F.round(F.sum(F.col("x").cast("double") / (F.abs("o") + 1)), 6).alias("value"))


@query(
    """
    WITH m AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id % 100 = 0), n AS (SELECT vec_id, max(i) + 1 AS d FROM m GROUP BY vec_id),
    w AS (
        SELECT 'factual' AS head, vec_id, i AS pos, x * CASE WHEN i % 10 = 0 THEN 1.2::DOUBLE ELSE 1 END AS y FROM m
        UNION ALL SELECT 'conceptual', m.vec_id, j.j, x * 0.1::DOUBLE FROM m JOIN n USING (vec_id), range(64) j(j) WHERE j.j >= i - 5 AND j.j < i + 5
        UNION ALL SELECT 'procedural', m.vec_id, i, x FROM m JOIN n USING (vec_id) WHERE i < d - 1
        UNION ALL SELECT 'procedural', m.vec_id, i + 1, x * 0.8::DOUBLE FROM m JOIN n USING (vec_id) WHERE i < d - 1
        UNION ALL SELECT 'contextual', m.vec_id, j.j, x * 0.1::DOUBLE FROM m, range(64) j(j)
    ) SELECT head, vec_id, pos, round(sum(y), 6) + 0 AS value FROM w GROUP BY ALL
    """
)
def head_projections(spark: SparkSession, directory: str) -> DataFrame:
    """Query vectors through the matrices of the factual, conceptual, procedural and contextual heads."""
    rows = table(spark, directory, "embeddings").where(f"vec_id % {STATED} = 0").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    heads = F.explode(F.array(*(F.struct(F.lit(name).alias("head"), projected.alias("p")) for name, projected in V.head_projections(F.col("e")).items()))).alias("h")
    flat = rows.select("vec_id", heads).select("h.head", "vec_id", F.posexplode("h.p").alias("pos", "value"))
    return flat.select("head", "vec_id", "pos", (F.round("value", 6) + 0).alias("value"))


@query(
    _SCORES
    + ","
    + _top(10)
    + """
    SELECT query_id, doc_id, round(0.3 * CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / (hi - lo) END + 0.7 * (1.0::DOUBLE / rank), 9) AS blended
    FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM top)
    """
)
def rerank_minmax_blend(spark: SparkSession, directory: str) -> DataFrame:
    """Min-max scores blended with a second score (here the reciprocal rank), 0.3 to 0.7."""
    window = Window.partitionBy("query_id")
    hits = _hits(spark, directory, 10)
    first = V.min_max(F.col("score"), F.min("score").over(window), F.max("score").over(window))
    return hits.select("query_id", "doc_id", F.round(0.3 * first + 0.7 / F.col("rank"), 9).alias("blended"))


@query(
    _SCORES
    + ","
    + _top(10)
    + """
    , again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS other FROM top)
    SELECT query_id, round(sum((1.0::DOUBLE / rank) / log2(rank + 1)), 9) AS dcg_before, round(sum((1.0::DOUBLE / rank) / log2(other + 1)), 9) AS dcg_after
    FROM again GROUP BY query_id
    """
)
def dcg_gain(spark: SparkSession, directory: str) -> DataFrame:
    """Discounted gain of the original order and of another one (by id), with relevance 1/place."""
    other = Window.partitionBy("query_id").orderBy("doc_id")
    hits = _hits(spark, directory, 10).withColumn("other", F.row_number().over(other))
    gain = lambda place: F.round(F.sum((1.0 / F.col("rank")) / F.log2(F.col(place) + 1)), 9)
    return hits.groupBy("query_id").agg(gain("rank").alias("dcg_before"), gain("other").alias("dcg_after"))


@query(
    """
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    best AS (
        SELECT q.vec_id, d.label, max(list_dot_product(q.e, d.e)) AS m
        FROM v q, v d WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, d.label
    )
    SELECT label, round(avg(m), 6) AS maxsim, count(*) AS query_tokens FROM best GROUP BY label
    """
)
def maxsim(spark: SparkSession, directory: str) -> DataFrame:
    """Late interaction: the stated queries as tokens of one question, each label's vectors as tokens of a document."""
    rows = table(spark, directory, "embeddings")
    best = search.best_product(rows, "label", "embedding", rows.where(f"vec_id % {STATED} = 0"), "vec_id", "embedding")
    return best.groupBy(F.col("grp").cast("int").alias("label")).agg(F.round(F.avg("best"), 6).alias("maxsim"), F.count(F.lit(1)).alias("query_tokens"))
