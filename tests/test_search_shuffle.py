"""Lexical and entity search shuffle hits, not pairs of questions and texts, and give the rows that a plain join gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrix.operators import search, sparse
from retrix.plans.engine import Engine


def written(spark) -> int:
    """Bytes that the session has written for shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, f"comum palavra{k % 5} resto{k % 300} \"Dado Grande{k % 7}\"") for k in range(3000)]
    rows += [(None, "comum comum"), (None, "palavra3 comum"), (7, "comum palavra3 de novo"), (9000, None), (9001, ""), (-5, "comum")]
    return spark.createDataFrame(rows, "doc_id long, content string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(k, f"Onde comum palavra{k % 5} resto{k} \"Dado Grande{k % 7}\" comum") for k in range(200)]
    return spark.createDataFrame(rows + [(900, "nada"), (901, None), (902, "comum")], "query_id long, q string")


def test_terms_in_common_are_not_shuffled(spark, texts, asked):
    lexicon = sparse.fit(texts, "doc_id", "content")
    before = written(spark)
    found = sparse.search(lexicon, asked, "query_id", "q", 5).collect()
    assert len(found) == 201 * 5 and written(spark) - before < 400_000  # 600,000 pairs have a term in common


def test_sums_are_those_of_a_join(spark, texts, asked, monkeypatch):
    lexicon, engine = sparse.fit(texts, "doc_id", "content"), Engine(texts)
    runs = {"terms": lambda: sparse.search(lexicon, asked, "query_id", "q", 40), "entities": lambda: engine.by_entities(asked, 40)}
    for at_once in (search.AT_ONCE, 5000):  # small steps: a state is put together again and again
        monkeypatch.setattr(search, "AT_ONCE", at_once)
        for run in runs.values():
            monkeypatch.setattr(search, "SENT", 32 << 20)
            one = sorted(run().collect(), key=str)
            monkeypatch.setattr(search, "SENT", 0)
            assert one and sorted(run().collect(), key=str) == one
    assert {r["doc_id"] for r in sparse.search(lexicon, asked.where("query_id = 902"), "query_id", "q", 3).collect()} >= {None, -5}


def test_every_strategy_leaves_written_hits(texts, asked):
    found = Engine(texts).execute(asked.where(F.col("query_id") < 3))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_variations_of_questions_are_not_shuffled_with_texts(spark, texts, asked):
    engine = Engine(texts)
    engine.lexicon(), engine.vectors()
    before = written(spark)
    hits = engine.multi_query(asked.where("query_id < 60")).collect()
    assert len(hits) == 60 * 5 and written(spark) - before < 2_500_000  # 720,000 pairs have a term in common


def test_strategies_are_put_together_from_written_hits(texts, asked):
    plan = Engine(texts).combined(asked.where(F.col("query_id") < 3))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "InArrow" not in plan


def test_words_of_texts_are_not_shuffled(spark):
    texts = spark.range(3000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> hex(hash(id, x)))) AS content").repartition(4).cache()
    texts.count()
    before = written(spark)
    held = sparse.postings(texts, "doc_id", "content")
    assert held.count() == 3000 and written(spark) - before < 400_000  # words alone take more than 1 MB


@pytest.mark.parametrize("repeated", [0, 1000])
def test_postings_are_those_of_a_plain_count(spark, texts, repeated, monkeypatch):
    monkeypatch.setattr(sparse, "REPEATED", repeated)
    words = texts.select("doc_id", sparse.X.tokens(F.col("content")).alias("ts")).select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    plain = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
    held = sparse.postings(texts.coalesce(1), "doc_id", "content")  # more rows than are counted at once
    assert held.select("doc_id").distinct().count() == held.count()
    assert sorted(held.select("doc_id", F.inline("held")).collect(), key=str) == sorted(plain.collect(), key=str)


def test_best_rows_are_those_of_a_whole_matrix(monkeypatch):
    monkeypatch.setattr(search, "AT_ONCE", 400)  # a state is put together again and again
    random = np.random.default_rng(1)
    rows, queries = random.integers(-1, 2, (500, 3)).astype(float), random.integers(-1, 2, (40, 3)).astype(float)  # many ties
    state, ids, keys = search._Best(7), np.arange(40)[::-1] * 3, random.permutation(500)
    for low, high in ((0, 4), (4, 200), (200, 203), (203, 500)):
        for at in range(0, 40, 13):
            state.add(ids[at : at + 13], queries[at : at + 13], keys[low:high], rows[low:high])
    size = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1))
    scores = np.round(np.divide(queries @ rows.T, size, out=np.zeros_like(size), where=size > 0), search.ROUND)
    best = sorted((ids[q], key, scores[q, n]) for q in range(40) for n, key in sorted(enumerate(keys), key=lambda x: (-scores[q, x[0]], x[1]))[:7])
    assert sorted(zip(*state.rows())) == best and len(state.waiting) == 0


def test_hits_do_not_grow_with_the_parts_of_the_texts(spark, texts, asked):
    lexicon = sparse.fit(texts, "doc_id", "content")
    vector = F.array(*(F.hash(F.lit(n), "id").cast("double") for n in range(4)))
    rows, wanted = spark.range(4000).select("id", vector.alias("v")), spark.range(300).select("id", vector.alias("v"))
    runs = {
        "terms": lambda n: sparse.search(sparse.Lexicon(lexicon.texts.repartition(n), lexicon.terms, lexicon.n, lexicon.avgdl), asked, "query_id", "q", 20),
        "vectors": lambda n: search.top_cosine(rows.repartition(n), "id", "v", wanted, "id", "v", 20),
    }
    for name, run in runs.items():
        sent, found = [], []
        for n in (spark.sparkContext.defaultParallelism, 16 * spark.sparkContext.defaultParallelism):
            before = written(spark)
            found.append(sorted(run(n).collect(), key=str))
            sent.append(written(spark) - before)
        assert found[0] == found[1] and sent[1] < 2 * sent[0], (name, sent)


def test_contents_without_hits_are_not_shuffled(spark, monkeypatch):
    texts = spark.range(2000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 100), x -> hex(hash(id, x)))) AS content").repartition(4).cache()
    texts.count()
    hits = spark.createDataFrame([(1, 3, 0.5), (1, 7, 0.4), (2, 3, 0.3), (2, None, 0.2)], "query_id long, doc_id long, score double")
    asked = spark.createDataFrame([(1, "um"), (2, "dois"), (3, "nada")], "query_id long, q string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written(spark)
        found = Engine(texts).rerank(asked, hits).select("query_id", "doc_id").collect()
        assert sorted(map(tuple, found)) == [(1, 3), (1, 7), (2, 3)] and written(spark) - before < 200_000  # all contents take more than 1 MB
        monkeypatch.setattr(search, "SENT", 0)
        assert sorted(map(tuple, Engine(texts).rerank(asked, hits).select("query_id", "doc_id").collect())) == [(1, 3), (1, 7), (2, 3)]
        assert written(spark) - before > 1_000_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
