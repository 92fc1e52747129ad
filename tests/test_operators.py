"""Operators against plain computations: graphs, folds, chunkers, votes, writes, texts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrix.functions import questions as Q
from retrix.functions import text as X
from retrix.functions import vectors as V
from retrix.operators import chunking, fusion, graph, memory, models, search, writes


def test_page_rank(spark):
    links = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2)]
    nodes = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    edges = spark.createDataFrame([(str(a), "x", str(b)) for a, b in links], "src string, type string, dst string")
    rank = np.full(5, 0.2)
    for _ in range(20):
        fresh = np.full(5, 0.15 / 5) + 0.85 * (rank[4]) / 5
        for a, b in links:
            fresh[b] += 0.85 * rank[a] / sum(x == a for x, _ in links)
        rank = fresh
    found = {r["id"]: r["rank"] for r in graph.page_rank(nodes, edges).collect()}
    assert [found[str(i)] for i in range(5)] == pytest.approx(rank.tolist())


def test_communities_and_hops(spark):
    edges = spark.createDataFrame([("a", "x", "b"), ("b", "x", "c"), ("a", "x", "c"), ("d", "x", "e"), ("e", "x", "f"), ("d", "x", "f")], "src string, type string, dst string")
    nodes = spark.createDataFrame([(c,) for c in "abcdefg"], "id string")
    found = {r["id"]: r["community"] for r in graph.communities(nodes, edges).collect()}
    assert found["a"] == found["b"] == found["c"] != found["d"] == found["e"] == found["f"] and found["g"] == "g"
    hops = {(r["id"], r["hops"]) for r in graph.k_hop(edges, spark.createDataFrame([("a",)], "id string"), 3).collect()}
    assert hops == {("a", 0), ("b", 1), ("c", 1)}
    assert {(r["pattern"], r["paths"]) for r in graph.path_patterns(edges, 2).collect()} == {("x>x", 2)}


def test_budget_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([([{"id": 1, "tokens": 5}, {"id": 2, "tokens": 9}, {"id": 3, "tokens": 3}, {"id": 4, "tokens": 2}],)], "h array<struct<id:long,tokens:long>>")
    assert rows.select(memory.budget_fold(F.col("h"), 10, 9)).first()[0] == [1, 3, 4]
    assert rows.select(memory.budget_fold(F.col("h"), 100, 2)).first()[0] == [1, 2]


def test_coverage_choice(spark):
    hits = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (0, 3, 0.7), (1, 4, 0.6), (2, 5, 0.1)], "head int, doc_id long, score double")
    assert [r["doc_id"] for r in fusion.coverage_choice(hits, 4).orderBy("place").collect()] == [1, 2, 4, 5]


def test_top_cosine_with_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (None, [1.0, 0.0]), (5, [1.0, 0.0])], "i long, v array<double>")
    asked = spark.createDataFrame([(9, [2.0, 0.0]), (10, None)], "q long, v array<double>")
    assert [tuple(r) for r in search.top_cosine(rows, "i", "v", asked, "q", "v", 5).orderBy("rank").collect()] == [(9, 1, 1.0, 1), (9, 5, 1.0, 2), (9, 2, 0.0, 3)]
    assert search.top_cosine(rows, "i", "v", asked.limit(0), "q", "v", 5).collect() == []


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(writes.upsert(old, new, ["k"])) == {(1, "a"), (2, "c"), (3, "d")}
    assert rows(writes.insert_only(old, new, ["k"])) == {(1, "a"), (2, "b"), (3, "d")}
    assert rows(writes.delete(old, new.select("k"), ["k"])) == {(1, "a")}
    assert rows(writes.update_fields(old, spark.createDataFrame([(1, None), (2, "z")], "k long, v string"), ["k"], ["v"])) == {(1, "a"), (2, "z")}
    assert rows(writes.orphans(old, "k", new, "k")) == {(1, "a")} and rows(writes.known(old, "k", new, "k")) == {(2, "b")}


def test_texts(spark):
    row = spark.createDataFrame([("Função é x, três! <b>y</b>", "Um. Dois? Três!")], "a string, b string").select(
        X.tokens(F.col("a")).alias("t"), X.sentences(F.col("b")).alias("s"), X.word_prefix(F.col("b"), 9).alias("p"), X.strip_markup(F.col("a")).alias("m"), X.token_estimate(F.col("b")).alias("n")
    ).first()
    assert row["t"] == ["função", "três"] and row["s"] == ["Um.", "Dois?", "Três!"] and row["p"] == "Um. Dois?" and row["m"] == "Função é x, três! y" and row["n"] == 3


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 5.0], [3.0, 1.0]])], "a array<double>, z array<double>, m array<array<double>>").select(
        V.norm(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("z")).alias("c"), V.combine(F.col("m")).alias("mean"), V.combine(F.col("m"), "max").alias("top"), V.unit(F.col("a")).alias("u")
    ).first()
    assert row["n"] == 5.0 and row["c"] == 0.0 and row["mean"] == [2.0, 3.0] and row["top"] == [3.0, 5.0] and row["u"] == [0.6, 0.8]


def test_chunkers(spark):
    text = "Parágrafo um. Outra frase.\n\n" * 40
    for name in chunking.STRATEGIES:
        assert chunking.STRATEGIES[name](text)
    pieces = chunking.recursive(text, 120, 20)
    assert all(len(p) <= 120 + 21 for p in pieces)
    assert "\n".join(chunking.by_lines("a\nb\nc", 1)) == "a\nb\nc"
    df = spark.createDataFrame([(1, text), (2, None), (3, "   ")], "k long, t string")
    assert {r["id"] for r in chunking.chunk(df, "k", "t", "structural").collect()} == {1}
    with pytest.raises(ValueError, match="unknown strategy"):
        chunking.chunk(df, "k", "t", "nothing")


def test_questions(spark):
    rows = spark.createDataFrame([("Liste frameworks python",), ("O que é isso?",), ("Explique como a fila repete lotes depois da carga",)], "q string")
    found = [tuple(r) for r in rows.select(Q.question_type(F.col("q")), Q.route_class(F.col("q")), Q.monitor_route(F.col("q"))).collect()]
    assert found == [("list", "simple", "vector_only"), ("definition", "simple", "vector_only"), ("explanation", "complex", "graph")]



def test_models_are_the_same_in_every_run():
    assert np.allclose(models.hash_vector("Olá mundo"), models.hash_vector("olá MUNDO")) and models.hash_vector("").sum() == 0
    assert models.lexical_score("a b", "b c") == 0.5
