"""Betweenness against plain counting of shortest paths."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from retrix.functions import text as X
from retrix.operators import graph
from retrix.plans import engine


def _plain(names, pairs):
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in names}

    def search(source):
        away, paths, order = {source: 0}, {source: 1}, [source]
        for v in order:
            for u in near[v] - {v}:
                if u not in away:
                    away[u], paths[u] = away[v] + 1, 0
                    order.append(u)
                if away[u] == away[v] + 1:
                    paths[u] += paths[v]
        return away, paths

    found = {v: search(v) for v in names}
    out = dict.fromkeys(names, 0.0)
    for s, t in combinations(names, 2):
        for v in names:
            if v not in (s, t) and t in found[s][0] and v in found[s][0] and t in found[v][0] and found[s][0][v] + found[v][0][t] == found[s][0][t]:
                out[v] += found[s][1][v] * found[v][1][t] / found[s][1][t]
    n = len(names)
    return {v: x / ((n - 1) * (n - 2) / 2) for v, x in out.items()}


@pytest.mark.parametrize("peels", [20, 1])
def test_betweenness(spark, peels):
    draw = random.Random(3)
    names = [f"v{i:02}" for i in range(24)]
    pairs = {tuple(draw.sample(names[:20], 2)) for _ in range(22)} | {("v20", "v21"), ("v01", "v01")}
    nodes = spark.createDataFrame([(v,) for v in names], "id string")
    edges = spark.createDataFrame([(a, "x", b) for a, b in sorted(pairs)] * 2, "src string, type string, dst string")
    found = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes, edges, peels).collect()}
    assert found == pytest.approx(_plain(names, pairs))


def test_a_bridge_of_few_edges_is_central(spark):
    pairs = [(f"{side}{i}", f"{side}{j}") for side in "ab" for i in range(4) for j in range(i)] + [("a0", "m"), ("m", "b0")]
    nodes = spark.createDataFrame([(v,) for v in sorted({x for p in pairs for x in p})], "id string")
    edges = spark.createDataFrame([(a, "x", b) for a, b in pairs], "src string, type string, dst string")
    assert "m" in [r["id"] for r in graph.central_entities(nodes, edges, 3).collect()]
    assert "m" not in [r["id"] for r in graph.top_central(nodes, edges, 5).collect()]


def test_quoted_and_technical_entities(spark):
    rows = spark.createDataFrame([('Use "hash join" with docker and ai. Ana Lima knows.',), (None,)], "t string")
    assert [r[0] for r in rows.select(X.entities(F.col("t"))).collect()] == [["Ana Lima", "Use", "docker", "hash join"], None]


def test_blocks_of_code_raise_answers_on_implementation(spark):
    docs = spark.createDataFrame([(1, "sort rows"), (2, "sort rows ```a``` ```b```")], "doc_id long, content string")

    class Fixed(engine.Engine):
        def __init__(self):
            self.documents = docs

        def hybrid(self, questions, k=10):
            return questions.crossJoin(docs.select("doc_id")).select("query_id", "doc_id", F.when(F.col("doc_id") == 1, 0.5).otherwise(0.4).alias("score"))

    asked = spark.createDataFrame([(1, "implement code")], "query_id long, q string")
    assert {(r["doc_id"], r["score"]) for r in Fixed().adaptive(asked).collect()} == {(1, 0.5), (2, 0.52)}
