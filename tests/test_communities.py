"""Communities and ranks of whole graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retrix.operators import graph
from retrix.plans import graph_queries
from retrix.sources.tables import cut


def test_communities_settle_on_two_sided_graphs(spark):
    pairs = [("h", f"x{i}") for i in range(6)] + [("k", f"y{i}") for i in range(6)] + [("h", "k")]
    nodes = spark.createDataFrame([(v,) for v in sorted({x for p in pairs for x in p})], "id string")
    edges = spark.createDataFrame([(a, "x", b) for a, b in pairs], "src string, type string, dst string")
    label = {r["id"]: r["community"] for r in graph.communities(nodes, edges).collect()}
    assert all(label[b] == label[a] for a, b in pairs if b[0] in "xy")  # each leaf has its hub's label
    found = graph.modularity(graph.communities(nodes, edges), edges).collect()
    ends = {c: sum((label[a] == c) + (label[b] == c) for a, b in pairs) for c in label.values()}
    plain = sum(label[a] == label[b] for a, b in pairs) / 13 - sum((x / 26) ** 2 for x in ends.values())
    assert sum(r["modularity"] for r in found) == pytest.approx(plain)


def test_queries_use_the_whole_graph(spark, data, monkeypatch):
    seen = {}
    monkeypatch.setattr(graph, "communities", lambda n, e, **how: seen.update(n=n.count(), e=e.count(), how=how) or n.select("id", F.col("id").alias("community")))
    graph_queries.graph_communities(spark, data)
    assert seen == {"n": graph_queries.nodes(spark, data).count(), "e": graph_queries.edges(spark, data).count(), "how": {}}
    monkeypatch.setattr(graph, "page_rank", lambda n, e, rounds=20: seen.update(rounds=rounds) or n.select("id", F.lit(0.0).alias("rank")))
    graph_queries.graph_pagerank(spark, data)
    assert seen["rounds"] == 20


def _plainly(names, pairs, turn, limit=200):
    near = {v: {b for a, b in pairs if a == v and b != v} | {a for a, b in pairs if b == v and a != v} for v in names}
    label = {v: v for v in names}
    for number in range(1, limit):
        following = {}
        for v in names:
            counts = {}
            for u in near[v]:
                counts[label[u]] = counts.get(label[u], 0) + 1
            if counts and max(counts.values()) > counts.get(label[v], 0):
                following[v] = min((-n, c) for c, n in counts.items())[1]
        if not following:
            return label
        label = {v: following.get(v, label[v]) if turn[v, number] else label[v] for v in names}


@pytest.mark.parametrize("turns", [32, 2])
def test_communities_are_those_of_plain_rounds(spark, monkeypatch, turns):
    import random

    monkeypatch.setattr(graph, "TURNS", turns)
    rng = random.Random(3)
    names = [f"v{k}" for k in range(60)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(90)]
    hashed = spark.createDataFrame([(v,) for v in names], "id string").crossJoin(spark.range(1, 60).select(F.col("id").cast("int").alias("number")))
    turn = {(r["id"], r["number"]): r["t"] for r in hashed.select("id", "number", (F.pmod(F.xxhash64("id", "number"), F.lit(2)) == 0).alias("t")).collect()}
    nodes = spark.createDataFrame([(v,) for v in [*names, None]], "id string")
    edges = spark.createDataFrame([(a, "x", b) for a, b in [*pairs, ("gone", "v1"), (None, "v2")]], "src string, type string, dst string")
    found = graph.communities(nodes, edges).collect()
    assert {r["id"]: r["community"] for r in found} == {**_plainly(names, pairs, turn), None: None} and len(found) == 61


def test_no_round_sends_a_table_to_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "cut", lambda df: (lambda copy: plans.append(df) or copy)(cut(df)))
    nodes = spark.range(40).select(F.concat(F.lit("v"), "id").alias("id"))
    graph.communities(nodes, spark.range(39).select(F.concat(F.lit("v"), "id").alias("src"), F.lit("x").alias("type"), F.concat(F.lit("v"), F.col("id") + 1).alias("dst")))
    assert plans and not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in plans)
