"""Queries of the engine that serve every cached question, and the search in blocks that makes it possible."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrix.operators import blocks
from retrix.plans.catalogue import QUERIES
from retrix.plans.engine import Engine
from retrix.sources.tables import cut, folder_of, table
from tests.golden import EXPECTED, digest


@pytest.mark.parametrize("name", ["engine_combined", "engine_execute", "engine_multi_query"])
def test_every_question_is_answered(spark, data, name):
    every = {r["id"] for r in table(spark, data, "semantic_cache").where("query_text IS NOT NULL").select("id").collect()}
    found = cut(QUERIES[name](spark, data))
    assert len(every) > 100 and {r["query_id"] for r in found.select("query_id").distinct().collect()} == every
    assert digest(found.where("query_id % 100 = 0")) == EXPECTED[name]  # their rows do not depend on the other questions


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, f"comum palavra{k % 5} resto{k % 300} \"Dado Grande{k % 7}\"") for k in range(3000)]
    rows += [(None, "comum comum"), (None, "palavra3 comum"), (7, "comum palavra3 \"Dado Grande1\""), (9000, None), (9001, ""), (-5, "comum")]
    return spark.createDataFrame(rows, "doc_id long, content string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(k, f"Onde comum palavra{k % 5} resto{k} \"Dado Grande{k % 7}\" comum") for k in range(200)]
    return spark.createDataFrame(rows + [(900, "nada"), (901, None), (902, "comum"), (903, ""), (904, "resto7 resto8"), (None, "comum resto9")], "query_id long, q string")


@pytest.mark.parametrize("way", ["hybrid", "sparse", "by_entities", "heads", "multi_query", "execute"])
def test_blocks_give_the_rows_of_the_plain_search(texts, asked, way, monkeypatch):
    engine, rows = Engine(texts), []
    for many in (0, 1 << 30):
        monkeypatch.setattr(blocks, "MANY", many)
        rows.append(sorted(map(str, getattr(engine, way)(asked).collect())))
    assert rows[0] and rows[0] == rows[1]


def test_nearest_rows_are_those_of_a_whole_matrix(spark, monkeypatch):
    random = np.random.default_rng(1)
    rows, queries = random.integers(-1, 2, (700, 4)).astype(float), random.integers(-1, 2, (60, 4)).astype(float)  # ties, vectors of length 0
    keys = random.permutation(700)
    held = [(int(k), v.tolist()) for k, v in zip(keys, rows)] + [(None, [1.0] * 4), (800, [1.0]), (801, None)]
    folder = folder_of(cut(spark.createDataFrame(held, "doc_id long, vector array<double>").coalesce(3)))
    size = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1))
    scores = np.round(np.divide(queries @ rows.T, size, out=np.zeros_like(size), where=size > 0), 9)
    for batch, group, asking, some in ((1 << 16, 16, 256, 16_384), (128, 4, 7, 64), (40, 16, 60, 16)):
        for name, value in (("BATCH", batch), ("GROUP", group), ("ASKING", asking), ("ROWS", some), ("LOOKED", 50)):
            monkeypatch.setattr(blocks, name, value)
        who, key, score, rank = blocks._nearest(folder, queries, 7)
        best = [(q, k, s, n + 1) for q in range(60) for n, (s, k) in enumerate(sorted(zip(scores[q], keys), key=lambda x: (-x[0], x[1]))[:7])]
        assert list(zip(who, key, score, rank)) == best


def test_greatest_sums_are_those_of_a_whole_matrix(spark, monkeypatch):
    random = np.random.default_rng(2)
    held = random.random((500, 12)) < np.geomspace(0.6, 0.004, 12)
    value, wanted = np.round(random.random((500, 12)), 1) * held, random.random((80, 12)) < 0.3
    keys = random.permutation(500)
    rows = [(int(k), np.flatnonzero(h).tolist(), v[h].tolist()) for k, h, v in zip(keys, held, value)]
    folder = folder_of(cut(spark.createDataFrame(rows, "doc_id long, terms array<int>, values array<double>").coalesce(3)))
    weight = wanted * np.linspace(0.5, 2.0, 12)
    sums = np.round(weight @ value.T, 9)
    terms, weights = [np.flatnonzero(w).tolist() for w in wanted], [x[w].tolist() for x, w in zip(weight, wanted)]
    best = [(q, k, n + 1) for q in range(80) for n, (s, k) in enumerate(sorted(((s, k) for s, k in zip(sums[q], keys) if s > 0), key=lambda x: (-x[0], x[1]))[:6])]
    for batch, common in ((1 << 16, 7), (90, 7), (1 << 16, 0), (200, 12)):
        monkeypatch.setattr(blocks, "BATCH", batch)
        who, key, score, rank = blocks._greatest(folder, terms, weights, common, 12, 6)
        assert list(zip(who, key, rank)) == best and np.allclose(score, [sums[q, np.flatnonzero(keys == k)[0]] for q, k, _ in best])
