"""Mixtures with the number of clusters found."""

from __future__ import annotations

import numpy as np
import pytest

from retrix.operators import mixtures, tree


def _points(spark, centres, each, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in centres[i % len(centres)] + 0.2 * rng.normal(size=3)]) for i in range(each * len(centres))]
    return spark.createDataFrame(rows, "id long, vector array<double>")


@pytest.mark.parametrize("small", [mixtures.SMALL, 10])
def test_more_than_five_and_single_clusters(spark, monkeypatch, small):
    monkeypatch.setattr(mixtures, "SMALL", small)  # 10: fitted by passes
    centres = [np.array([x, y, z]) * 10.0 for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    for by in ("criterion", "silhouette"):
        found = tree.mixture(_points(spark, centres, 40), most=12, dimensions=3, by=by).collect()
        assert {r["k"] for r in found} == {8}
        assert len({(r["id"] % 8, r["cluster"]) for r in found}) == 8
    assert {r["k"] for r in tree.mixture(_points(spark, centres[:1], 200), most=6, dimensions=3).collect()} == {1}


def test_local_clusters(spark):
    found = tree.local_mixtures(_points(spark, [np.zeros(3), np.full(3, 9.0), np.full(3, 99.0)], 50), most=8, dimensions=2).collect()
    assert len(found) == 150 and all(r["local_cluster"] < r["local_k"] for r in found)
    assert len({(r["id"] % 3, r["cluster"], r["local_cluster"]) for r in found}) >= 3
