"""Both plans of the vector search give the same, the index is kept and renewed, the tree has bounded fan-out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrix.operators import search, sparse, tree
from retrix.sources import tables


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(rng.integers(-2, 3, (300, 6)))]
    rows += [(400, None), (401, [1.0]), (402, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (403, [0.0] * 6)]
    return spark.createDataFrame(rows, "k long, v array<double>").repartition(5)


def brute(rows, k):
    held = {r["k"]: np.array(r["v"]) for r in rows if r["k"] is not None and r["v"] is not None and len(r["v"]) == 6 and None not in r["v"]}
    out = set()
    for q in held:
        if q % 7 == 0:
            cosine = lambda v, w: round(float(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), 9) + 0.0 if np.linalg.norm(v) * np.linalg.norm(w) else 0.0
            out |= {(q, d) for d, _ in sorted(((d, cosine(held[q], v)) for d, v in held.items()), key=lambda x: (-x[1], x[0]))[:k]}
    return out


@pytest.mark.parametrize("how", [{}, {"sent": 0}, {"sent": 0, "cell_rows": 40}])
def test_top_cosine(vectors, how):
    found = search.top_cosine(vectors, "k", "v", vectors.where("k % 7 = 0"), "k", "v", 4, **how).where("query_id <> 401").collect()
    assert {(r["query_id"], r["doc_id"]) for r in found} == brute(vectors.collect(), 4) and max(r["rank"] for r in found) == 4
    assert search.top_cosine(vectors.where("false"), "k", "v", vectors, "k", "v", 4, **how).count() == 0
    assert search.top_cosine(vectors, "k", "v", vectors.where("false"), "k", "v", 4, **how).count() == 0


@pytest.mark.parametrize("how", [{}, {"sent": 0, "cell_rows": 40}])
def test_best_product(vectors, how):
    rows = vectors.where("k < 300").withColumn("g", F.col("k") % 3)
    found = {(r["query_id"], r["grp"]): r["best"] for r in search.best_product(rows, "g", "v", rows.where("k % 50 = 0"), "k", "v", **how).collect()}
    held = {r["k"]: np.array(r["v"]) for r in rows.collect()}
    assert found == {(q, g): max(float(held[q] @ v) for k, v in held.items() if k % 3 == g) for q in held if q % 50 == 0 for g in range(3)}


def test_terms_of_many_texts_are_spread(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"comum palavra{k % 5} outra{k}") for k in range(200)] + [(999, None)], "d long, t string")
    asked = spark.createDataFrame([(1, "comum palavra3 palavra3"), (2, "nada"), (3, None)], "q long, t string")
    lexicon = sparse.fit(docs, "d", "t")
    one = sparse.search(lexicon, asked, "q", "t", 60).collect()
    monkeypatch.setattr(sparse, "TERM_LIMIT", 7)
    assert sorted(sparse.search(lexicon, asked, "q", "t", 60).collect()) == sorted(one) and {r["query_id"] for r in one} == {1}


def test_what_is_kept_is_renewed_when_the_table_changes(spark, tmp_path):
    built = []
    get = tables.kept(lambda session, directory: built.append(directory) or len(built))
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert get(spark, str(tmp_path)) == 1 and get(spark, str(tmp_path)) == 1
    spark.range(3).write.parquet(f"{tmp_path}/u.parquet")
    assert get(spark, str(tmp_path)) == 2


def test_what_is_kept_is_built_again_when_its_copy_is_gone(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    built = []

    @tables.kept
    def get(session, directory):
        built.append(directory)
        return tables.cut(tables.table(session, directory, "t"))

    first = get(spark, str(tmp_path))
    assert get(spark, str(tmp_path)) is first and len(built) == 1
    tables.release(first)
    assert get(spark, str(tmp_path)).count() == 3 and len(built) == 2


def test_clusters_of_a_tree_are_made_in_bounded_groups(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 8)) * 10
    points = spark.createDataFrame([(int(k), [float(x) for x in centers[k % 40] + rng.normal(size=8) * 0.01]) for k in range(800)] + [(900 + k, [1.0] * 8) for k in range(300)], "id long, vector array<double>")
    for limit in (100, 5000):
        found = tree.clusters(points, 8, limit=limit).collect()
        assert len(found) == len({r["id"] for r in found}) == 1100
        groups: dict = {}
        for r in found:
            groups.setdefault(r["cluster"], []).append(r["id"])
        assert 60 <= len(groups) <= 260
        mixed = sum(len({k % 40 for k in ids}) > 1 for ids in groups.values() if max(ids) < 900)
        assert mixed <= 0.1 * len(groups)


def test_a_written_copy_leaves_no_shuffle_files(spark):
    import glob

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    count = lambda: len(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))
    before = count()
    copy = tables.cut(spark.range(2000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert copy.count() == 7 and count() <= before + 1 and spark.conf.get(tables._FREE_SHUFFLES) == "false"
