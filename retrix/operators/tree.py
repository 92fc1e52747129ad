"""Hierarchical summary index: levels of clusters over vectors, searched as one collapsed list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrix.functions.vectors import cosine
from retrix.operators import mixtures
from retrix.sources.tables import cut

SEED = 42
#: Points that one task clusters, parts into which a larger group is divided at once, and points on which the
#: centres of the parts are fitted.
GROUP, PARTS, SAMPLE = 4096, 64, 8192


def _centres(data: np.ndarray, k: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    """Centres by Lloyd's rounds from different rows; one that loses all its rows goes."""
    distinct = np.unique(data, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[: max(1, k)]]
    for _ in range(rounds):
        near = _nearest(data, centres)
        held = np.unique(near)
        centres = np.stack([data[near == c].mean(axis=0) for c in held])
    return centres


def _nearest(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * data @ centres.T).argmin(axis=1)


def _grouped(points: DataFrame, limit: int) -> DataFrame:
    """``id``, ``vector`` and ``grp``: groups of neighbouring points, of ``limit`` at most.

    A group that is larger is divided by PARTS centres, fitted on a bounded sample of it (the least by a hash of the
    id), again and again; one that these cannot divide, of equal points, is divided by a hash.
    """
    spark = points.sparkSession
    done, left, depth = None, points.select("id", "vector", F.lit("").alias("grp")), 0
    while True:
        sizes = left.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        large = cut(sizes.where(F.col("n") > limit))
        fit = left.join(large, "grp", "left_anti")
        done = fit if done is None else done.unionByName(fit)
        if not large.limit(1).count():
            return done
        held = left.join(large, "grp")
        chosen = held.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("n"))

        def centres(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            ordered = rows.sort_values("id")
            found = _centres(np.stack(ordered["vector"].to_numpy()), PARTS)
            return pd.DataFrame({"grp": [key[0]], "centres": [found.reshape(-1).tolist()]})

        fitted = chosen.select("grp", "id", "vector").groupBy("grp").applyInPandas(centres, "grp string, centres array<double>")

        def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                part = np.zeros(len(rows), dtype=np.int64)
                for flat, index in rows.groupby(rows["centres"].map(lambda x: x.tobytes())).indices.items():
                    data = np.stack(rows["vector"].to_numpy()[index])
                    part[index] = _nearest(data, np.frombuffer(flat).reshape(-1, data.shape[1]))
                yield pd.DataFrame({"id": rows["id"], "vector": rows["vector"], "grp": rows["grp"] + "/" + pd.Series(part, index=rows.index).astype(str), "whole": rows["n"]})

        # a group's centres are a few kilobytes; the joined rows carry them only as far as this
        divided = held.join(fitted, "grp").select("id", "vector", "grp", "n", "centres").mapInPandas(divide, f"id {points.schema['id'].dataType.simpleString()}, vector array<double>, grp string, whole long")
        divided = cut(divided)
        same = divided.groupBy("grp").agg(F.count(F.lit(1)).alias("now"), F.max("whole").alias("whole")).where(F.col("now") > 0.95 * F.col("whole"))
        marked = divided.join(same.select("grp", F.ceil(F.col("now") / limit).alias("pieces")), "grp", "left")
        piece = F.when(F.col("pieces").isNotNull(), F.concat(F.col("grp"), F.lit("#"), F.pmod(F.xxhash64("id"), F.col("pieces") * 2).cast("string"))).otherwise(F.col("grp"))
        left, depth = cut(marked.select("id", "vector", piece.alias("grp"))), depth + 1


def clusters(points: DataFrame, per_cluster: int = 8, seed: int = SEED, limit: int = GROUP) -> DataFrame:
    """``id``, ``cluster`` and the cluster's ``centroid`` for points (``id``, ``vector`` of doubles), about ``per_cluster`` to
    a cluster. Clusters are made inside groups of neighbouring points, each in one task, so the work grows with the
    points, not with the points times the clusters; no centres reach the driver."""

    def within(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        data = np.stack(rows["vector"].to_numpy())
        centres = _centres(data, max(1, round(len(data) / per_cluster)), seed=seed)
        near = _nearest(data, centres)
        return pd.DataFrame({"id": rows["id"].to_numpy(), "cluster": [f"{key[0]}:{c}" for c in near], "centroid": list(centres[near])})

    kind = points.schema["id"].dataType.simpleString()
    placed = _grouped(points, limit).groupBy("grp").applyInPandas(within, f"id {kind}, cluster string, centroid array<double>")
    return placed.withColumn("cluster", F.xxhash64("cluster"))


def build(points: DataFrame, levels: int = 3, per_cluster: int = 8, least: int = 2) -> DataFrame:
    """Nodes of the tree: ``node``, ``level``, ``vector``, ``tokens``, ``parent``. A level has one node for about
    ``per_cluster`` nodes below; it is the last when fewer than ``least`` clusters would be made."""
    current = cut(points.select(F.col("id").cast("long").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.col("tokens").cast("long").alias("tokens")))
    out = None
    for level in range(levels + 1):
        count = current.count()
        last = level == levels or count // per_cluster < least
        if last:
            rows = current.select(F.col("id").alias("node"), F.lit(level).alias("level"), "vector", "tokens", F.lit(None).cast("long").alias("parent"))
            return rows if out is None else out.unionByName(rows)
        # a parent's number: those of a level share their first digits, so no two nodes have the same
        parent = (F.pmod(F.col("cluster"), F.lit(1 << 55)) + F.lit((level + 1) << 56)).alias("parent")
        placed = cut(clusters(current.select("id", "vector"), per_cluster).join(current, "id").select("id", "vector", "tokens", "centroid", parent))
        rows = placed.select(F.col("id").alias("node"), F.lit(level).alias("level"), "vector", "tokens", "parent")
        out = rows if out is None else out.unionByName(rows)
        current = cut(placed.groupBy(F.col("parent").alias("id")).agg(F.min("centroid").alias("vector"), F.least(F.sum("tokens"), F.lit(200)).alias("tokens")))
    return out


def summary(tree: DataFrame) -> DataFrame:
    """Nodes, parents and tokens by level."""
    return tree.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("parent").alias("parents"), F.sum("tokens").alias("tokens"))


def collapsed_search(tree: DataFrame, vector: list[float], k: int = 20, max_tokens: int = 2000, fetch: int = 200) -> DataFrame:
    """Nodes of all levels by similarity, taken while they fit into the budget; those that don't are passed over.

    The nodes are looked through in pages of ``fetch``, each page only of those behind the last and small enough for
    what is left, until k are taken, the budget is spent or none is left: so all nodes are considered.
    """
    scored = tree.select("node", "level", "tokens", F.round(cosine(F.col("vector"), F.array(*map(F.lit, vector))), 9).alias("score"))
    taken: list[tuple[int, int, int, float, int]] = []
    room, last = max_tokens, None
    while len(taken) < k and room > 0:
        rest = scored.where(F.col("tokens") <= room)
        if last is not None:
            rest = rest.where((F.col("score") < last[0]) | (F.col("score") == last[0]) & (F.col("node") > last[1]))
        page = rest.orderBy(F.desc("score"), "node").limit(fetch).collect()  # a page
        for r in page:
            if r["tokens"] <= room and len(taken) < k:
                taken.append((len(taken), r["node"], r["level"], r["score"], r["tokens"]))
                room -= r["tokens"]
        if len(page) < fetch:
            break
        last = (page[-1]["score"], page[-1]["node"])
    return tree.sparkSession.createDataFrame(taken, "place int, node long, level int, score double, tokens long")


def mixture(points: DataFrame, most: int = 50, dimensions: int = 8, seed: int = SEED, by: str = "criterion") -> DataFrame:
    """``id``, ``cluster``, ``k`` and ``silhouette`` by a mixture of normal distributions over reduced vectors. The number of
    clusters, from 1 to min(most, n / 2), is the one with the least Bayes criterion; by "silhouette" it is the one, from 2
    to min(most, n / 3), with the largest mean silhouette. An empty table gives none."""
    ready = cut(points.select("id", F.lit(0).alias("grp"), F.transform("vector", lambda x: x.cast("double")).alias("vector")))
    return mixtures.fit(ready, most, by, dimensions, seed, 2 if by == "criterion" else 3).drop("grp")


def local_mixtures(points: DataFrame, most: int = 50, dimensions: int = 8, seed: int = SEED) -> DataFrame:
    """Clusters by a mixture over all vectors, and inside each by one over the cluster's vectors, reduced anew: ``id``, ``k``,
    ``cluster``, ``local_k``, ``local_cluster`` and ``silhouette`` of the cluster's own mixture."""
    ready = cut(points.select("id", F.lit(0).alias("grp"), F.transform("vector", lambda x: x.cast("double")).alias("vector")))
    outer = cut(mixtures.fit(ready, most, "criterion", dimensions, seed).select("id", "k", "cluster"))
    inner = mixtures.fit(cut(ready.drop("grp").join(outer, "id").select("id", F.col("cluster").alias("grp"), "vector")), most, "criterion", dimensions, seed)
    return outer.join(inner.select("id", F.col("k").alias("local_k"), F.col("cluster").alias("local_cluster"), "silhouette"), "id")
