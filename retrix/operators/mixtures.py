"""Mixtures of normal distributions with the number of clusters found, for one group of vectors or several at once.

A group of up to ``SMALL`` rows is fitted in one task; a larger one by passes over all its rows, whose sums are
combined on the executors, so that only statistics of fixed size reach the driver. All numbers of clusters of all
groups share a pass. Samples serve only to begin: every row is in every fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrix.sources.tables import cut

SEED, SMALL, BEGIN, BLOCK = 42, 65_536, 1024, 2048
#: Added to variances; least gain of the mean log-likelihood; most rounds: those of the common library.
FLOOR, GAIN, ROUNDS = 1e-6, 1e-3, 100


def _features(z: np.ndarray) -> np.ndarray:
    """1, the coordinates and their products: densities and moments are linear in these."""
    return np.hstack([np.ones((len(z), 1)), z, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)])


def _coefficients(stats: np.ndarray, n: int) -> np.ndarray:
    """Log densities by feature and component, from the components' sums of features."""
    d = int((math.sqrt(4 * stats.shape[1] - 3) - 1) / 2)
    held = stats[:, :1] + 1e-15
    mean = stats[:, 1 : 1 + d] / held
    spread = (stats[:, 1 + d :] / held).reshape(-1, d, d) - mean[:, :, None] * mean[:, None, :]
    spread = (spread + spread.transpose(0, 2, 1)) / 2 + FLOOR * np.eye(d)
    inverse = np.linalg.inv(spread)
    linear = np.einsum("kij,kj->ki", inverse, mean)
    constant = np.log(held[:, 0] / n) - 0.5 * (d * math.log(2 * math.pi) + np.linalg.slogdet(spread)[1] + np.einsum("ki,ki->k", mean, linear))
    return np.vstack([constant, linear.T, -0.5 * inverse.reshape(len(mean), -1).T])


def _starts(ks: list[int]) -> np.ndarray:
    return np.cumsum([0, *ks])[:-1]


def _soft(phi: np.ndarray, ks: list[int], coef: np.ndarray) -> np.ndarray:
    """Sums of features by component and log-likelihoods by model, of a block of rows."""
    starts, model = _starts(ks), np.repeat(np.arange(len(ks)), ks)
    logs = phi @ coef
    top = np.maximum.reduceat(logs, starts, axis=1)
    share = np.exp(logs - top[:, model])
    total = np.add.reduceat(share, starts, axis=1)
    share /= total[:, model]
    return np.concatenate([(share.T @ phi).ravel(), (np.log(total) + top).sum(0)])


def _labels(phi: np.ndarray, ks: list[int], coef: np.ndarray) -> list[np.ndarray]:
    logs = phi @ coef
    return [logs[:, s : s + k].argmax(1) for s, k in zip(_starts(ks), ks)]


def _hard(phi: np.ndarray, ks: list[int], coef: np.ndarray) -> np.ndarray:
    """Sums of features of the rows placed in each component."""
    return np.concatenate([(np.eye(k)[own].T @ phi).ravel() for own, k in zip(_labels(phi, ks, coef), ks)])


def _silhouette(phi: np.ndarray, ks: list[int], coef: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Summed silhouettes (squared distances) by model."""
    out, d = [], coef.shape[0]
    width = int((math.sqrt(4 * d - 3) - 1) / 2)
    square = phi[:, 1 : 1 + width] ** 2
    for start, k, own in zip(_starts(ks), ks, _labels(phi, ks, coef)):
        part = sums[start : start + k]
        held = part[:, 0]
        safe = np.maximum(held, 1)
        away = square.sum(1)[:, None] - 2 * phi[:, 1 : 1 + width] @ (part[:, 1 : 1 + width] / safe[:, None]).T + part[:, 1 + width :].reshape(k, width, width).trace(axis1=1, axis2=2) / safe
        away = np.where(held > 0, np.maximum(away, 0), np.inf)
        at, count = np.arange(len(own)), held[own]
        near = away[at, own] * count / np.maximum(count - 1, 1)
        away[at, own] = np.inf
        other = away.min(1)
        good = (count > 1) & np.isfinite(other)
        out.append(((np.where(good, other, 0) - near) / np.maximum(np.maximum(np.where(good, other, 0), near), 1e-300))[good].sum())
    return np.array(out)


def _begin(sample: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Centres far from each other; the first k begin the model of k clusters."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    away = ((sample - centres[0]) ** 2).sum(1)
    while len(centres) < most:
        centres.append(sample[rng.choice(len(sample), p=away / away.sum()) if away.sum() > 0 else rng.integers(len(sample))])
        away = np.minimum(away, ((sample - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def _first(sample: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums of features of the sample's rows by nearest centre, after ten rounds of moving the centres."""
    k, square = len(centres), (sample**2).sum(1)
    for _ in range(10):
        own = (square[:, None] - 2 * sample @ centres.T + (centres**2).sum(1)).argmin(1)
        held = np.eye(k)[own]
        count = held.sum(0)[:, None]
        centres = np.where(count > 0, held.T @ sample / np.maximum(count, 1), centres)
    return held.T @ _features(sample)


Sums = Callable[..., dict[int, np.ndarray]]


def _fit(sizes: dict[int, int], width: int, used: dict[int, int], samples: dict[int, np.ndarray], ks: dict[int, list[int]], by: str, seed: int, total: Sums) -> dict[int, tuple[int, np.ndarray, float]]:
    """By group the chosen number of clusters, its coefficients and its silhouette. ``total`` sums a function over all rows of the groups."""
    coef: dict[int, dict[int, np.ndarray]] = {}
    likely: dict[int, dict[int, float]] = {g: {} for g in sizes}
    for g, n in sizes.items():
        centres = _begin(samples[g], max(ks[g]), seed)
        coef[g] = {k: _coefficients(_first(samples[g], centres[:k]), len(samples[g])) for k in ks[g]}
    active = {g: list(k) for g, k in ks.items()}
    for _ in range(ROUNDS):
        active = {g: k for g, k in active.items() if k}
        if not active:
            break
        sums = total(_soft, {g: (k, np.hstack([coef[g][x] for x in k])) for g, k in active.items()})
        for g, k in active.items():
            stats, now = sums[g][: -len(k)].reshape(-1, 1 + width + width**2), sums[g][-len(k) :] / sizes[g]
            going = []
            for start, x, reached in zip(_starts(k), k, now):
                before = likely[g].get(x, -math.inf)
                likely[g][x] = float(reached)
                if abs(reached - before) >= GAIN:
                    coef[g][x] = _coefficients(stats[start : start + x], sizes[g])
                    going.append(x)
            active[g] = going
    chosen = {}
    if by == "criterion":
        for g, n in sizes.items():
            d = used[g]
            free = lambda k: k * (d + d * (d + 1) / 2) + k - 1  # noqa: B023, E731
            chosen[g] = min(ks[g], key=lambda k: (free(k) * math.log(n) - 2 * n * likely[g][k], k))  # noqa: B023
    asked = {g: ks[g] if by == "silhouette" else [chosen[g]] for g in sizes}
    given = {g: (k, np.hstack([coef[g][x] for x in k])) for g, k in asked.items()}
    sums = total(_hard, given)
    shares = total(_silhouette, {g: (*given[g], sums[g].reshape(-1, 1 + width + width**2)) for g in sizes})
    out = {}
    for g, n in sizes.items():
        score = dict(zip(asked[g], shares[g] / n))
        k = chosen[g] if g in chosen else max(score, key=lambda x: (score[x], -x))
        out[g] = (k, coef[g][k], float(score[k]))
    return out


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch by group, in blocks."""
    groups = batch.column("grp").to_numpy(zero_copy_only=False)
    z = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(groups), -1)
    for g in np.unique(groups):
        rows = z[groups == g]
        for at in range(0, len(rows), BLOCK):
            yield int(g), rows[at : at + BLOCK]


def _summed(df: DataFrame, column: str, function: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Sums of a function's arrays over all rows of each group: one row a group reaches the driver."""

    def rows_of(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*held], type=pa.int32()), pa.array([x.astype(np.float64).tobytes() for x in held.values()], type=pa.binary())], names=["grp", "stats"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, rows in _blocks(batch, column):
                got = function(g, rows)
                held[g] = held[g] + got if g in held else got
        yield rows_of(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[g] = held[g] + np.frombuffer(raw) if g in held else np.frombuffer(raw)
        yield rows_of(held)

    schema = "grp int, stats binary"
    return {r["grp"]: np.frombuffer(r["stats"]) for r in df.select("grp", column).mapInArrow(part, schema).repartition("grp").mapInArrow(join, schema).collect()}


def fit(points: DataFrame, most: int = 50, by: str = "criterion", dimensions: int = 8, seed: int = SEED, least: int = 2) -> DataFrame:
    """``id``, ``grp``, ``k``, ``cluster`` and ``silhouette`` (of the group) of points (``id``, ``grp``, ``vector`` of doubles).

    Each group is reduced to its own principal components. ``by`` "criterion": the k from 1 to min(most, n / least) with
    the least Bayes criterion; "silhouette": that from 2 on with the largest mean silhouette. Groups too small for two
    clusters are one, of silhouette 0.
    """
    spark = points.sparkSession
    moments = _summed(points, "vector", lambda g, rows: np.concatenate([[len(rows)], rows.sum(0), (rows.T @ rows).ravel()]))
    sizes, used, axes = {}, {}, {}
    width = 1
    for g, found in moments.items():
        n = sizes[g] = int(found[0])
        d = int((math.sqrt(4 * len(found) - 3) - 1) / 2)
        mean = found[1 : 1 + d] / n
        values, vectors = np.linalg.eigh(found[1 + d :].reshape(d, d) / n - np.outer(mean, mean))
        used[g] = max(1, min(dimensions, d, n - 1))
        width = max(width, used[g])
        axes[g] = (mean, vectors[:, np.argsort(-values)[: used[g]]])
    shared = spark.sparkContext.broadcast(axes)  # one matrix a group

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            z, out = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(groups), -1), np.zeros((len(groups), width))
            for g in np.unique(groups):
                mean, axis = shared.value[int(g)]
                out[groups == g, : axis.shape[1]] = (z[groups == g] - mean) @ axis
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grp"), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), width).cast(pa.list_(pa.float64()))], names=["id", "grp", "z"])

    kind = points.schema["id"].dataType.simpleString()
    reduced = cut(points.select("id", "grp", "vector").mapInArrow(reduce, f"id {kind}, grp int, z array<double>"))
    ks = {g: list(range(1 if by == "criterion" else 2, min(most, n // least) + 1)) or [1] for g, n in sizes.items()}
    if by == "silhouette":
        ks = {g: [k for k in v if k < sizes[g]] or [1] for g, v in ks.items()}
    models: dict[int, tuple[int, np.ndarray, float]] = {}
    large = {g: n for g, n in sizes.items() if n > SMALL}
    if large:
        mine = reduced.where(F.col("grp").isin(list(large)))
        part = F.create_map(*(F.lit(x) for g, n in large.items() for x in (g, BEGIN / n)))[F.col("grp")]
        drawn: dict[int, list] = {g: [] for g in large}
        for r in mine.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part * (1 << 30)).orderBy("id").collect():  # about BEGIN rows a group
            drawn[r["grp"]].append(r["z"])

        def passes(function, given):
            held = spark.sparkContext.broadcast(given)
            got = _summed(mine.where(F.col("grp").isin(list(given))), "z", lambda g, rows: function(_features(rows), *held.value[g]))
            held.destroy()
            return got

        models |= _fit(large, width, used, {g: np.array(x) for g, x in drawn.items()}, {g: ks[g] for g in large}, by, seed, passes)
    small = {g for g in sizes if g not in large}
    if small:
        def alone(own: pa.Table) -> pa.Table:
            own = own.combine_chunks().sort_by("id")
            g = own.column("grp")[0].as_py()
            z = np.array(own.column("z").combine_chunks().flatten()).reshape(own.num_rows, -1)
            parts = [_features(z[at : at + BLOCK]) for at in range(0, len(z), BLOCK)]
            total = lambda function, given: {g: sum(function(phi, *given[g]) for phi in parts)}
            sample = z[np.sort(np.random.default_rng(seed).permutation(len(z))[:BEGIN])]
            k, coef, score = _fit({g: len(z)}, width, used, {g: sample}, {g: ks[g]}, by, seed, total)[g]
            return pa.table({"grp": pa.array([g], pa.int32()), "k": pa.array([k], pa.int32()), "coef": pa.array([coef.tobytes()], pa.binary()), "score": pa.array([score], pa.float64())})

        rows = reduced.where(F.col("grp").isin(list(small))).groupBy("grp").applyInArrow(alone, "grp int, k int, coef binary, score double").collect()  # one row a group
        models |= {r["grp"]: (r["k"], np.frombuffer(r["coef"]).reshape(-1, r["k"]), r["score"]) for r in rows}
    placed = spark.sparkContext.broadcast(models)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(len(groups), -1)
            own, many, score = np.zeros(len(groups), np.int32), np.zeros(len(groups), np.int32), np.zeros(len(groups))
            for g in np.unique(groups):
                k, coef, value = placed.value[int(g)]
                at = groups == g
                own[at], many[at], score[at] = _labels(_features(z[at]), [k], coef)[0], k, value
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grp"), pa.array(many), pa.array(own), pa.array(score)], names=["id", "grp", "k", "cluster", "silhouette"])

    return reduced.mapInArrow(place, f"id {kind}, grp int, k int, cluster int, silhouette double")
