"""Percentiles of large numeric columns by merging centroid digests, with certified rank errors.

A digest is a list of centroids (mean, weight) in order of value. The size function
k(q) = compression * (asin(2q - 1) / pi + 1/2) maps ranks to clusters, fine at the tails and coarse in the
middle; values whose middle ranks fall into one unit of k form one centroid. Digests are merged by putting
their centroids together, sorting them and clustering again, so digests of partitions or days add up to
that of the whole. A second pass counts the values below and up to every estimate, which gives the true
rank of the estimate and with it its exact rank error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrix.sources.tables import cut

COMPRESSION = 500
#: Values or centroids that a task holds before it clusters them.
BUFFER = 1_000_000
#: Parts into which the rows of one key are spread before their digests meet in one task.
SALTS = 16
#: The rank error, as a share of the rows, that the digests promise at this compression.
RANK_BOUND = 0.01


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of several groups at once: group, mean and weight, sorted by group and mean."""
    if not len(group):
        return group, mean, weight
    order = np.lexsort((mean, group))
    group, mean, weight = group[order], mean[order], weight[order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    lengths = np.diff(np.append(first, len(group)))
    total = np.cumsum(weight)
    before = np.repeat(total[first] - weight[first], lengths)
    q = (total - before - weight / 2) / np.repeat(np.add.reduceat(weight, first), lengths)
    k = np.floor(compression * (np.arcsin(np.clip(2 * q - 1, -1, 1)) / np.pi + 0.5)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (k[1:] != k[:-1])))
    weights = np.add.reduceat(weight, starts)
    low, high = np.minimum.reduceat(mean, starts), np.maximum.reduceat(mean, starts)
    means = np.clip(np.add.reduceat(mean * weight, starts) / weights, low, high)
    return group[starts], means, weights


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """The value at the share ``q`` of the ranks: a value itself where its centroid is one value, else
    interpolated between the centroids' middles."""
    upto = np.cumsum(weights)
    total = upto[-1]
    at = min(int(np.searchsorted(upto, q * total)), len(means) - 1)
    if weights[at] == 1:
        return float(means[at])
    return float(np.interp(q * total, np.concatenate([[0.0], upto - weights / 2, [total]]), np.concatenate([[low], means, [high]])))


class _Pool:
    """Digests of many groups in one task, clustered again whenever the buffer is full."""

    def __init__(self, keys: Sequence[str], compression: int):
        self.keys, self.compression = list(keys), compression
        self.codes: dict[tuple, int] = {}
        self.low = np.zeros(0)
        self.high = np.zeros(0)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def code(self, frame: pd.DataFrame) -> np.ndarray:
        """The group number of every row."""
        within = frame.groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()
        _, at = np.unique(within, return_index=True)
        own = np.zeros(len(at), dtype=np.int64)
        for k, row in enumerate(frame[self.keys].iloc[at].itertuples(index=False, name=None)):
            key = tuple(None if pd.isna(x) else x for x in row)
            own[k] = self.codes.setdefault(key, len(self.codes))
        grow = len(self.codes) - len(self.low)
        self.low = np.concatenate([self.low, np.full(grow, np.inf)])
        self.high = np.concatenate([self.high, np.full(grow, -np.inf)])
        return own[within]

    def add(self, group: np.ndarray, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        np.minimum.at(self.low, group, low)
        np.maximum.at(self.high, group, high)
        self.parts.append((group, mean, weight))
        self.held += len(group)
        if self.held > BUFFER:
            self.shrink()

    def shrink(self) -> None:
        self.parts = [cluster(*(np.concatenate(x) for x in zip(*self.parts)), self.compression)]
        self.held = len(self.parts[0][0])

    def digests(self) -> Iterator[pd.DataFrame]:
        if not self.parts:
            return
        self.shrink()
        group, mean, weight = self.parts[0]
        names = list(self.codes)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(starts[1:], len(group))
        for at in range(0, len(starts), 2000):
            rows = list(zip(starts[at : at + 2000], ends[at : at + 2000]))
            out = pd.DataFrame([names[group[s]] for s, _ in rows], columns=self.keys)
            out["low"], out["high"] = [self.low[group[s]] for s, _ in rows], [self.high[group[s]] for s, _ in rows]
            out["means"], out["weights"] = [mean[s:e] for s, e in rows], [weight[s:e] for s, e in rows]
            yield out


def _digest_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "low double, high double, means array<double>, weights array<double>"])


def digests(values: DataFrame, keys: Sequence[str], value_col: str, compression: int = COMPRESSION) -> DataFrame:
    """One digest for each partition's rows of each key; null values are left out. No shuffle."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = _Pool(keys, compression)
        for frame in frames:
            if len(frame):
                group, value = pool.code(frame), frame[value_col].to_numpy(np.float64)
                pool.add(group, value, np.ones(len(value)), value, value)
        yield from pool.digests()

    used = values.select(*keys, value_col).where(F.col(value_col).isNotNull())
    return used.mapInPandas(build, _digest_schema(values, keys))


def merge(parts: DataFrame, keys: Sequence[str], compression: int = COMPRESSION, salts: int = SALTS) -> DataFrame:
    """One digest per key out of any number of digests; first in ``salts`` parts of a key, then whole."""

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = _Pool(keys, compression)
        for frame in frames:
            if len(frame):
                code = pool.code(frame)
                lengths = frame["means"].map(len).to_numpy()
                pool.add(
                    np.repeat(code, lengths),
                    np.concatenate(frame["means"].to_list()),
                    np.concatenate(frame["weights"].to_list()),
                    np.repeat(frame["low"].to_numpy(), lengths),
                    np.repeat(frame["high"].to_numpy(), lengths),
                )
        yield from pool.digests()

    schema = _digest_schema(parts, keys)
    columns = [*keys, "low", "high", "means", "weights"]
    halfway = parts.select(*columns).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    halfway = halfway.repartition(*keys, "salt").drop("salt").mapInPandas(join, schema)
    return halfway.repartition(*keys).mapInPandas(join, schema)


def estimates(merged: DataFrame, keys: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Per key an array ``estimates`` with one value for each of ``quantiles``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[list(keys)].copy()
            out["estimates"] = [[quantile(m, w, lo, hi, q) for q in quantiles] for m, w, lo, hi in zip(frame["means"], frame["weights"], frame["low"], frame["high"])]
            yield out

    schema = ", ".join([*(f"`{k}` {merged.schema[k].dataType.simpleString()}" for k in keys), "estimates array<double>"])
    return merged.mapInPandas(read, schema)


def certify(values: DataFrame, keys: Sequence[str], value_col: str, estimated: DataFrame, quantiles: Sequence[float], salts: int = SALTS) -> DataFrame:
    """Counts the rows below and up to every estimate: per key and quantile ``n``, ``estimate`` and ``rank_error``.

    The error is the distance of the share q * n from the ranks that the estimate takes, over n. Rows are
    spread over ``salts`` parts of their key and counted before they are shuffled.
    """
    left = values.select(*keys, F.col(value_col).alias("value")).where("value is not null")
    left = left.withColumn("salt", F.pmod(F.xxhash64("value", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    right = estimated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    for k in keys:
        right = right.withColumnRenamed(k, f"__{k}")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = left.join(right.withColumnRenamed("salt", "__salt"), on + [F.col("salt") == F.col("__salt")])
    at = lambda j: F.col("estimates")[j]
    sums = [F.count(F.lit(1)).alias("n"), F.first("estimates").alias("estimates")]
    sums += [F.sum((F.col("value") < at(j)).cast("long")).alias(f"lt{j}") for j in range(len(quantiles))]
    sums += [F.sum((F.col("value") <= at(j)).cast("long")).alias(f"le{j}") for j in range(len(quantiles))]
    counted = joined.groupBy(*keys).agg(*sums)
    rows = F.array(*(F.struct(F.lit(float(q)).alias("quantile"), at(j).alias("estimate"), F.col(f"lt{j}").alias("lt"), F.col(f"le{j}").alias("le")) for j, q in enumerate(quantiles)))
    long = counted.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "n", "r.*")
    wanted = F.col("quantile") * F.col("n")
    error = F.greatest(F.col("lt") - wanted, wanted - F.col("le"), F.lit(0.0)) / F.col("n")
    return long.select(*keys, "quantile", "n", "estimate", error.alias("rank_error"))


def countable(value: Column) -> Column:
    """The value, or null where it is null, NaN, infinite or negative."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf")), value)


def percentiles(
    df: DataFrame,
    id_col: str,
    group_col: str,
    time_col: str,
    value_cols: Sequence[str],
    quantiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99),
    compression: int = COMPRESSION,
    bound: float = RANK_BOUND,
) -> DataFrame:
    """Percentiles of ``value_cols`` per group and day, and per group over all days (``day`` null).

    Columns: ``grp`` (lower case, trimmed; null and blank give ''), ``day``, ``metric``, ``quantile``,
    ``n``, ``estimate``, ``rank_error`` and ``within_bound``. The digest of the whole period is the merger of
    the days' digests (rows without time count there, as a day of their own that is not reported).

    A repeated id counts once (the least row by time and values); rows with a null id don't count. Null,
    NaN, infinite and negative values don't count. A group without values has no row; an empty table gives
    an empty result. Ties share their ranks, so an estimate among ties has no error.
    """
    picked = df.select(
        F.col(id_col).alias("__id"),
        F.struct(
            F.to_date(F.col(time_col)).alias("day"),
            F.coalesce(F.lower(F.trim(F.col(group_col))), F.lit("")).alias("grp"),
            *(countable(F.col(c).cast("double")).alias(f"v{k}") for k, c in enumerate(value_cols)),
        ).alias("row"),
    ).where("__id is not null")
    once = picked.groupBy("__id").agg(F.min("row").alias("row")).select("row.*")
    names = F.create_map(*(x for k, c in enumerate(value_cols) for x in (F.lit(k), F.lit(c))))
    metrics = F.array(*(F.struct(F.lit(k).alias("m"), F.col(f"v{k}").alias("value")) for k in range(len(value_cols))))
    values = cut(once.select("grp", "day", F.explode(metrics).alias("x")).select("grp", "day", "x.m", "x.value").where("value is not null"))
    daily = cut(merge(digests(values, ["grp", "day", "m"], "value", compression), ["grp", "day", "m"], compression))
    whole = merge(daily, ["grp", "m"], compression)
    out = []
    for keys, merged in ((["grp", "day", "m"], daily), (["grp", "m"], whole)):
        checked = certify(values, keys, "value", estimates(merged, keys, quantiles), quantiles)
        checked = checked.where("day is not null") if "day" in keys else checked.withColumn("day", F.lit(None).cast("date"))
        out.append(checked.select("grp", "day", names[F.col("m")].alias("metric"), "quantile", "n", "estimate", "rank_error", (F.col("rank_error") <= bound).alias("within_bound")))
    return out[0].unionByName(out[1])
