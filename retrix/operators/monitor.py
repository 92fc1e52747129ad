"""Aggregates over query metrics: summaries, percentiles, recent windows, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrix.operators.writes import latest

COMPONENTS = ("embedding_latency", "retrieval_latency", "reranking_latency", "generation_latency")


def once(metrics: DataFrame) -> DataFrame:
    """Each query_id once, as first received."""
    return latest(metrics, ["query_id"], F.asc_nulls_first("received_at"))


def valid(value: Column) -> Column:
    """The value, or null where it is null, NaN or negative."""
    return F.when(~F.isnan(value) & (value >= 0), value)


def recent(metrics: DataFrame, count: int) -> DataFrame:
    """The latest ``count`` rows by ts, then query_id: a top-k, not a sort of everything in one task."""
    return metrics.orderBy(F.desc("ts"), F.desc("query_id")).limit(count)


def exact_percentiles(df: DataFrame, value: Column, names: Sequence[tuple[str, float]], *by: str) -> DataFrame:
    """Percentiles with linear interpolation, by group."""
    columns = [F.round(F.percentile(value, q), 6).alias(name) for name, q in names]
    return df.groupBy(*by).agg(*columns)


def trailing_mean(df: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], rows: int | None) -> Column:
    """Mean of this and the ``rows`` - 1 rows before it (all of them where ``rows`` is None) within the group."""
    start = Window.unboundedPreceding if rows is None else -(rows - 1)
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(start, 0))


def running(df: DataFrame, values: dict[str, Column], by: Sequence[str], part: Column, order: Sequence[str]) -> DataFrame:
    """``df`` with the sums, by name, of ``values`` over the rows of the group up to each row, in order of ``part`` and ``order``.

    ``part`` divides a group in the order of its rows (an hour of a day, say): sums of the parts before are added to a
    window within the part, so that no task holds a whole hot group. Null values count as 0.
    """
    keys, held = [f"__k{k}" for k in range(len(by))], {name: f"__v{k}" for k, name in enumerate(values)}
    rows = df.withColumns({held[name]: F.coalesce(value, F.lit(0)) for name, value in values.items()} | {"__p": part})
    within = Window.partitionBy(*by, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col("__p").alias("__q")).agg(*(F.sum(v).alias(v) for v in held.values()))
    before = Window.partitionBy(*keys).orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "__q", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}b") for v in held.values()))
    match = F.col("__p").eqNullSafe(F.col("__q"))
    for c, k in zip(by, keys):
        match = match & F.col(c).eqNullSafe(F.col(k))
    summed = rows.withColumns({f"{v}s": F.sum(v).over(within) for v in held.values()}).join(parts, match)
    return summed.withColumns({name: F.col(f"{v}s") + F.col(f"{v}b") for name, v in held.items()}).select(*df.columns, *values)


def running_mean(df: DataFrame, value: Column, by: str, order: Sequence[str], name: str, day: str = "day") -> DataFrame:
    """``df`` with the mean of all rows of the group up to each row, in order of ``day`` and ``order``; see running."""
    held = running(df.withColumn("__value", value), {"__sum": F.col("__value"), "__count": F.when(F.col("__value").isNotNull(), 1)}, [by], F.col(day), order)
    return held.withColumn(name, F.when(F.col("__count") > 0, F.col("__sum") / F.col("__count"))).select(*df.columns, name)
