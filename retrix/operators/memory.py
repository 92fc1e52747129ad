"""Tiered memory: ranking, tiers by idle time, eviction. Time is always given, never read from a clock."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the tiers.
TIER_WEIGHT = {"hot": 3.0, "warm": 2.0, "cold": 1.0}


def age_hours(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(at)) / 3_600_000_000


def tier(idle: Column, hours: float = 24.0) -> Column:
    """hot until ``hours`` idle, warm until twice that, then cold; an unknown time counts as cold."""
    return F.when(idle <= hours, "hot").when(idle <= 2 * hours, "warm").otherwise("cold")


def rank_score(similarity: Column, importance: Column, idle: Column, accesses: Column) -> Column:
    return 0.6 * similarity + 0.2 * importance + 0.1 / (1 + idle / 24) + 0.1 * F.least(accesses / 10, F.lit(1.0))


def keep_score(importance: Column, level: Column, accesses: Column, age: Column) -> Column:
    """What a segment is worth keeping: importance and tier, more for frequent use, less with age."""
    weight = F.create_map(*(x for k, v in TIER_WEIGHT.items() for x in (F.lit(k), F.lit(v))))[level]
    return importance * weight * (1 + accesses / F.greatest(age, F.lit(1.0))) / (1 + age)


def evict(segments: DataFrame, score: str, tokens: str, needed: int, tie: str) -> DataFrame:
    """The segments of least worth whose removal frees ``needed`` tokens.

    Each has a token at least, so no more than ``needed`` of them can go: only these are put in order.
    """
    least = segments.where(F.col(tokens) > 0).orderBy(score, tie).limit(needed)
    before = F.sum(tokens).over(Window.partitionBy(F.lit(1)).orderBy(score, tie).rowsBetween(Window.unboundedPreceding, -1))
    return least.withColumn("freed_before", F.coalesce(before, F.lit(0))).where(F.col("freed_before") < needed)


def budget_fold(hits: Column, limit: int, most: int) -> Column:
    """Ids of hits (in order: ``id``, ``tokens``) taken while they fit: one that doesn't fit is passed over."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("ids"))

    def step(state: Column, x: Column) -> Column:
        fits = (state["total"] + x["tokens"] <= limit) & (F.size(state["ids"]) < most)
        return F.struct(
            F.when(fits, state["total"] + x["tokens"]).otherwise(state["total"]).cast("long").alias("total"),
            F.when(fits, F.concat(state["ids"], F.array(x["id"].cast("long")))).otherwise(state["ids"]).alias("ids"),
        )

    return F.aggregate(hits, start, step)["ids"]


#: Level of compression, characters from which it is tried, and share of the size that it must get below.
LEVEL, LONG, GAIN = 6, 10_000, 0.8


def compressed(text: Column) -> Column:
    """``compressed``, ``packed`` (null where it isn't), ``ratio`` and ``plain`` (null where it is) of long texts that
    become smaller than GAIN of their size; the others stay as they are, with a ratio of 1."""

    @F.pandas_udf("compressed boolean, packed binary, ratio double, plain string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            packed = zlib.compress(raw, LEVEL) if len(text or "") > LONG else None
            worth = packed is not None and len(packed) < GAIN * len(raw)
            rows.append((worth, packed if worth else None, len(raw) / len(packed) if worth else 1.0, None if worth else text))
        return pd.DataFrame(rows, columns=["compressed", "packed", "ratio", "plain"])

    return run(text)


def restored(held: Column) -> Column:
    """The text of a ``compressed`` struct."""

    @F.pandas_udf("string")
    def run(packed: pd.Series) -> pd.Series:
        return packed.map(lambda x: None if x is None else zlib.decompress(x).decode("utf-8", "surrogatepass"))

    return F.coalesce(run(held["packed"]), held["plain"])
