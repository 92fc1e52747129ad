"""Bounded samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

_STEPS = 1 << 24
#: Rows beyond the wanted ones that the first cut lets through, so that it rarely leaves too few.
_SPARE = 1.3


def least_by_hash(df: DataFrame, key: Column, count: int, total: int, distinct: bool = False) -> list[Row]:
    """The ``count`` rows (``distinct``: different rows) with the least hash of ``key``, of ``total``: the same rows in every run.

    Only about 1.3 times as many rows as wanted get as far as the sort, so no more are sent to the driver,
    however many partitions there are.
    """
    share = min(1.0, (_SPARE * count + 200) / max(total, 1))
    place = F.xxhash64(key)
    near = df.where(F.shiftright(place, 40).bitwiseAND(F.lit(_STEPS - 1)) < F.lit(int(share * _STEPS)))
    near = near.distinct() if distinct else near
    return near.orderBy(F.shiftright(place, 40).bitwiseAND(F.lit(_STEPS - 1)), place).limit(count).collect()
