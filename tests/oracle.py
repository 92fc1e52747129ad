"""Comparison of a query's rows with those of its SQL, whatever their order."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter


def plain(value):
    """A value as it is compared: floats to nine digits."""
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def connection(directory: str):
    import duckdb

    own = duckdb.connect()
    for name in os.listdir(directory):
        path = os.path.join(directory, name)
        own.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return own


def compare(frame, own, sql: str) -> None:
    columns = sorted(frame.columns)
    result = own.sql(sql)
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    expected = Counter(repr(tuple(plain(row[p]) for p in places)) for row in result.fetchall())
    found = Counter(repr(tuple(plain(row[c]) for c in columns)) for row in frame.collect())
    assert found == expected, (list((found - expected).items())[:3], list((expected - found).items())[:3])
