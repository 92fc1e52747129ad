"""Writes expressed as new versions of tables: upsert, partial update, delete, referential checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not among them. Keys of ``new`` must be unique."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_only(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old``, and those of ``new`` whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def update_fields(old: DataFrame, changes: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``old`` with the fields that a change gives (null: unchanged)."""
    given = changes.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields))
    joined = old.join(given, list(keys), "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else c for c in old.columns))


def delete(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among those of ``gone``."""
    return df.join(gone, list(keys), "left_anti")


def known(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is a parent's."""
    return df.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is no parent's; a null key is no parent's."""
    return df.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def delete_cascade(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, gone: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parents and children after deleting the parents in ``gone`` (column ``parent_key``): without ``force`` only
    those without children go, with it their children go too."""
    if not force:
        gone = gone.join(children.select(F.col(child_key).alias(parent_key)).distinct(), parent_key, "left_anti")
    return delete(parents, gone, [parent_key]), children.join(gone.withColumnRenamed(parent_key, child_key), child_key, "left_anti")
