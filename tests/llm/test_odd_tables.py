"""Every operator on empty tables, null columns, repeated rows and extra columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retrix.llm import codedocs, defects, digest, nearest, packing, residue, secrets, similar, split, tokens

LONG = "palavra comum e outra " * 20_000
EXTRA = ("rid", "body", "item", "ids", "value", "entry", "packed", "grp", "day", "c1", "path", "other", "data", "row", "size")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumns({name: F.lit("x") for name in EXTRA})


TEXTS = [(1, None), (2, ""), (3, "   \n"), (4, "um texto curto aqui."), (4, "um texto curto aqui."), (5, LONG), (None, "sem id"), (6, "um texto curto aqui.")]


def operators(df, numbers):
    """All operators over texts ``df`` (key, text) and vectors ``numbers`` (key, vector, number, time)."""
    return {
        "similar": lambda: similar.similar_pairs(df, "key", "text"),
        "links": lambda: similar.similar_links(df, "key", "text"),
        "docs": lambda: codedocs.documented_functions(df, "key", "text", "source"),
        "split": lambda: split.split_oversized(df.withColumn("limit", F.lit(100)).withColumn("share", F.lit(10)), "key", "text", "limit", "share"),
        "nearest": lambda: nearest.top_similar(numbers, "key", "vector", k=2, dimension=3),
        "defects": lambda: defects.find_defects(df, "key", "text", "answer"),
        "secrets": lambda: secrets.scan(df, "key", "text", "t", with_text=True),
        "digest": lambda: digest.percentiles(numbers, "key", "model", "at", ["number"]),
        "tokens": lambda: tokens.encode_corpus(df, "key", "text"),
        "packing": lambda: packing.fill_containers(df, "key", "text"),
        "residue": lambda: residue.find_residue(df, "key", "text", "source"),
    }


def frames(spark, texts, numbers):
    df = table(spark, texts, "key long, text string").withColumn("source", F.lit(None).cast("string")).withColumn("answer", F.lit(None).cast("string"))
    return df, table(spark, numbers, "key long, vector array<float>, number double, model string, at timestamp")


@pytest.mark.parametrize("name", list(operators(None, None)))
def test_empty_table(spark, name):
    assert operators(*frames(spark, [], []))[name]().collect() == []


@pytest.mark.parametrize("name", list(operators(None, None)))
def test_odd_rows(spark, name):
    numbers = [(1, None, None, None, None), (2, [], float("nan"), "", None), (3, [0.0, 0.0, 0.0], -1.0, "M", None), (4, [1.0, None, 0.0], 2.0, "m", None), (5, [1.0, 0.0, 0.0], 3.0, "m", None), (5, [1.0, 0.0, 0.0], 3.0, "m", None), (None, [1.0, 0.0, 0.0], 1.0, "m", None), (6, [float("nan"), 0.0, 0.0], 1.0, "m", None), (7, [1.0, 0.0, 0.0], 4.0, "m", None)]
    rows = operators(*frames(spark, TEXTS, numbers))[name]().collect()
    if name == "similar":
        assert {(r["id_a"], r["id_b"]) for r in rows} == {(4, 6)}
    if name == "links":
        assert {(r["id"], r["class_id"], r["n_links"]) for r in rows} == {(4, 4, 1), (6, 4, 1), (5, 5, 0)}
    if name == "tokens":
        assert len(rows) == len(TEXTS) and all(r["ids"] == [] for r in rows if r["key"] in (1, 2))
    if name == "nearest":
        assert {(r["id"], r["other"]) for r in rows} == {(5, 7), (7, 5)}
    if name == "defects":
        assert {(r["id"], r["defect_type"]) for r in rows} == {(k, "empty_answer") for k in range(1, 7)}
    if name == "split":
        assert {r["key"] for r in rows} == {5}
    if name == "digest":
        assert {(r["grp"], r["n"], r["estimate"]) for r in rows if r["quantile"] == 0.5} == {("m", 4, 2.0)}
    if name == "packing":
        assert {r["key"] for r in rows} == {3, 4, 5, 6, None} and max(r["used"] for r in rows) <= 2048
    if name in ("docs", "secrets", "residue"):
        assert rows == []
