"""Queries over source files and their symbol index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrix.plans.registry import query
from retrix.sources.tables import table

_ITEMS = "WITH i AS (SELECT item_id, min(content) AS content, min(source) AS source FROM ingest_items GROUP BY item_id)"
_SYMBOLS = "WITH s AS (SELECT DISTINCT * FROM code_symbols)"


def _items(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "ingest_items").groupBy("item_id").agg(F.min("content").alias("content"), F.min("source").alias("source"))


def _symbols(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "code_symbols").distinct()


@query(
    _SYMBOLS
    + " SELECT item_id, count(*) AS symbols, count(*) FILTER (type IN ('function', 'method')) AS callables, count(*) FILTER (type = 'class') AS classes, sum(complexity)::BIGINT AS complexity, round(avg(complexity), 6) AS mean_complexity, max(greatest(end_line, line_no)) AS lines FROM s GROUP BY item_id"
)
def code_complexity(spark: SparkSession, directory: str) -> DataFrame:
    """Size and complexity of every indexed file."""
    return _symbols(spark, directory).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("type").isin("function", "method")).alias("callables"), F.count_if(F.col("type") == "class").alias("classes"),
        F.sum("complexity").alias("complexity"), F.round(F.avg("complexity"), 6).alias("mean_complexity"), F.max(F.greatest("end_line", "line_no")).alias("lines"),
    )


_MODULE = (
    r"coalesce(nullif(regexp_extract(signature, '^from\s+([\w.]+)\s+import', 1), ''), nullif(regexp_extract(signature, '^import\s+([\w.]+)', 1), ''), "
    r"nullif(regexp_extract(signature, '(?:from|require\()\s*[''\"]([^''\"]+)[''\"]', 1), ''), nullif(regexp_extract(signature, '^using\s+([\w.]+);', 1), ''))"
)


@query(_SYMBOLS + f" SELECT module, count(*) AS files FROM (SELECT DISTINCT item_id, {_MODULE} AS module FROM s WHERE type = 'import') WHERE module IS NOT NULL GROUP BY module")
def import_modules(spark: SparkSession, directory: str) -> DataFrame:
    """Modules that are imported, by the forms of four languages."""
    take = lambda pattern: F.nullif(F.regexp_extract("signature", pattern, 1), F.lit(""))
    module = F.coalesce(take(r"^from\s+([\w.]+)\s+import"), take(r"^import\s+([\w.]+)"), take(r"(?:from|require\()\s*['\"]([^'\"]+)['\"]"), take(r"^using\s+([\w.]+);"))
    rows = _symbols(spark, directory).where("type = 'import'").select("item_id", module.alias("module")).distinct().where("module IS NOT NULL")
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("files"))


_FLAGS = (("asynchronous", "async "), ("arrows", "=>"), ("formatted", 'f"'), ("decorated", "@"), ("typed", "->"))


@query(_ITEMS + " SELECT item_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(content, '{t}') THEN '{n}' END" for n, t in _FLAGS) + "], lambda x: x IS NOT NULL), ',') AS flags FROM i WHERE content IS NOT NULL AND regexp_matches(source, '\\.(py|js|ts|java|cs)$')")
def code_flags(spark: SparkSession, directory: str) -> DataFrame:
    """Features of a language that a source file uses."""
    rows = _items(spark, directory).where("content IS NOT NULL").where(F.col("source").rlike(r"\.(py|js|ts|java|cs)$"))
    found = F.array_compact(F.array(*(F.when(F.col("content").contains(t), n) for n, t in _FLAGS)))
    return rows.select("item_id", F.array_join(found, ",").alias("flags"))


@query(
    _ITEMS
    + r""", l AS (SELECT item_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM i WHERE content IS NOT NULL AND source LIKE '%.py'),
    c AS (SELECT *, last_value(nullif(regexp_extract(line, '^class\s+(\w+)', 1), '') IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS parent FROM l)
    SELECT item_id, n::INT AS n, parent FROM c WHERE regexp_matches(line, '^\s+(async\s+)?def\s') AND parent IS NOT NULL"""
)
def code_parent_class(spark: SparkSession, directory: str) -> DataFrame:
    """The class above every indented definition."""
    rows = _items(spark, directory).where("content IS NOT NULL AND source LIKE '%.py'").select("item_id", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    window = Window.partitionBy("item_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    name = F.nullif(F.regexp_extract("line", r"^class\s+(\w+)", 1), F.lit(""))
    marked = rows.withColumn("parent", F.last(name, ignorenulls=True).over(window))
    return marked.where(F.col("line").rlike(r"^\s+(async\s+)?def\s") & F.col("parent").isNotNull()).select("item_id", (F.col("i") + 1).alias("n"), "parent")


@query(
    "WITH i AS (SELECT item_id, min(content) AS content FROM ingest_items GROUP BY item_id), s AS (SELECT DISTINCT symbol_id, item_id, line_no FROM code_symbols WHERE type <> 'import')"
    " SELECT symbol_id, sha256(array_to_string(list_slice(string_split(content, chr(10)), greatest(line_no - 3, 1), line_no + 2), chr(10))) AS context FROM s JOIN i USING (item_id) WHERE content IS NOT NULL"
)
def code_context_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines around every indexed symbol (as hash)."""
    rows = _symbols(spark, directory).where("type <> 'import'").select("symbol_id", "item_id", "line_no").distinct().join(_items(spark, directory), "item_id").where("content IS NOT NULL")
    start = F.greatest(F.col("line_no") - 3, F.lit(1))
    lines = F.slice(F.split("content", "\n"), start, F.greatest(F.col("line_no") + 2 - start + 1, F.lit(0)))
    return rows.select("symbol_id", F.sha2(F.array_join(lines, "\n"), 256).alias("context"))


@query(_SYMBOLS + ", d AS (SELECT symbol_id, item_id, name, type, docstring IS NOT NULL AND docstring <> '' AS documented FROM s WHERE type IN ('function', 'method')) SELECT item_id, count(*) AS callables, count(*) FILTER (documented) AS documented FROM d GROUP BY item_id")
def code_documented(spark: SparkSession, directory: str) -> DataFrame:
    """Share of documented functions by the old index."""
    rows = _symbols(spark, directory).where("type IN ('function', 'method')")
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("callables"), F.count_if(F.col("docstring").isNotNull() & (F.col("docstring") != "")).alias("documented"))
