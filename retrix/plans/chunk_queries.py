"""Queries that cut documents into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrix.operators import chunking as C
from retrix.operators import codestructure
from retrix.plans.registry import query
from retrix.sources.tables import table

_WINDOWS = """SELECT doc_id AS id, (start // {stride})::INT AS pos, start::INT AS start, sha256(substr(text, start + 1, {window})) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, length(text), {stride})) AS start FROM documents WHERE length(text) > 0)"""
_WORDS = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, ws, unnest(range(0, len(ws), {step})) AS start FROM w WHERE len(ws) > 0)
    SELECT doc_id AS id, (start // {step})::INT AS pos, len(list_slice(ws, start + 1, start + {size}))::INT AS n_words, sha256(array_to_string(list_slice(ws, start + 1, start + {size}), ' ')) AS chunk FROM s"""


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("chunk", F.sha2("chunk", 256))


@query(_WINDOWS.format(stride=200, window=400))
def chunk_sliding(spark: SparkSession, directory: str) -> DataFrame:
    """Windows of 400 characters, one every 200."""
    return _hashed(C.char_windows(_documents(spark, directory), "doc_id", "text"))


@query(_WINDOWS.format(stride=450, window=500))
def chunk_chars(spark: SparkSession, directory: str) -> DataFrame:
    """Windows of 500 characters that share 50."""
    return _hashed(C.char_windows(_documents(spark, directory), "doc_id", "text", 500, 450))


@query(_WORDS.format(step=200, size=200))
def chunk_words200(spark: SparkSession, directory: str) -> DataFrame:
    """Windows of 200 words."""
    return _hashed(C.word_windows(_documents(spark, directory), "doc_id", "text", 200))


@query(_WORDS.format(step=400, size=500))
def chunk_words500(spark: SparkSession, directory: str) -> DataFrame:
    """Windows of 500 words that share 100."""
    return _hashed(C.word_windows(_documents(spark, directory), "doc_id", "text", 500, 100))


@query(_WORDS.format(step=1000, size=1000))
def memory_segments(spark: SparkSession, directory: str) -> DataFrame:
    """Segments of 1000 words for the memory."""
    return _hashed(C.word_windows(_documents(spark, directory), "doc_id", "text", 1000))


@query(
    """
    WITH c AS (SELECT doc_id AS id, (start // 500)::INT AS pos, substr(text, start + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS start FROM documents WHERE length(text) > 0)),
    l AS (SELECT *, lag(chunk) OVER (PARTITION BY id ORDER BY pos) AS b FROM c)
    SELECT id, pos, sha256(CASE WHEN b IS NULL THEN chunk ELSE right(b, 50) || chunk END) AS chunk FROM l
    """
)
def chunk_overlap_lag(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks with the end of the one before in front."""
    return _hashed(C.with_overlap(C.char_windows(_documents(spark, directory), "doc_id", "text", 500, 500), 50).drop("start"))


def _by_strategy(strategy: str):
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return _hashed(C.chunk(_documents(spark, directory), "doc_id", "text", strategy))

    run.__name__, run.__doc__ = f"chunk_{strategy}", f"Chunks by the strategy {strategy}."
    return run


#: Greedy packing of pieces (``ps``) by their lengths: the number of each piece's chunk, by a fold.
_PACKED = """WITH d AS (SELECT doc_id AS id, {pieces} AS ps FROM documents WHERE text IS NOT NULL),
    g AS (SELECT id, ps, list_reduce(list_transform(ps, lambda p: {{'g': [0], 'used': length(p)}}), lambda a, b: {{'g': list_append(a.g, CASE WHEN a.used + b.used > {size} THEN a.g[-1] + 1 ELSE a.g[-1] END), 'used': CASE WHEN a.used + b.used > {size} THEN b.used ELSE a.used + b.used END}}).g AS gs FROM d),
    u AS (SELECT id, unnest(gs) AS pos, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM g), c AS (SELECT id, pos, string_agg(p, {joint} ORDER BY n) AS chunk FROM u GROUP BY ALL)"""
_LINES = _PACKED.format(pieces="string_split(text, chr(10))", size=500, joint="chr(10)") + r" SELECT id, pos::INT AS pos, sha256(chunk) AS chunk FROM c WHERE regexp_matches(chunk, '[^\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')"

_BLANK = _LINES[_LINES.index(" WHERE regexp_matches") :]
_STRUCTURAL = _PACKED.format(pieces=r"regexp_split_to_array(text, '\n{{2,}}')".replace("{{", "{").replace("}}", "}"), size=1000, joint="chr(10) || chr(10)") + ", k AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, chunk FROM c WHERE chunk <> '') SELECT id, pos::INT AS pos, sha256(chunk) AS chunk FROM k" + _BLANK

for _strategy, _sql in (("recursive", None), ("structural", _STRUCTURAL), ("semantic", None), ("semantic_enhanced", None), ("lines", _LINES), ("entity_aware", None), ("sentence_packs", None)):
    query(_sql)(_by_strategy(_strategy))


@query()
def chunk_hybrid(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks by the strategy hybrid, with the entities of their document."""
    found = C.chunk(_documents(spark, directory), "doc_id", "text", "hybrid", entities=True)
    return _hashed(found).withColumn("entities", F.array_join("entities", "|"))


@query("SELECT language, CASE language WHEN 'python' THEN 500 WHEN 'javascript' THEN 450 WHEN 'typescript' THEN 450 WHEN 'java' THEN 600 WHEN 'csharp' THEN 600 ELSE 500 END AS size, count(*) AS n FROM chunks GROUP BY ALL")
def chunk_sizes(spark: SparkSession, directory: str) -> DataFrame:
    """Chunk size that suits a language."""
    return table(spark, directory, "chunks").groupBy("language").agg(F.count(F.lit(1)).alias("n")).withColumn("size", C.optimal_size(F.col("language")))


@query()
def code_symbols_found(spark: SparkSession, directory: str) -> DataFrame:
    """Functions, classes and imports of the source files."""
    return codestructure.symbols(table(spark, directory, "ingest_items"), "item_id", "content", "source")


@query()
def code_relations_found(spark: SparkSession, directory: str) -> DataFrame:
    """Edges of the source files: what they import, contain, extend and call."""
    return codestructure.relations(table(spark, directory, "ingest_items"), "item_id", "content", "source")


@query()
def chunk_code(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks of the source files along their definitions, with the context they need."""
    found = codestructure.chunks(table(spark, directory, "ingest_items"), "item_id", "content", "source")
    return _hashed(found).withColumn("context", F.sha2("context", 256))


@query()
def chunk_symbols(spark: SparkSession, directory: str) -> DataFrame:
    """A description of every function, method and class."""
    return _hashed(codestructure.described(table(spark, directory, "ingest_items"), "item_id", "content", "source"))


@query(
    r"""
    WITH l AS (SELECT item_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM (SELECT item_id, min(content) AS content FROM ingest_items GROUP BY item_id) WHERE content IS NOT NULL)
    SELECT item_id, count(*) AS lines, count(*) FILTER (length(line) > 120) AS long_lines, min(n) FILTER (length(line) > 120) AS first_long FROM l GROUP BY item_id
    """
)
def code_long_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of more than 120 characters."""
    items = table(spark, directory, "ingest_items").groupBy("item_id").agg(F.min("content").alias("content"))
    lines = items.where("content IS NOT NULL").select("item_id", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    return lines.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.length("line") > 120).alias("long_lines"), F.min(F.when(F.length("line") > 120, F.col("n") + 1)).alias("first_long")
    )


@query("SELECT item_id, min(CASE lower(regexp_extract(source, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' ELSE 'unknown' END) AS language FROM ingest_items GROUP BY item_id")
def language_detect(spark: SparkSession, directory: str) -> DataFrame:
    """Language of a file by its ending."""
    items = table(spark, directory, "ingest_items")
    return items.groupBy("item_id").agg(F.min(codestructure.language_by_ending(F.col("source"))).alias("language"))
