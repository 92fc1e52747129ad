"""The queries of this subpackage: name -> function of (spark, directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrix.llm import codedocs, defects, digest, nearest, packing, residue, secrets, similar, split, tokens
from retrix.sources.tables import table


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of chunks whose multisets of words are similar to 0.8 or more."""
    return similar.similar_pairs(table(spark, directory, "chunks"), "id", "content")


def p1_links(spark: SparkSession, directory: str) -> DataFrame:
    """Every chunk with words: its class of equal multisets and its number of similar chunks."""
    return similar.similar_links(table(spark, directory, "chunks"), "id", "content")


def _documented(spark: SparkSession, directory: str) -> DataFrame:
    items = table(spark, directory, "ingest_items").withColumn("named", F.col("metadata")["language"])
    return codedocs.documented_functions(items, "item_id", "content", "source", "named")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Places of functions and methods with real documentation."""
    return _documented(spark, directory).select("item_id", "line_no").distinct()


def p2_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """The pairs themselves: signature, docstring and type of every function with real documentation."""
    return _documented(spark, directory)


def _sized_items(spark: SparkSession, directory: str) -> DataFrame:
    """Items with the sizes of their request; a request delivered again counts once."""
    requests = table(spark, directory, "ingest_requests").where("request_id is not null").groupBy("request_id")
    requests = requests.agg(F.min(F.struct("received_at", "chunk_size", "chunk_overlap")).alias("r")).select("request_id", "r.chunk_size", "r.chunk_overlap")
    return table(spark, directory, "ingest_items").select("item_id", "request_id", "content").join(requests, "request_id", "left")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Items that had to be cut: those with a second piece."""
    pieces = split.split_oversized(_sized_items(spark, directory), "item_id", "content", "chunk_size", "chunk_overlap", with_text=False)
    return pieces.where("piece_no = 2").select("item_id").distinct()


def p3_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of every oversized item, in order; a repeated row gives its pieces once."""
    items = _sized_items(spark, directory).groupBy("item_id").agg(F.min(F.struct("content", "chunk_size", "chunk_overlap")).alias("r")).select("item_id", "r.*")
    return split.split_oversized(items, "item_id", "content", "chunk_size", "chunk_overlap")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of entries of which one is among the five most similar of the other."""
    return nearest.similar_pairs(table(spark, directory, "semantic_cache"), "id", "query_embedding")


def p4_top(spark: SparkSession, directory: str) -> DataFrame:
    """The five most similar entries, with their cosines, of every entry whose id is divisible by 100."""
    return nearest.top_similar(table(spark, directory, "semantic_cache"), "id", "query_embedding", asking=F.col("id") % 100 == 0)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Cache entries whose answer doesn't serve the query, with the type of defect."""
    return defects.find_defects(table(spark, directory, "semantic_cache"), "id", "query_text", "response_data")


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of items and chunks where a literal credential begins."""
    items = secrets.scan(table(spark, directory, "ingest_items"), "item_id", "content", "ingest_items")
    chunks = secrets.scan(table(spark, directory, "chunks"), "id", "content", "chunks")
    return items.union(chunks).select("tbl", "rec_id", F.explode("lines").alias("line_no")).distinct()


def p6_masked(spark: SparkSession, directory: str) -> DataFrame:
    """The texts that hold credentials, with only these masked; a record with several texts gives each of them."""
    items = secrets.scan(table(spark, directory, "ingest_items"), "item_id", "content", "ingest_items", with_text=True)
    chunks = secrets.scan(table(spark, directory, "chunks"), "id", "content", "chunks", with_text=True)
    return items.union(chunks).select("tbl", "rec_id", "lines", "masked").distinct()


_METRICS = ("total_latency", "estimated_cost")


def _percentiles(spark: SparkSession, directory: str) -> DataFrame:
    return digest.percentiles(table(spark, directory, "query_metrics"), "query_id", "model_used", "ts", _METRICS)


def p7_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    """Median, 90th, 95th and 99th percentile per model and day, and per model, with certified rank errors."""
    return _percentiles(spark, directory).withColumnRenamed("grp", "model_used")


def p7_certified(spark: SparkSession, directory: str) -> DataFrame:
    """Whether each percentile of the whole period keeps the promised bound."""
    whole = _percentiles(spark, directory).where("day is null")
    return whole.select(F.col("grp").alias("model_used"), "metric", "quantile", "n", "within_bound")


def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(table(spark, directory, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, directory: str) -> DataFrame:
    return packing.fill_containers(table(spark, directory, "documents"), "doc_id", "text")


def p9_packed(spark: SparkSession, directory: str) -> DataFrame:
    """Every document with a text in containers of 2,048 tokens of byte_bpe_50k."""
    return _packed(spark, directory)


def p9_assigned(spark: SparkSession, directory: str) -> DataFrame:
    """The documents that are assigned, and whether all their containers keep the capacity."""
    return _packed(spark, directory).groupBy("doc_id").agg((F.max("used") <= packing.CAPACITY).alias("fits"))


def p9_usage(spark: SparkSession, directory: str) -> DataFrame:
    """Containers, and the tokens they hold, over all documents."""
    by_container = _packed(spark, directory).groupBy("container").agg(F.sum("n_tokens").alias("tokens"))
    return by_container.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.count(F.lit(1)) / packing.CAPACITY).alias("filled"))


def _residue(spark: SparkSession, directory: str) -> DataFrame:
    return residue.find_residue(table(spark, directory, "documents"), "doc_id", "text", "file_path")


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that hold residue in place of content."""
    return _residue(spark, directory).select("doc_id").distinct()


def p10_kept(spark: SparkSession, directory: str) -> DataFrame:
    """The documents that remain."""
    documents = table(spark, directory, "documents").select("doc_id", "lang", "source")
    return documents.join(_residue(spark, directory).select("doc_id").distinct(), "doc_id", "left_anti")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_links": p1_links,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_top": p4_top,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_masked": p6_masked,
    "p7_percentiles": p7_percentiles,
    "p7_certified": p7_certified,
    "p8_ids": p8_ids,
    "p9_packed": p9_packed,
    "p9_assigned": p9_assigned,
    "p9_usage": p9_usage,
    "p10_found": p10_found,
    "p10_kept": p10_kept,
}
