"""Lexical search: BM25 statistics, weights and ranking, as joins of postings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrix.functions import text as X
from retrix.operators.search import ranked, sendable, top_sums
from retrix.sources.tables import cut

K1, B, EPSILON = 1.2, 0.75, 0.25
#: Texts of a term that one task takes.
TERM_LIMIT = 200_000
#: Ids of several rows that are looked for by name; texts whose terms are counted at once.
REPEATED, COUNTED = 1000, 1024


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and words of rows as ids and terms with ``tf`` and ``dl``."""
    for batch in batches:
        for low in range(0, batch.num_rows, COUNTED):
            part = batch.slice(low, COUNTED)
            length = pa.compute.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
            words = part.column(1).flatten().dictionary_encode()
            size = max(len(words.dictionary), 1)
            place, tf = np.unique(np.repeat(np.arange(len(length)), length) * size + words.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(place, size)
            held = pa.StructArray.from_arrays([words.dictionary.take(pa.array(term)), pa.array(tf, pa.int64()), pa.array(length[row], pa.int32())], names=["term", "tf", "dl"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(length) + 1)), pa.int32()), held)], names=["doc_id", "held"])


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text: ``doc_id`` and its terms, each with ``term``, ``tf`` and ``dl``, the text's length in terms. Null
    texts and those without terms have none. Terms are counted where the texts lie; only texts of several rows (all, if
    more than REPEATED ids have several) are shuffled, so that their rows meet."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    several = [r["doc_id"] for r in rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").limit(REPEATED + 1).collect()]
    meets = F.lit(len(several) > REPEATED) | F.coalesce(F.col("doc_id").isin([x for x in several if x is not None]), F.lit(None in several))
    words = lambda some: some.select("doc_id", X.tokens(F.col("text")).alias("ts")).where(F.size("ts") > 0)
    met = words(rows.where(meets)).repartition("doc_id").select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    met = met.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")).groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf", "dl")).alias("held"))
    alone = words(rows.where(~meets)).mapInArrow(_counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held array<struct<term:string,tf:bigint,dl:int>>")
    return met if len(several) > REPEATED else alone.unionByName(met) if several else alone


@dataclass(frozen=True)
class Lexicon:
    """A fitted corpus: its texts with their terms, the idf of its terms, its number of texts and their mean length in terms."""

    texts: DataFrame
    terms: DataFrame
    n: int
    avgdl: float

    @property
    def posted(self) -> DataFrame:
        """One row per text and term."""
        return self.texts.select("doc_id", F.inline("held"))


def fit(docs: DataFrame, id_col: str, text_col: str) -> Lexicon:
    """Postings and idf = max(0.25, ln((n - df + 0.5) / (df + 0.5))) of all texts that are not null.

    The texts are read into terms once; what follows reads the written postings.
    """
    texts = cut(postings(docs, id_col, text_col))
    n = docs.where(F.col(text_col).isNotNull()).count()
    posted = texts.select(F.inline("held"))
    total = posted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("t")).first()["t"]  # one row
    counted = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    value = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Lexicon(texts, cut(counted.withColumn("idf", F.greatest(F.lit(EPSILON), value))), n, total / n if n else 0.0)


def _weight(lexicon: Lexicon):
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(lexicon.avgdl or 1.0))
    return F.col("idf") * F.col("tf") * (K1 + 1) / norm


def share(lexicon: Lexicon):
    """BM25 weight of what a text holds of a term, but for the term's idf."""
    return lambda p: p["tf"] * (K1 + 1) / (p["tf"] + K1 * (1 - B + B * p["dl"] / F.lit(lexicon.avgdl or 1.0)))


def weights(lexicon: Lexicon) -> DataFrame:
    """BM25 weight of each posting: ``doc_id``, ``term``, ``weight``."""
    return lexicon.posted.join(lexicon.terms.select("term", "idf"), "term").select("doc_id", "term", _weight(lexicon).alias("weight"))


def asked_terms(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """Terms of the queries with the times they have them."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(X.tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def search(lexicon: Lexicon, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
    """The k best texts of each query: ``query_id``, ``doc_id``, ``score``, ``rank``. A term counts as often as the
    query has it; terms that no text has count nothing."""
    asked = cut(asked_terms(queries, query_id, query_text).join(lexicon.terms, "term"))
    if sendable(asked):
        held = lexicon.texts.select("doc_id", F.col("held.term").alias("terms"), F.transform("held", share(lexicon)).alias("values"))
        return top_sums(held, asked.select("query_id", "term", (F.col("qf") * F.col("idf")).alias("weight")), k)
    # a term of many texts is spread over as many tasks as it needs; all others have one
    spread = F.ceil(F.col("df") / F.lit(TERM_LIMIT)).cast("int")
    salted = asked.select("query_id", "term", "qf", "idf", spread.alias("parts"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("part"))
    parts = asked.select("term", spread.alias("parts")).distinct()
    wanted = lexicon.posted.join(parts, "term").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))  # only postings of terms that are asked for
    scored = salted.drop("parts").join(wanted.drop("parts"), ["term", "part"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qf") * _weight(lexicon)), 9).alias("score"))
    return ranked(scored, ["query_id"], "score", "doc_id", k)


def with_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Terms and pairs of neighbouring terms of every text: ``doc_id``, ``term``, ``tf``."""
    t = X.tokens(F.col(text_col))
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(1))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("doc_id"), t.alias("t")).select("doc_id", F.explode(F.concat("t", pairs)).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def key_terms(docs: DataFrame, id_col: str, text_col: str, top: int = 20, min_df: int = 2, max_share: float = 0.95) -> DataFrame:
    """The ``top`` terms and pairs of each text by TF-IDF, with idf = ln((1 + n) / (1 + df)) + 1; terms of fewer than
    ``min_df`` texts or of more than ``max_share`` of them don't count."""
    posted = cut(with_pairs(docs, id_col, text_col))
    n = docs.where(F.col(text_col).isNotNull()).count()
    counted = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_share * n))
    scored = posted.join(counted, "term").select("doc_id", "term", F.round(F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1), 9).alias("score"))
    return ranked(scored, ["doc_id"], "score", "term", top)


def boosted(weighted: DataFrame, keys: DataFrame, factor: float = 1.5) -> DataFrame:
    """BM25 weights, raised where the term is among its text's key terms."""
    marked = keys.select("doc_id", "term", F.lit(factor).alias("f"))
    return weighted.join(marked, ["doc_id", "term"], "left").select("doc_id", "term", (F.col("weight") * F.coalesce("f", F.lit(1.0))).alias("weight"))
