"""Queries over texts: lexical search, hybrid search, cleaning, keywords, context for a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrix.functions import text as X
from retrix.operators import fusion, search, sparse
from retrix.operators.writes import latest
from retrix.plans.registry import query
from retrix.sources.tables import kept, table

TOKENS_SQL = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\pL\pM\pN_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)"
_POSTINGS = (
    "WITH terms AS (SELECT doc_id, unnest("
    + TOKENS_SQL.format("text")
    + ") AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL), "
    + "size AS (SELECT count(*) AS n, avg(len("
    + TOKENS_SQL.format("text")
    + ")) AS avgdl FROM documents WHERE text IS NOT NULL), "
    + "lex AS (SELECT term, count(*) AS df, greatest(0.25, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM p, size GROUP BY term)"
)
_WEIGHTS = _POSTINGS + ", dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id), w AS (SELECT p.doc_id, p.term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM p JOIN dl USING (doc_id) JOIN lex USING (term), size)"
_ASKED = "asked AS (SELECT id AS query_id, any_value(query_text) AS q FROM semantic_cache WHERE id % 100 = 0 GROUP BY id)"
_SPARSE = (
    _WEIGHTS
    + ", "
    + _ASKED
    + ", qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest("
    + TOKENS_SQL.format("q")
    + ") AS term FROM asked) GROUP BY ALL), s AS (SELECT query_id, doc_id, round(sum(qf * weight), 9) AS score FROM qt JOIN w USING (term) GROUP BY ALL), "
    + "sp AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 50)"
)


def asked_queries(spark: SparkSession, directory: str) -> DataFrame:
    """The stated queries: cached questions whose id is divisible by 100."""
    cache = table(spark, directory, "semantic_cache").where("id % 100 = 0")
    return cache.groupBy(F.col("id").alias("query_id")).agg(F.first("query_text").alias("q"))


def every_question(spark: SparkSession, directory: str) -> DataFrame:
    """All cached questions, each id once."""
    return table(spark, directory, "semantic_cache").groupBy(F.col("id").alias("query_id")).agg(F.first("query_text").alias("q"))


@kept
def _index(spark: SparkSession, directory: str) -> sparse.Lexicon:
    """The lexical index of the documents: fitted once a session, and anew if the table has changed."""
    return sparse.fit(table(spark, directory, "documents"), "doc_id", "text")


@query(_POSTINGS + "SELECT term, df, round(idf, 9) AS idf FROM lex")
def bm25_idf(spark: SparkSession, directory: str) -> DataFrame:
    """Document frequency and idf of every term."""
    return _index(spark, directory).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(_POSTINGS + "SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM lex) AS terms FROM size")
def bm25_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Size of the corpus, mean length, vocabulary."""
    lexicon = _index(spark, directory)
    return lexicon.terms.agg(F.lit(lexicon.n).cast("long").alias("n"), F.lit(round(lexicon.avgdl, 6)).alias("avgdl"), F.count(F.lit(1)).alias("terms"))


@query(_WEIGHTS + "SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS weight FROM w GROUP BY doc_id")
def bm25_weights(spark: SparkSession, directory: str) -> DataFrame:
    """BM25 encoding of every text, summed up per text."""
    weighted = sparse.weights(_index(spark, directory))
    return weighted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("weight"))


def _sparse(spark: SparkSession, directory: str, k: int = 50) -> DataFrame:
    return sparse.search(_index(spark, directory), asked_queries(spark, directory), "query_id", "q", k)


@query(_SPARSE + "SELECT query_id, doc_id, score, rank FROM sp")
def bm25_topk(spark: SparkSession, directory: str) -> DataFrame:
    """The 50 best texts of every stated question."""
    return _sparse(spark, directory)


_DENSE = """, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), dn AS (
    SELECT * FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, d.e), 9) DESC, d.vec_id) AS rank
    FROM v q, v d WHERE q.vec_id % 100 = 0) WHERE rank <= 50),
    nd AS (SELECT query_id, count(*) AS nd FROM dn GROUP BY query_id), ns AS (SELECT query_id, count(*) AS ns FROM sp GROUP BY query_id),
    fused AS (
        SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + coalesce(dn.rank, coalesce(nd, 0) + 1)) + 1.0::DOUBLE / (60 + coalesce(sp.rank, coalesce(ns, 0) + 1)), 12) AS score
        FROM dn FULL JOIN sp USING (query_id, doc_id) LEFT JOIN nd USING (query_id) LEFT JOIN ns USING (query_id)
    ), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM fused)"""


def _fused(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "embeddings")
    dense = search.top_cosine(rows, "vec_id", "embedding", rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 50)
    return fusion.reciprocal_rank(dense, _sparse(spark, directory))


@query(_SPARSE + _DENSE + "SELECT query_id, doc_id, score, place FROM placed WHERE place <= 20")
def rrf_fusion(spark: SparkSession, directory: str) -> DataFrame:
    """Dense and lexical hits fused by reciprocal rank. Vectors and texts are aligned by equal ids."""
    return _fused(spark, directory)


@query(_SPARSE + _DENSE + "SELECT query_id, doc_id, score, place, lang, source FROM placed JOIN documents USING (doc_id) WHERE place <= 20")
def hybrid_rrf(spark: SparkSession, directory: str) -> DataFrame:
    """Hybrid search: fused hits with their payload."""
    payload = table(spark, directory, "documents").select("doc_id", "lang", "source")
    return _fused(spark, directory).join(payload, "doc_id").select("query_id", "doc_id", "score", "place", "lang", "source")


@query(
    r"""
    WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\pL\pM\pN_\s]', '', 'g'), '\s+'), lambda w: w <> '')) AS term FROM documents),
    c AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY term)
    SELECT term, n, round(ln((SELECT count(*) FROM documents WHERE text IS NOT NULL)::DOUBLE / (df + 1)), 9) AS idf
    FROM c QUALIFY row_number() OVER (ORDER BY n DESC, term) <= 64
    """
)
def simple_vocabulary(spark: SparkSession, directory: str) -> DataFrame:
    """The 64 most frequent words with their idf."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL")
    total = docs.count()
    terms = docs.select("doc_id", F.explode(X.bare_words(F.col("text"))).alias("term"))
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("df"))
    return counted.orderBy(F.desc("n"), "term").limit(64).select("term", "n", F.round(F.log(F.lit(float(total)) / (F.col("df") + 1)), 9).alias("idf"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+', ' ', 'g'), 'https?://[^\s]+', ' ', 'g'), '[^\pL\pM\pN_\s.,!?;:()-]', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"""


@query(f"SELECT doc_id, sha256({_CLEAN}) AS cleaned, length({_CLEAN}) AS n FROM documents WHERE text IS NOT NULL")
def clean_text(spark: SparkSession, directory: str) -> DataFrame:
    """Texts without addresses, links and special characters (as hash and length)."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL").withColumn("c", X.clean(F.col("text")))
    return docs.select("doc_id", F.sha2("c", 256).alias("cleaned"), F.length("c").alias("n"))


_LEAD = r"array_to_string(list_slice(string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), 1, 3), ' ')"


@query(f"SELECT doc_id, sha256({_LEAD}) AS summary FROM documents WHERE text IS NOT NULL")
def lead_summary(spark: SparkSession, directory: str) -> DataFrame:
    """The first three sentences (as hash)."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.sha2(X.lead(F.col("text")), 256).alias("summary"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENTENCES}) AS n_sentences, len(list_filter({_SENTENCES}, lambda s: length(s) > 10)) AS n_long FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Sentences, and those longer than ten characters."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL").withColumn("s", X.sentences(F.col("text")))
    return docs.select("doc_id", F.size("s").alias("n_sentences"), F.size(F.filter("s", lambda x: F.length(x) > 10)).alias("n_long"))


@query()
def word_prefix_summary(spark: SparkSession, directory: str) -> DataFrame:
    """As many words as fit into 100 characters."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", X.word_prefix(F.col("text")).alias("summary"))


STOP = "para como mais muito pode esta este essa that with from".split()
_KEYWORDS = (
    r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM t WHERE length(w) > 3 AND w NOT IN ("
    + ", ".join(f"'{w}'" for w in STOP)
    + ") GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS place FROM c)"
)


def _keywords(spark: SparkSession, directory: str) -> DataFrame:
    words = table(spark, directory, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    counted = words.where((F.length("w") > 3) & ~F.col("w").isin(*STOP)).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "w"))).where("place <= 5")


@query(_KEYWORDS + "SELECT doc_id, w, n, place FROM k WHERE place <= 5")
def keywords(spark: SparkSession, directory: str) -> DataFrame:
    """The five most frequent longer words of every text."""
    return _keywords(spark, directory)


@query(_KEYWORDS + ", g AS (SELECT doc_id, string_agg(w, ' ' ORDER BY place) AS clue FROM k WHERE place <= 5 GROUP BY doc_id) SELECT clue, count(*) AS texts, min(doc_id) AS first_doc FROM g GROUP BY clue")
def clue_index(spark: SparkSession, directory: str) -> DataFrame:
    """Keyword clues and the texts they lead to."""
    clues = _keywords(spark, directory).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]), " ").alias("clue"))
    return clues.groupBy("clue").agg(F.count(F.lit(1)).alias("texts"), F.min("doc_id").alias("first_doc"))


_ENTITY = r"list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,}(?: [A-Z][a-z]{2,})*'))"


@query(f"SELECT entity, count(*) AS texts FROM (SELECT doc_id, unnest({_ENTITY}) AS entity FROM documents) GROUP BY entity")
def entity_extract(spark: SparkSession, directory: str) -> DataFrame:
    """Runs of capitalised words, and in how many texts they occur."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{2,}(?: [A-Z][a-z]{2,})*"), F.lit(0)))
    return table(spark, directory, "documents").select("doc_id", F.explode(found).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("texts"))


@query()
def entities_found(spark: SparkSession, directory: str) -> DataFrame:
    """Capitalised, quoted and technical terms of every text, and in how many texts they occur."""
    found = X.entities(F.col("text"))
    return table(spark, directory, "documents").select("doc_id", F.explode(found).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("texts"))


_WORDSET = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"


@query(
    f"""
    WITH {_ASKED}, q AS (SELECT query_id, {_WORDSET.format('q')} AS qs FROM asked), d AS (SELECT doc_id, {_WORDSET.format('text')} AS ds FROM documents WHERE text IS NOT NULL),
    s AS (SELECT query_id, doc_id, round(least(1, len(list_intersect(qs, ds))::DOUBLE / len(qs)), 9) AS score FROM q, d WHERE len(list_intersect(qs, ds)) > 0)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
    """
)
def lexical_relevance(spark: SparkSession, directory: str) -> DataFrame:
    """Share of the question's words that a text has; the ten best texts. Joined on words, not pairwise."""
    asked = asked_queries(spark, directory).withColumn("qs", X.word_set(F.col("q")))
    words = asked.select("query_id", F.size("qs").alias("n"), F.explode("qs").alias("w"))
    held = table(spark, directory, "documents").select("doc_id", F.explode(X.word_set(F.col("text"))).alias("w"))
    scored = words.join(held, "w").groupBy("query_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return search.ranked(scored.select("query_id", "doc_id", F.round(F.least(F.lit(1.0), F.col("shared") / F.col("n")), 9).alias("score")), ["query_id"], "score", "doc_id", 10)


@query(
    f"""
    WITH {_ASKED}, q AS (SELECT query_id, {_WORDSET.format('q')} AS s FROM asked), c AS (SELECT id, {_WORDSET.format('any_value(query_text)')} AS s FROM semantic_cache GROUP BY id)
    SELECT q.query_id, c.id AS other, round(len(list_intersect(q.s, c.s))::DOUBLE / len(list_distinct(list_concat(q.s, c.s))), 9) AS jaccard
    FROM q JOIN c ON q.query_id <> c.id WHERE len(list_intersect(q.s, c.s))::DOUBLE / len(list_distinct(list_concat(q.s, c.s))) > 0.7
    """
)
def clue_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    """Questions whose word sets are alike to more than 0.7 with a stated question: a join on words with counts."""
    every = table(spark, directory, "semantic_cache").groupBy("id").agg(F.first("query_text").alias("t")).withColumn("s", X.word_set(F.col("t")))
    words = every.select("id", F.size("s").alias("n"), F.explode("s").alias("w"))
    asked = words.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("n").alias("m"), "w")
    shared = asked.join(words.withColumnRenamed("id", "other"), "w").where("query_id <> other").groupBy("query_id", "other", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    score = F.col("k") / (F.col("n") + F.col("m") - F.col("k"))
    return shared.where(score > 0.7).select("query_id", "other", F.round(score, 9).alias("jaccard"))


@query("SELECT sha256(text) AS content, count(*) AS copies, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_content(spark: SparkSession, directory: str) -> DataFrame:
    """One row per text; the smallest id stays."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL")
    return docs.groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id")).select(F.sha2("text", 256).alias("content"), "copies", "doc_id")


@query("SELECT sha256(substr(text, 1, 200)) AS beginning, count(DISTINCT source) AS components, round(max(n_chars) * (1 + 0.2 * (count(DISTINCT source) - 1)), 6) AS score FROM documents WHERE text IS NOT NULL GROUP BY substr(text, 1, 200)")
def recompose_by_prefix(spark: SparkSession, directory: str) -> DataFrame:
    """Rows grouped by their first 200 characters; the best score is raised by the number of components."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL").withColumn("p", F.substring("text", 1, 200))
    grouped = docs.groupBy("p").agg(F.countDistinct("source").alias("components"), F.max("n_chars").alias("best"))
    return grouped.select(F.sha2("p", 256).alias("beginning"), "components", F.round(F.col("best") * (1 + 0.2 * (F.col("components") - 1)), 6).alias("score"))


_SNIPPETS = (
    _SPARSE
    + rf""", top AS (SELECT query_id, doc_id, score, rank FROM sp WHERE rank <= 5),
    sent AS (SELECT query_id, doc_id, rank, q, unnest({_SENTENCES}) AS s, generate_subscripts({_SENTENCES}, 1) - 1 AS i FROM top JOIN documents USING (doc_id) JOIN asked USING (query_id)),
    sc AS (SELECT *, round(0.7 * len(list_intersect({_WORDSET.format('q')}, {_WORDSET.format('s')})) + 0.3 / (i + 1), 9) AS sscore FROM sent),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY sscore DESC, i) AS place FROM sc),
    snip AS (SELECT query_id, doc_id, any_value(rank) AS rank, string_agg(s, ' ... ' ORDER BY place) AS snippet FROM best WHERE place <= 3 GROUP BY ALL)"""
)


def _snippets(spark: SparkSession, directory: str) -> DataFrame:
    top = _sparse(spark, directory).where("rank <= 5")
    held = top.join(table(spark, directory, "documents").select("doc_id", "text"), "doc_id").join(asked_queries(spark, directory), "query_id")
    parts = held.select("query_id", "doc_id", "rank", X.word_set(F.col("q")).alias("qs"), F.posexplode(X.sentences(F.col("text"))).alias("i", "s"))
    scored = parts.withColumn("sscore", F.round(0.7 * F.size(F.array_intersect("qs", X.word_set(F.col("s")))) + 0.3 / (F.col("i") + 1), 9))
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("sscore"), "i"))).where("place <= 3")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]), " ... ")
    return best.groupBy("query_id", "doc_id").agg(F.first("rank").alias("rank"), joined.alias("snippet"))


@query(_SNIPPETS + "SELECT query_id, doc_id, rank, sha256(snippet) AS snippet FROM snip")
def context_snippets(spark: SparkSession, directory: str) -> DataFrame:
    """The three sentences of each hit that fit its question best, in order of their score."""
    return _snippets(spark, directory).select("query_id", "doc_id", "rank", F.sha2("snippet", 256).alias("snippet"))


@query(
    _SNIPPETS
    + r""", b AS (SELECT *, sum(len(list_filter(regexp_split_to_array(snippet, '\s+'), lambda w: w <> ''))) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM snip)
    SELECT query_id, doc_id, used::BIGINT AS used FROM b WHERE used <= 120"""
)
def context_budget(spark: SparkSession, directory: str) -> DataFrame:
    """Snippets in order of their hits until the budget of 120 words is used up."""
    window = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return _snippets(spark, directory).withColumn("used", F.sum(F.size(X.words(F.col("snippet")))).over(window)).where("used <= 120").select("query_id", "doc_id", "used")


_PROMPT = _SPARSE + r""", top AS (SELECT query_id, doc_id, score, rank FROM sp WHERE rank <= 5),
    ctx AS (SELECT query_id, string_agg('[' || rank || '] ' || substr(text, 1, 500), chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN documents USING (doc_id) GROUP BY query_id)"""


@query(_PROMPT + "SELECT query_id, sha256('Responda em Português.' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Pergunta: ' || q || chr(10) || chr(10) || 'Pense passo a passo.') AS prompt FROM ctx JOIN asked USING (query_id)")
def prompt_assembly(spark: SparkSession, directory: str) -> DataFrame:
    """System line, up to five numbered contexts of 500 characters, question and suffix (as hash)."""
    top = _sparse(spark, directory).where("rank <= 5").join(table(spark, directory, "documents").select("doc_id", "text"), "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("text", 1, 500)).alias("line")
    context = top.select("query_id", "rank", line).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("context"))
    parts = [F.lit("Responda em Português."), F.col("context"), F.concat(F.lit("Pergunta: "), F.col("q")), F.lit("Pense passo a passo.")]
    return context.join(asked_queries(spark, directory), "query_id").select("query_id", F.sha2(F.concat_ws("\n\n", *parts), 256).alias("prompt"))


@query(
    _SPARSE
    + """, lo AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM sp)
    SELECT query_id, round(least(1.0, 0.5 + CASE WHEN count(*) > 5 THEN 0.2 ELSE 0 END + CASE WHEN avg(CASE WHEN rank <= 3 THEN CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / (hi - lo) END END) > 0.8 THEN 0.2 ELSE 0 END), 6) AS confidence
    FROM lo GROUP BY query_id"""
)
def answer_confidence(spark: SparkSession, directory: str) -> DataFrame:
    """Confidence by number of hits and the mean of the three best min-max scores."""
    window = Window.partitionBy("query_id")
    hits = _sparse(spark, directory).withColumn("lo", F.min("score").over(window)).withColumn("hi", F.max("score").over(window))
    scaled = F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    value = F.lit(0.5) + F.when(F.count(F.lit(1)) > 5, 0.2).otherwise(0.0) + F.when(F.avg(F.when(F.col("rank") <= 3, scaled)) > 0.8, 0.2).otherwise(0.0)
    return hits.groupBy("query_id").agg(F.round(F.least(F.lit(1.0), value), 6).alias("confidence"))


@query(_SPARSE + "SELECT query_id, string_agg('[' || rank || '] ' || coalesce(file_path, 'unknown'), chr(10) ORDER BY rank) AS citations FROM sp JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id")
def citations(spark: SparkSession, directory: str) -> DataFrame:
    """Numbered sources of the three best hits."""
    top = _sparse(spark, directory).where("rank <= 3").join(table(spark, directory, "documents").select("doc_id", "file_path"), "doc_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("file_path", F.lit("unknown"))).alias("line")
    return top.select("query_id", "rank", line).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("citations"))


@query(
    r"""
    WITH c AS (SELECT id, any_value(response_data) AS r FROM semantic_cache GROUP BY id)
    SELECT id, CASE WHEN r LIKE '{%' THEN coalesce(TRY_CAST(regexp_extract(r, '"confidence": ([0-9.]+)', 1) AS DOUBLE), 0.5) ELSE 0.5 END AS score,
           coalesce(regexp_matches(r, '"sources": \["'), false) AS has_sources
    FROM c
    """
)
def parse_evaluation(spark: SparkSession, directory: str) -> DataFrame:
    """Fields read out of answers by patterns, with defaults where they are missing."""
    once = table(spark, directory, "semantic_cache").groupBy("id").agg(F.first("response_data").alias("r"))
    found = F.expr("try_cast(nullif(regexp_extract(r, '\"confidence\": ([0-9.]+)', 1), '') as double)")
    score = F.when(F.col("r").startswith("{"), F.coalesce(found, F.lit(0.5))).otherwise(F.lit(0.5))
    return once.select("id", score.alias("score"), F.coalesce(F.col("r").rlike(r'"sources": \["'), F.lit(False)).alias("has_sources"))


@query(
    """
    WITH once AS (SELECT * FROM (SELECT id, content, language, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST) AS n FROM chunks) WHERE n = 1)
    SELECT source_strategy, count(*) AS docs FROM (
        SELECT content, min(s) AS source_strategy FROM (
            SELECT content, 'a_code' AS s FROM once WHERE language IN ('python', 'java') UNION ALL SELECT content, 'b_all' FROM once WHERE content IS NOT NULL
        ) WHERE content IS NOT NULL GROUP BY content
    ) GROUP BY source_strategy
    """
)
def consolidate_strategies(spark: SparkSession, directory: str) -> DataFrame:
    """Results of several strategies put together; each text counts for the first that has it."""
    once = latest(table(spark, directory, "chunks").select("id", "content", "language", "created_at"), ["id"], F.asc_nulls_first("created_at")).where("content IS NOT NULL")
    both = once.where("language IN ('python', 'java')").select("content", F.lit("a_code").alias("s")).unionByName(once.select("content", F.lit("b_all").alias("s")))
    return both.groupBy("content").agg(F.min("s").alias("source_strategy")).groupBy("source_strategy").agg(F.count(F.lit(1)).alias("docs"))


_TOKENS = TOKENS_SQL.format("text")
_PAIRS = f"list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
_KEYS = f"""
    WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest({_PAIRS}) AS term FROM d),
    p AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL), n AS (SELECT count(*) AS n FROM d),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n)),
    s AS (SELECT doc_id, term, round(tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1), 9) AS score FROM p JOIN f USING (term), n),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 20)
"""


@query(_KEYS + "SELECT doc_id, term, score, rank FROM k")
def key_terms(spark: SparkSession, directory: str) -> DataFrame:
    """The twenty terms and pairs of terms that tell most about every text."""
    return sparse.key_terms(table(spark, directory, "documents"), "doc_id", "text")


@query(_KEYS.replace("WITH d AS", _WEIGHTS + ", d AS").replace("p AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL)", "kp AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL)").replace("FROM p GROUP BY term HAVING", "FROM kp GROUP BY term HAVING").replace("FROM p JOIN f USING", "FROM kp JOIN f USING") + "SELECT doc_id, round(sum(weight * CASE WHEN k.term IS NULL THEN 1 ELSE 1.5::DOUBLE END), 6) AS weight FROM w LEFT JOIN k USING (doc_id, term) GROUP BY doc_id")
def bm25_boosted(spark: SparkSession, directory: str) -> DataFrame:
    """BM25 weights raised for key terms, summed up per text."""
    docs = table(spark, directory, "documents")
    raised = sparse.boosted(sparse.weights(_index(spark, directory)), sparse.key_terms(docs, "doc_id", "text"))
    return raised.groupBy("doc_id").agg(F.round(F.sum("weight"), 6).alias("weight"))
