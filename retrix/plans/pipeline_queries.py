"""Queries around pipelines: their statistics, what they make of questions and texts, batches of requests, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrix.functions import questions as Q
from retrix.functions import text as X
from retrix.operators import memory, models
from retrix.operators import monitor as M
from retrix.plans.analysis_queries import ASKED, questions
from retrix.plans.catalog_queries import ONCE as CHUNKS_ONCE
from retrix.plans.catalog_queries import chunks
from retrix.plans.graph_queries import GRAPH, edges, nodes
from retrix.plans.monitor_queries import _LATENCY
from retrix.plans.monitor_queries import ONCE as METRICS_ONCE
from retrix.plans.registry import query
from retrix.plans.text_queries import _CLEAN, _LEAD, _SPARSE, _sparse
from retrix.sources.tables import table

#: Routing strategies that stand for a corrected and for a decomposed question in the metrics.
CORRECTED, DECOMPOSED = "hybrid", "graph"


def _metrics(spark: SparkSession, directory: str) -> DataFrame:
    return M.once(table(spark, directory, "query_metrics"))


@query(METRICS_ONCE + f" SELECT count(*) AS total, round(avg((routing_strategy = '{CORRECTED}')::INT), 6) AS correction_rate, round(avg((routing_strategy = '{DECOMPOSED}')::INT), 6) AS decomposition_rate FROM m")
def correction_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Shares of corrected and of decomposed questions."""
    rate = lambda name: F.round(F.avg((F.col("routing_strategy") == name).cast("int")), 6)
    return _metrics(spark, directory).agg(F.count(F.lit(1)).alias("total"), rate(CORRECTED).alias("correction_rate"), rate(DECOMPOSED).alias("decomposition_rate"))


@query(
    METRICS_ONCE
    + f", t AS (SELECT *, {_LATENCY} AS l FROM m) SELECT routing_reason, count(*) AS queries, round(avg(l), 6) AS mean_time, round(avg(relevance_score), 6) AS mean_relevance, round(avg(documents_after_rerank), 6) AS mean_results, round(avg((routing_strategy = '{CORRECTED}')::INT), 6) AS correction_rate FROM t GROUP BY routing_reason"
)
def performance_evaluation(spark: SparkSession, directory: str) -> DataFrame:
    """Mean time, relevance and results of the questions, by the reason of their route."""
    return _metrics(spark, directory).groupBy("routing_reason").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(M.valid(F.col("total_latency"))), 6).alias("mean_time"), F.round(F.avg("relevance_score"), 6).alias("mean_relevance"),
        F.round(F.avg("documents_after_rerank"), 6).alias("mean_results"), F.round(F.avg((F.col("routing_strategy") == CORRECTED).cast("int")), 6).alias("correction_rate"),
    )


@query(
    METRICS_ONCE
    + f""", a AS (SELECT count(*) AS total, round(avg({_LATENCY}), 2) AS mean_time, round(avg(cache_hit::INT), 3) AS hit_rate, round(avg(relevance_score), 3) AS confidence FROM m)
    SELECT routing_strategy AS improvement, count(*) AS used, any_value(total) AS total, round(count(*)::DOUBLE / any_value(total), 6) AS adoption, any_value(mean_time) AS mean_time, any_value(hit_rate) AS hit_rate, any_value(confidence) AS confidence
    FROM m, a GROUP BY routing_strategy"""
)
def advanced_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Use and adoption of every improvement, with the rounded means of the whole pipeline."""
    rows = _metrics(spark, directory)
    whole = rows.agg(F.count(F.lit(1)).alias("total"), F.round(F.avg(M.valid(F.col("total_latency"))), 2).alias("mean_time"), F.round(F.avg(F.col("cache_hit").cast("int")), 3).alias("hit_rate"), F.round(F.avg("relevance_score"), 3).alias("confidence"))
    used = rows.groupBy(F.col("routing_strategy").alias("improvement")).agg(F.count(F.lit(1)).alias("used"))
    return used.join(whole).select("improvement", "used", "total", F.round(F.col("used") / F.col("total"), 6).alias("adoption"), "mean_time", "hit_rate", "confidence")  # one row beside each


_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')"


def _label_sql(text: str) -> str:
    held = rf"list_distinct(regexp_extract_all(lower({text}), '[\pL\pN_]+'))"
    return "{" + ", ".join(f"'{label}': len(list_intersect({held}, [{', '.join(repr(t) for t in sorted(set(terms.split())))}]))" for label, terms in models.LABELS.items()) + "}"


_LABELS = list(models.LABELS)
_MOST = "greatest(" + ", ".join(f"c.{x}" for x in _LABELS) + ")"
_LABEL = f"CASE WHEN {_MOST} = 0 THEN 'technology' " + " ".join(f"WHEN c.{x} = {_MOST} THEN '{x}'" for x in _LABELS) + " END"
_SURE = f"CASE WHEN {_MOST} = 0 THEN 0.5::DOUBLE ELSE {_MOST}::DOUBLE / (" + " + ".join(f"c.{x}" for x in _LABELS) + ") END"


@query(f"WITH d AS (SELECT doc_id, {_label_sql('text')} AS c FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_LABEL} AS label, round({_SURE}, 6) AS confidence FROM d")
def content_labels(spark: SparkSession, directory: str) -> DataFrame:
    """Label of every text by the default classifier, from the whole text."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", models.content_label(F.col("text")).alias("c")).select("doc_id", "c.label", F.round("c.confidence", 6).alias("confidence"))


@query(
    f"WITH t AS (SELECT doc_id, {_CLEAN} AS text FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, text, {_label_sql('text')} AS c FROM t) "
    f"SELECT doc_id, sha256(text) AS cleaned, {_LABEL} AS label, sha256({_LEAD}) AS summary, length(text) AS char_count, len({_WORDS.format('text')}) AS word_count FROM d"
)
def preprocess_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Every text cleaned, classified, summed up and measured in one pass."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL").select("doc_id", X.clean(F.col("text")).alias("c"))
    return docs.select(
        "doc_id", F.sha2("c", 256).alias("cleaned"), models.content_label(F.col("c"))["label"].alias("label"), F.sha2(X.lead(F.col("c")), 256).alias("summary"),
        F.length("c").alias("char_count"), F.size(X.words(F.col("c"))).alias("word_count"),
    )


_SAME = "MAP {" + ", ".join(f"'{w}': [{', '.join(repr(x) for x in same)}]" for w, same in Q.SYNONYMS.items()) + "}"


@query(ASKED + rf", e AS (SELECT id, q, flatten(list_transform(list_filter(regexp_split_to_array(low, '\s+'), lambda w: w <> ''), lambda w: coalesce(({_SAME})[w], []))) AS more FROM b) SELECT id, CASE WHEN len(more) > 0 THEN q || ' ' || array_to_string(more, ' ') ELSE q END AS expanded FROM e")
def query_expansion(spark: SparkSession, directory: str) -> DataFrame:
    """Every question with the synonyms of its words."""
    return questions(spark, directory).select("id", Q.expanded(F.col("q")).alias("expanded"))


_CLAUSES = r"list_filter(list_transform(regexp_split_to_array(q, '\s*[,;:.?!¿¡]+\s*|\s+(?:e|and|y|ou|or|mas|but|pero)\s+'), lambda x: trim(x)), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) > 2)"


@query(ASKED + f" SELECT id, len({_CLAUSES}) AS n, array_to_string({_CLAUSES}, '|') AS clauses FROM b")
def query_clauses(spark: SparkSession, directory: str) -> DataFrame:
    """Clauses of every question."""
    found = questions(spark, directory).withColumn("c", Q.clauses(F.col("q")))
    return found.select("id", F.size("c").alias("n"), F.array_join("c", "|").alias("clauses"))


@query()
def query_enhanced(spark: SparkSession, directory: str) -> DataFrame:
    """Every question with its rewritings by synonyms and clauses."""
    return questions(spark, directory).select("id", F.posexplode(Q.enhanced(F.col("q"))).alias("n", "q"))


_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


@query(
    rf"""
    WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split({_STRIP.format('text')}, chr(10)), lambda x: {_STRIP.format("regexp_replace(" + _STRIP.format('x') + ", '^[0-9]+[.)" + chr(92) + "s-]+', '')")}), lambda x: length(x) > 10) AS kept FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(kept) AS n_lines, sha256(array_to_string(list_slice(list_concat(kept, [{', '.join(f"split_part(text, '.', 1) || ' {x}'" for x in Q.PADDING)}]), 1, 3), chr(10))) AS variations FROM l
    """
)
def parse_variations(spark: SparkSession, directory: str) -> DataFrame:
    """Variations read out of texts as if these were a model's numbered lines (as hash)."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.size(Q.numbered_lines(F.col("text"))).alias("n_lines"), F.sha2(F.array_join(Q.variations(F.col("text")), "\n"), 256).alias("variations"))


@query(
    METRICS_ONCE
    + f""", f AS (SELECT list(routing_strategy ORDER BY l, routing_strategy) AS names FROM (SELECT routing_strategy, avg({_LATENCY}) AS l FROM m WHERE routing_strategy <> '' GROUP BY routing_strategy ORDER BY l, routing_strategy LIMIT 2)),
    """
    + ASKED.strip().removeprefix("WITH")
    + """, s AS (SELECT id, list_concat(list_concat(list_concat(['standard'], CASE WHEN contains(lower(q), 'code') OR contains(lower(q), 'function') THEN ['code_specific'] ELSE [] END),
        CASE WHEN n > 20 OR contains(substr(q, 1, greatest(length(q) - 1, 0)), '?') THEN ['multi_query', 'graph_enhanced'] ELSE [] END), names) AS all_names FROM b, f)
    SELECT id, array_to_string(list_slice(all_names, 1, 5), ',') AS strategies FROM s"""
)
def parallel_strategies(spark: SparkSession, directory: str) -> DataFrame:
    """Strategies that are run side by side for every question."""
    rows = _metrics(spark, directory).where("routing_strategy <> ''").groupBy("routing_strategy").agg(F.avg(M.valid(F.col("total_latency"))).alias("l"))
    fastest = rows.orderBy("l", "routing_strategy").limit(2).agg(F.sort_array(F.collect_list(F.struct("l", "routing_strategy"))).alias("f"))
    both = questions(spark, directory).join(fastest)  # one row beside each
    return both.select("id", F.array_join(Q.parallel_strategies(F.col("q"), F.col("f.routing_strategy")), ",").alias("strategies"))


_STOP = ("como", "para", "when", "what", "which", "quando", "cuando")
_KEYWORDS = rf"list_filter(regexp_extract_all(lower(q), '[a-z]{{4,}}'), lambda w: NOT list_contains([{', '.join(repr(w) for w in _STOP)}], w))"


@query(
    _SPARSE
    + f""", v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    j AS (SELECT sp.query_id, sp.doc_id, sp.score AS s, list_cosine_similarity(a.e, z.e) AS d, list_filter({_KEYWORDS}, lambda w: contains(lower(text), w)) AS found
        FROM sp JOIN asked USING (query_id) JOIN documents USING (doc_id) LEFT JOIN v a ON a.vec_id = sp.query_id LEFT JOIN v z ON z.vec_id = sp.doc_id WHERE rank <= 10)
    SELECT query_id, doc_id, coalesce(nullif(concat_ws('; ', CASE WHEN d > 0.8 THEN 'Alta similaridade semântica' WHEN d > 0.6 THEN 'Similaridade semântica moderada' END,
        CASE WHEN s > 0.5 THEN 'Forte match de keywords' WHEN s > 0.2 THEN 'Match parcial de keywords' END,
        CASE WHEN len(found) > 0 THEN 'Keywords encontradas: ' || array_to_string(found, ', ') END), ''), 'Match geral') AS explanation FROM j"""
)
def match_explanations(spark: SparkSession, directory: str) -> DataFrame:
    """Why each of a question's ten best texts was found. Vectors and texts are aligned by equal ids."""
    from retrix.functions import vectors as V
    from retrix.plans.text_queries import asked_queries

    vectors = table(spark, directory, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    hits = _sparse(spark, directory).where("rank <= 10").join(asked_queries(spark, directory), "query_id").join(table(spark, directory, "documents").select("doc_id", "text"), "doc_id")
    hits = hits.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("e").alias("a")), "query_id", "left").join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("e").alias("z")), "doc_id", "left")
    keywords = F.filter(F.regexp_extract_all(F.lower("q"), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*_STOP))
    found = F.filter(keywords, lambda w: F.lower("text").contains(w))
    return hits.select("query_id", "doc_id", Q.match_explanation(V.cosine(F.col("a"), F.col("z")), F.col("score"), found).alias("explanation"))


#: Pairs of terms that stand for patterns found in a graph.
PATTERNS = (("cache", ("cache", "entrada")), ("index", ("index", "vector")), ("archive", ("arquivo", "archivo", "archive")))


@query(
    _SPARSE
    + f""", pats AS (SELECT * FROM (VALUES {', '.join(f"('{name}', [{', '.join(repr(t) for t in terms)}])" for name, terms in PATTERNS)}) AS p(pattern, terms)),
    t AS (SELECT query_id, string_agg(lower(text), chr(10) ORDER BY rank) AS x, list(lower(text)) AS texts FROM sp JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id)
    SELECT query_id, pattern, round(least(1.0::DOUBLE, 0.3 * len(list_filter(terms, lambda e: contains(lower(q), e))) + 0.1 * list_sum(list_transform(terms, lambda e: len(list_filter(coalesce(texts, []), lambda x: contains(x, e)))))), 6) AS relevance
    FROM asked LEFT JOIN t USING (query_id), pats WHERE q IS NOT NULL"""
)
def pattern_relevance(spark: SparkSession, directory: str) -> DataFrame:
    """How much each pattern has to do with a question and its three best texts."""
    from retrix.plans.text_queries import asked_queries

    texts = _sparse(spark, directory).where("rank <= 3").join(table(spark, directory, "documents").select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.collect_list(F.lower("text")).alias("texts"))  # three at most
    rows = asked_queries(spark, directory).where("q IS NOT NULL").join(texts, "query_id", "left")
    patterns = F.array(*(F.struct(F.lit(name).alias("pattern"), F.array(*map(F.lit, terms)).alias("terms")) for name, terms in PATTERNS))
    rows = rows.select("query_id", "q", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"), F.explode(patterns).alias("p"))
    asked = F.size(F.filter("p.terms", lambda e: F.lower("q").contains(e)))
    held = F.aggregate("p.terms", F.lit(0), lambda n, e: n + F.size(F.filter("texts", lambda x: x.contains(e))))
    return rows.select("query_id", "p.pattern", F.round(F.least(F.lit(1.0), 0.3 * asked + 0.1 * held), 6).alias("relevance"))


@query(CHUNKS_ONCE + " SELECT id, round(least(1.0::DOUBLE, length(coalesce(content, '')) / 1000.0::DOUBLE + len(coalesce(symbols, [])) / 10.0::DOUBLE), 6) AS complexity FROM c")
def batch_complexity(spark: SparkSession, directory: str) -> DataFrame:
    """Complexity of handling every chunk: its length and its symbols."""
    value = F.length(F.coalesce("content", F.lit(""))) / 1000 + F.size(F.coalesce("symbols", F.array().cast("array<string>"))) / 10
    return chunks(spark, directory).select("id", F.round(F.least(F.lit(1.0), value), 6).alias("complexity"))


BATCH = 32


@query(
    METRICS_ONCE
    + f""", b AS (SELECT query_id, routing_strategy, (row_number() OVER (PARTITION BY routing_strategy ORDER BY ts, query_id) - 1) // {BATCH} AS batch FROM m)
    SELECT routing_strategy, batch, count(*) AS requests, count(*) = {BATCH} AS full_batch, min(query_id) AS first_id FROM b GROUP BY ALL"""
)
def request_batches(spark: SparkSession, directory: str) -> DataFrame:
    """Requests of each strategy in batches of 32, in order of time; the last one may be waiting."""
    rows = _metrics(spark, directory).select("query_id", "routing_strategy", "ts")
    numbered = M.running(rows, {"n": F.lit(1)}, ["routing_strategy"], F.date_trunc("hour", "ts"), ["ts", "query_id"])
    batch = F.floor((F.col("n") - 1) / BATCH).cast("long").alias("batch")
    return numbered.groupBy("routing_strategy", batch).agg(F.count(F.lit(1)).alias("requests"), (F.count(F.lit(1)) == BATCH).alias("full_batch"), F.min("query_id").alias("first_id"))


@query(
    CHUNKS_ONCE
    + f""", k AS (SELECT id, project_id, length(coalesce(content, '')) / 1000.0::DOUBLE + len(coalesce(symbols, [])) / 10.0::DOUBLE < 0.5 AS simple FROM c)
    SELECT project_id, count(*) FILTER (simple) AS at_once, count(*) FILTER (NOT simple) AS in_pairs, ceil(count(*) FILTER (NOT simple) / 2.0)::BIGINT + (count(*) FILTER (simple) > 0)::BIGINT AS rounds FROM k GROUP BY project_id"""
)
def adaptive_batches(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks of each project that are handled at once, being simple, and those that are handled two at a time."""
    value = F.length(F.coalesce("content", F.lit(""))) / 1000 + F.size(F.coalesce("symbols", F.array().cast("array<string>"))) / 10
    rows = chunks(spark, directory).select("project_id", (value < 0.5).alias("simple")).groupBy("project_id")
    counted = rows.agg(F.count_if("simple").alias("at_once"), F.count_if(~F.col("simple")).alias("in_pairs"))
    return counted.withColumn("rounds", F.ceil(F.col("in_pairs") / 2) + (F.col("at_once") > 0).cast("long"))


@query(
    METRICS_ONCE
    + """ SELECT query_id, ts AS "timestamp", to_json({'event': 'query_received', 'query_id': query_id, 'query_text': CASE WHEN length(query_text) > 100 THEN substr(query_text, 1, 100) || '...' ELSE query_text END, 'query_length': length(query_text)})::VARCHAR AS record
    FROM m WHERE query_text IS NOT NULL"""
)
def log_records(spark: SparkSession, directory: str) -> DataFrame:
    """A structured record of every question that came in."""
    rows = _metrics(spark, directory).where("query_text IS NOT NULL")
    short = F.when(F.length("query_text") > 100, F.concat(F.substring("query_text", 1, 100), F.lit("..."))).otherwise(F.col("query_text"))
    record = F.to_json(F.struct(F.lit("query_received").alias("event"), "query_id", short.alias("query_text"), F.length("query_text").alias("query_length")))
    return rows.select("query_id", F.col("ts").alias("timestamp"), record.alias("record"))


@query(
    GRAPH
    + """, h AS (SELECT src, count(*) AS n, list_sort(list(dst)) AS names FROM edges WHERE type IN ('HAS', 'SELLS') GROUP BY src)
    SELECT id, concat_ws(chr(10), id, CASE WHEN n > 0 THEN chr(10) || chr(10) || '[Contexto do Grafo]' || chr(10) || n || ' relations' END, CASE WHEN n > 0 THEN chr(10) || 'Entidades relacionadas: ' || array_to_string(list_slice(names, 1, 5), ', ') END) AS enriched
    FROM nodes LEFT JOIN h ON src = id WHERE type IN ('region', 'nation')"""
)
def graph_merge_context(spark: SparkSession, directory: str) -> DataFrame:
    """Regions and nations with a summary of their surroundings behind their name."""
    links = edges(spark, directory).where("type IN ('HAS', 'SELLS')").select(F.col("src").alias("id"), "dst")
    place = F.row_number().over(Window.partitionBy("id").orderBy("dst"))
    counted = links.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    first = links.withColumn("place", place).where("place <= 5").groupBy("id").agg(F.sort_array(F.collect_list("dst")).alias("names"))
    rows = nodes(spark, directory).where("type IN ('region', 'nation')").join(counted, "id", "left").join(first, "id", "left")
    return rows.select("id", X.merge_context(F.col("id"), F.concat(F.col("n").cast("string"), F.lit(" relations")), F.col("names")).alias("enriched"))


@query(CHUNKS_ONCE + " SELECT id, file_path, language FROM c WHERE contains(content, 'cache') OR contains(file_path, 'cache') ORDER BY id LIMIT 10")
def graph_search_content(spark: SparkSession, directory: str) -> DataFrame:
    """The first ten chunks whose content or path holds a term."""
    return chunks(spark, directory).where(F.col("content").contains("cache") | F.col("file_path").contains("cache")).orderBy("id").limit(10).select("id", "file_path", "language")


@query("SELECT id, document_id, pos, file_path, language, source, chunk_hash, created_at FROM chunks WHERE project_id = (SELECT min(id) FROM projects)")
def chunks_by_project(spark: SparkSession, directory: str) -> DataFrame:
    """All rows of one project."""
    wanted = table(spark, directory, "projects").agg(F.min("id").alias("project_id"))
    return table(spark, directory, "chunks").join(wanted, "project_id", "left_semi").select("id", "document_id", "pos", "file_path", "language", "source", "chunk_hash", "created_at")


@query()
def memory_compression(spark: SparkSession, directory: str) -> DataFrame:
    """Which texts are worth compressing in the memory, how much it gains, and whether they come back whole."""
    docs = table(spark, directory, "documents").where("text IS NOT NULL").select("doc_id", "text")
    packed = docs.select("doc_id", "text", memory.compressed(F.col("text")).alias("c"))
    return packed.select("doc_id", "c.compressed", F.round("c.ratio", 6).alias("ratio"), (memory.restored(F.col("c")) == F.col("text")).alias("whole"))


@query("""SELECT vec_id, to_json({'node_id': vec_id, 'level': 0, 'cluster_id': label, 'token_count': vec_id % 90 + 10})::VARCHAR AS node, label AS cluster_id FROM embeddings""")
def node_records(spark: SparkSession, directory: str) -> DataFrame:
    """Nodes of the tree as records, and what is read back from them."""
    rows = table(spark, directory, "embeddings")
    node = F.to_json(F.struct(F.col("vec_id").alias("node_id"), F.lit(0).alias("level"), F.col("label").alias("cluster_id"), (F.col("vec_id") % 90 + 10).alias("token_count")))
    back = F.from_json(node, "node_id long, level int, cluster_id int, token_count long")
    return rows.select("vec_id", node.alias("node"), back["cluster_id"].alias("cluster_id"))


@query(
    r"""
    WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\pL\pM\pN_\s]', '', 'g'), '\s+'), lambda w: w <> '')) AS term FROM documents),
    c AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS i FROM t GROUP BY term QUALIFY i < 64), f AS (SELECT doc_id, i, count(*) AS tf FROM t JOIN c USING (term) GROUP BY ALL)
    SELECT doc_id, list(i::INT ORDER BY i) AS indices, list(tf::DOUBLE ORDER BY i) AS "values" FROM f GROUP BY doc_id
    """
)
def sparse_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """Every text over the 64 most frequent words as indices and values."""
    terms = table(spark, directory, "documents").where("text IS NOT NULL").select("doc_id", F.explode(X.bare_words(F.col("text"))).alias("term"))
    top = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(64)
    numbered = top.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "term")) - 1).select("term", "i")  # 64 rows
    counted = terms.join(numbered, "term").groupBy("doc_id", "i").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    held = counted.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "tf"))).alias("v"))  # 64 at most
    return held.select("doc_id", F.col("v.i").alias("indices"), F.col("v.tf").alias("values"))


_REASONING = "CASE " + " ".join("WHEN (" + " OR ".join(f"contains(low, '{t}')" for t in terms) + f") THEN '{label}'" for label, terms in Q.REASONING) + " ELSE 'factual' END"


@query(
    ASKED
    + f""", k AS (SELECT id, q, {_REASONING} AS reasoning FROM b) SELECT id, CASE reasoning WHEN 'comparative' THEN 'Comparando as informações:' || chr(10) || chr(10) || 'Perspectiva 1: ' || q || chr(10) || chr(10) || 'Perspectiva 2: ' || upper(q)
    ELSE 'Síntese das informações encontradas:' || chr(10) || chr(10) || q || ' ' || upper(q) END AS answer FROM k"""
)
def combined_answers(spark: SparkSession, directory: str) -> DataFrame:
    """Two answers put together by the kind of reasoning (the question itself and in capitals stand for them)."""
    reasoning = Q.first_match(Q.lower(F.col("q")), Q.REASONING, "factual")
    return questions(spark, directory).select("id", Q.combined_answer(F.array("q", F.upper("q")), reasoning).alias("answer"))


_NAMES = CHUNKS_ONCE + """, e AS (SELECT DISTINCT id, src, dst FROM (SELECT id, unnest(symbols) AS src, relations['calls'] AS cs FROM c), unnest(cs) AS u(dst) WHERE src IS NOT NULL AND dst IS NOT NULL),
    two AS (SELECT DISTINCT src AS name, dst AS other FROM e UNION SELECT DISTINCT dst, src FROM e), g AS (SELECT name, count(*) AS degree FROM two GROUP BY name)"""


def _symbol_edges(spark: SparkSession, directory: str) -> DataFrame:
    """Which symbol of a chunk stands beside which call: ``id``, ``src``, ``dst``."""
    rows = chunks(spark, directory).select("id", F.explode("symbols").alias("src"), F.col("relations")["calls"].alias("cs"))
    return rows.select("id", "src", F.explode("cs").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


@query(
    _NAMES
    + """, n AS (SELECT DISTINCT e.id, b.other AS name FROM (SELECT DISTINCT id, src FROM e) e JOIN two b ON b.name = e.src),
    r AS (SELECT n.id, n.name, degree, row_number() OVER (PARTITION BY n.id ORDER BY degree DESC, n.name) AS place FROM n JOIN g USING (name))
    SELECT id, concat_ws(chr(10), id, chr(10) || chr(10) || '[Contexto do Grafo]' || chr(10) || count(*) || ' relations', chr(10) || 'Entidades relacionadas: ' || string_agg(name, ', ' ORDER BY place) FILTER (place <= 5)) AS enriched FROM r GROUP BY id"""
)
def chunks_enriched(spark: SparkSession, directory: str) -> DataFrame:
    """Chunks with what the graph of symbols and calls tells of theirs: relations, and the five most central neighbours."""
    links = _symbol_edges(spark, directory)
    both = links.select(F.col("src").alias("name"), F.col("dst").alias("other")).union(links.select("dst", "src")).distinct()
    degree = both.groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    near = links.select("id", F.col("src").alias("name")).distinct().join(both, "name").select("id", F.col("other").alias("name")).distinct().join(degree, "name")
    counted = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("degree"), "name"))
    first = near.withColumn("place", place).where("place <= 5").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("names"))
    rows = counted.join(first, "id")
    return rows.select("id", X.merge_context(F.col("id"), F.concat(F.col("n").cast("string"), F.lit(" relations")), F.col("names.name")).alias("enriched"))


@query(
    """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
    m AS (SELECT pos, avg(x) AS x FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM u WHERE vec_id % 100 = 0) GROUP BY pos), c AS (SELECT list(x ORDER BY pos) AS c FROM m)
    SELECT vec_id, round(list_dot_product(e, c), 6) AS relevance FROM u, c
    """
)
def entity_relevance(spark: SparkSession, directory: str) -> DataFrame:
    """Mean cosine of every vector with all stated queries: its product with the mean of their unit vectors, one row."""
    rows = table(spark, directory, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.withColumn("l", length).where("l > 0").select("vec_id", F.transform("e", lambda x: x / F.col("l")).alias("e"))
    mean = unit.where("vec_id % 100 = 0").select(F.posexplode("e").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    centre = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("c"))  # one number per dimension
    product = F.aggregate(F.zip_with("e", "c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return unit.join(centre).select("vec_id", F.round(product, 6).alias("relevance"))


_REPLY = "'CONCEITO: ' || name || chr(10) || 'ENTIDADES: ' || id || ', ' || status || chr(10) || 'OUTRO: x'"


@query(
    f"""
    WITH r AS (SELECT id, unnest(string_split({_REPLY}, chr(10))) AS line FROM projects WHERE name IS NOT NULL AND status IS NOT NULL)
    SELECT id, CASE WHEN line LIKE 'CONCEITO:%' THEN 'concept' ELSE 'entity' END AS kind, trim(split_part(line, ':', 2)) AS clue, CASE WHEN line LIKE 'CONCEITO:%' THEN 0.9 ELSE 0.85 END::DOUBLE AS score
    FROM r WHERE line LIKE 'CONCEITO:%' OR line LIKE 'ENTIDADES:%'
    """
)
def parse_clues(spark: SparkSession, directory: str) -> DataFrame:
    """Clues read out of a model's marked lines (put together here from the projects)."""
    rows = table(spark, directory, "projects").where("name IS NOT NULL AND status IS NOT NULL")
    reply = F.concat(F.lit("CONCEITO: "), "name", F.lit("\nENTIDADES: "), "id", F.lit(", "), "status", F.lit("\nOUTRO: x"))
    return rows.select("id", F.explode(Q.marked_clues(reply)).alias("c")).select("id", "c.kind", "c.clue", "c.score")


@query()
def code_graph_nodes(spark: SparkSession, directory: str) -> DataFrame:
    """Nodes of the graph of the source files, by kind, with their edges."""
    from retrix.operators import codestructure

    links = codestructure.relations(table(spark, directory, "ingest_items"), "item_id", "content", "source").select("type", "src", "dst").distinct()
    ends = links.select(F.col("src").alias("node"), F.lit(1).alias("out")).unionByName(links.select(F.col("dst").alias("node"), F.lit(0).alias("out")))
    by_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("edges"))
    return by_node.groupBy(F.regexp_extract("node", "^([a-z]+)::", 1).alias("kind")).agg(F.count(F.lit(1)).alias("nodes"), F.sum("out").alias("outgoing"), F.sum("edges").alias("ends"))
