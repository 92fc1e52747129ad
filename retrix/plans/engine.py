"""The engine: retrieval, routing, correction and answers over tables of chunks and questions.

Questions are a table too (``query_id``, ``q``), so every step serves all of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrix.functions import questions as Q
from retrix.functions import text as X
from retrix.operators import blocks, fusion, models, search, sparse, tree
from retrix.sources.tables import cut

RELEVANT = 0.7
#: Weights of the heads in their vote.
HEADS = {"factual": 1.2, "conceptual": 1.0, "procedural": 1.1, "contextual": 0.9}


@dataclass
class Engine:
    """An index over documents (``doc_id`` long, ``content``) with embeddings by a pluggable model."""

    documents: DataFrame
    embedder: models.Embedder = models.hash_embedder
    scorer: models.Scorer = models.lexical_score
    generator: models.Generator = models.template_answer
    _held: dict = field(default_factory=dict)

    def lexicon(self) -> sparse.Lexicon:
        if "lexicon" not in self._held:
            self._held["lexicon"] = sparse.fit(self.documents, "doc_id", "content")
        return self._held["lexicon"]

    def vectors(self) -> DataFrame:
        if "vectors" not in self._held:
            self._held["vectors"] = cut(self.documents.where("content IS NOT NULL").select("doc_id", models.embed(F.col("content"), self.embedder).alias("vector")))
        return self._held["vectors"]

    def _blocks(self, questions: DataFrame, k: int, dense: bool = True) -> DataFrame | None:
        """Hybrid or lexical hits of many questions; None if they are few, or have too many terms to be sent."""
        if not blocks.many(questions):
            return None
        lexicon = self.lexicon()
        asked = questions.select("query_id", "q", X.tokens(F.col("q")).alias("ts"))
        wanted = lexicon.terms.join(asked.select(F.explode("ts").alias("term")).distinct(), "term")
        terms = blocks.vocabulary(wanted.select("term", "df", F.col("idf").alias("weight")), lexicon.n)
        if terms is None:
            return None
        texts = cut(terms.numbered(lexicon.texts.select("doc_id", F.col("held.term").alias("ts"), F.transform("held", sparse.share(lexicon)).alias("vs")), "ts", "vs"))
        numbered = terms.numbered(asked, "ts", model=self.embedder if dense else None)
        return blocks.found(numbered.drop("q"), k, self.vectors() if dense else None, texts, terms)

    def dense(self, questions: DataFrame, k: int = 50) -> DataFrame:
        asked = questions.select("query_id", models.embed(F.col("q"), self.embedder).alias("v"))
        return search.top_cosine(self.vectors(), "doc_id", "vector", asked, "query_id", "v", k)

    def sparse(self, questions: DataFrame, k: int = 50) -> DataFrame:
        found = self._blocks(questions, k, dense=False)
        return found if found is not None else sparse.search(self.lexicon(), questions, "query_id", "q", k)

    def hybrid(self, questions: DataFrame, k: int = 20) -> DataFrame:
        """Dense and lexical hits fused by reciprocal rank: ``query_id``, ``doc_id``, ``score``, ``rank``."""
        found = self._blocks(questions, k)
        if found is not None:
            return found
        return fusion.reciprocal_rank(cut(self.dense(questions)), cut(self.sparse(questions)), k).withColumnRenamed("place", "rank")

    @staticmethod
    def _apart(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Parts of questions (``origin``, ``q``) as questions with ids of their own, and what these belong to."""
        held = cut(parts.withColumn("query_id", F.monotonically_increasing_id()))
        return held.select("query_id", "q"), held.drop("q")

    def rerank(self, questions: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
        """Hits in the order of the scorer's judgement of question and content."""
        hits = cut(hits)
        texts = search.among(self.documents, "doc_id", hits)  # contents that no hit names are not moved
        held = hits.join(questions, "query_id").join(texts, "doc_id")  # contents last, so that they are moved once
        scored = held.select("query_id", "doc_id", F.round(models.cross_score(F.col("q"), F.col("content"), self.scorer), 9).alias("score"))
        return search.ranked(scored, ["query_id"], "score", "doc_id", k)

    def multi_query(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Hits of each question and its variations, fused by weighted sums."""
        return self._varied(self._variations(questions, k), k)

    def _variations(self, questions: DataFrame, k: int) -> DataFrame:
        """Hits of each question (``n`` = 0) and its variations: ``origin``, ``n``, ``doc_id``, ``score``, ``rank``."""
        spread, of = self._apart(questions.select(F.col("query_id").alias("origin"), F.posexplode(models.query_variants(F.coalesce("q", F.lit("")))).alias("n", "q")))
        return self.hybrid(spread, k).join(of, "query_id").select("origin", "n", "doc_id", "score", "rank")

    @staticmethod
    def _varied(hits: DataFrame, k: int) -> DataFrame:
        summed = hits.groupBy("origin", "doc_id").agg(F.round(F.sum(F.col("score") * F.when(F.col("n") == 0, 1.0).otherwise(0.8)), 9).alias("score"))
        return search.ranked(summed.withColumnRenamed("origin", "query_id"), ["query_id"], "score", "doc_id", k)

    def corrective(self, questions: DataFrame, k: int = 5, attempts: int = 2) -> DataFrame:
        """Relevant hits (0.7 or more by the scorer); questions without any are put again with a suffix, up to
        ``attempts`` times, and give their best hits in the end."""
        out, asked = None, questions.select("query_id", "q")
        for attempt in range(attempts + 1):
            judged = cut(self.rerank(asked, self.hybrid(asked, 2 * k), 2 * k))
            good = judged if attempt == attempts else judged.where(F.col("score") >= RELEVANT)
            out = good if out is None else out.unionByName(good)
            if attempt < attempts:
                left = asked.join(good.select("query_id").distinct(), "query_id", "left_anti")
                asked = cut(left.withColumn("q", F.concat("q", F.lit(" detalhes exemplos"))))
        return out.where(F.col("rank") <= k)

    def decompose(self, questions: DataFrame) -> DataFrame:
        """Parts of each question, split at conjunctions and marks: ``query_id``, ``part``, ``q``."""
        parts = F.filter(F.split("q", r"(?i)\s+(?:e|and|y)\s+|[;?]\s*"), lambda x: F.length(F.trim(x)) > 3)
        return questions.select("query_id", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array("q"))).alias("part", "q"))

    def decomposed(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """Hits of the parts put together; a hit of several parts counts more (0.2 for each further one)."""
        parts, of = self._apart(self.decompose(questions).withColumnRenamed("query_id", "origin"))
        hits = self.hybrid(parts, k).join(of, "query_id")
        grouped = hits.groupBy("origin", "doc_id").agg(F.max("score").alias("best"), F.countDistinct("query_id").alias("n"))
        scored = grouped.select(F.col("origin").alias("query_id"), "doc_id", F.round(F.col("best") * (1 + 0.2 * (F.col("n") - 1)), 12).alias("score"))
        return search.ranked(scored, ["query_id"], "score", "doc_id", k)

    def hypothetical(self, questions: DataFrame, k: int = 10, least: float = 0.3) -> DataFrame:
        """Dense search by the mean of vectors of hypothetical answers that stay close to the question."""
        from retrix.functions import vectors as V

        drafts = F.array(F.col("q"), F.concat(F.lit("Resposta: "), "q"), F.concat("q", F.lit(" Exemplo e detalhes.")))
        rows = questions.select("query_id", "q", F.explode(drafts).alias("draft")).select("query_id", models.embed(F.col("q"), self.embedder).alias("v"), models.embed(F.col("draft"), self.embedder).alias("d"))
        near = rows.where(V.cosine(F.col("v"), F.col("d")) >= least)
        mean = near.groupBy("query_id").agg(V.combine(F.collect_list("d")).alias("v"))
        return search.top_cosine(self.vectors(), "doc_id", "vector", mean, "query_id", "v", k)

    def adaptive(self, questions: DataFrame) -> DataFrame:
        """As many hits as a question's type and complexity call for, lists, definitions and blocks of code raised."""
        kind = Q.question_type(F.col("q"))
        plan = questions.select("query_id", "q", kind.alias("kind"), Q.optimal_k(kind, Q.complexity(F.col("q"))).alias("k"))
        held = self.hybrid(questions, 15).join(self.documents, "doc_id").join(plan.drop("q"), "query_id")
        bullets = F.col("content").rlike(r"(?m)^\s*(?:[-*]|\d+\.)\s")
        defines = F.col("content").rlike(r"^[^.]+\s(?:é|são|is|are|es|son)\s")
        blocks = F.regexp_count("content", F.lit(r"```[\s\S]*?```"))
        boost = F.when((F.col("kind") == "list") & bullets, 1.2).when((F.col("kind") == "definition") & defines, 1.3).when((F.col("kind") == "implementation") & (blocks > 0), 1.1 + 0.1 * blocks).otherwise(1.0)
        scored = held.select("query_id", "doc_id", "k", "kind", F.round(F.col("score") * boost, 12).alias("score"))
        return search.ranked(scored, ["query_id"], "score", "doc_id", 15).where(F.col("rank") <= F.col("k"))

    def route(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Each question by the strategy of its class: simple directly, single_hop hybrid, multi_hop in parts, complex corrected."""
        kind = cut(questions.select("query_id", "q", Q.route_class(F.col("q")).alias("kind")))
        of = lambda name: kind.where(F.col("kind") == name).select("query_id", "q")
        branches = {"simple": self.sparse(of("simple"), k), "single_hop": self.hybrid(of("single_hop"), k), "multi_hop": self.decomposed(of("multi_hop"), k), "complex": self.corrective(of("complex"), k)}
        out = None
        for name, hits in branches.items():
            one = hits.select("query_id", "doc_id", "score", "rank", F.lit(name).alias("route"))
            out = one if out is None else out.unionByName(one)
        return out

    def by_entities(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Texts that share the entities of a question: each entity counts by how few texts have it. Questions without
        entities have no hits."""
        named = questions.select("query_id", F.explode(F.transform(X.entities(F.col("q")), F.lower)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
        texts = self.documents.where("content IS NOT NULL").select("doc_id", F.array_distinct(F.transform(X.entities(F.col("content")), F.lower)).alias("terms")).where("size(terms) > 0")
        held = cut(texts.groupBy("doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms")))
        spread = held.select(F.explode("terms").alias("term")).groupBy("term").agg((1 / F.log(F.lit(2.0) + F.count(F.lit(1)))).alias("w"), F.count(F.lit(1)).alias("df"))
        if blocks.many(questions):
            terms = blocks.vocabulary(spread.join(named.select("term").distinct(), "term").select("term", "df", F.col("w").alias("weight")), held.count())
            if terms is not None:
                asked = questions.select("query_id", F.transform(X.entities(F.col("q")), F.lower).alias("ts"))
                numbered = cut(terms.numbered(held.select("doc_id", "terms", F.transform("terms", lambda _: F.lit(1.0)).alias("vs")), "terms", "vs"))
                return blocks.found(terms.numbered(asked, "ts"), k, None, numbered, terms)
        asked = cut(named.join(spread, "term").select("query_id", "term", (F.col("n") * F.col("w")).alias("weight")))
        if search.sendable(asked):
            return search.top_sums(held.withColumn("values", F.transform("terms", lambda _: F.lit(1.0))), asked, k)
        scored = held.select("doc_id", F.explode("terms").alias("term")).join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 9).alias("score"))
        return search.ranked(scored, ["query_id"], "score", "doc_id", k)

    def heads(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Dense hits of the question's vector through each head's matrix, by a weighted vote."""
        from retrix.functions import vectors as V

        asked = questions.select("query_id", models.embed(F.col("q"), self.embedder).alias("v"))
        turned = V.head_projections(F.col("v"))
        rows = asked.select(F.col("query_id").alias("origin"), F.explode(F.array(*(F.struct(F.lit(name).alias("head"), p.alias("v")) for name, p in turned.items()))).alias("h"))
        held = cut(rows.select("origin", "h.head", "h.v").withColumn("query_id", F.monotonically_increasing_id()))
        near = blocks.found(held.select("query_id", F.col("v").alias("vector")), k, self.vectors()) if blocks.many(held) else search.top_cosine(self.vectors(), "doc_id", "vector", held, "query_id", "v", k)
        hits = near.join(held.select("query_id", "origin", "head"), "query_id")
        weight = F.create_map(*(x for name, w in HEADS.items() for x in (F.lit(name), F.lit(w))))[F.col("head")]
        summed = hits.groupBy(F.col("origin").alias("query_id"), "doc_id").agg(F.round(F.sum(F.col("score") * weight) / len(HEADS), 9).alias("score"))
        return search.ranked(summed, ["query_id"], "score", "doc_id", k)

    def execute(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Each question by all strategies its router chose (up to three): ``query_id``, ``strategy``, ``doc_id``, ``score``,
        ``rank``. Every strategy runs once, for all the questions that want it, and its hits are written before the next
        one runs: what it shuffled is gone by then."""
        q = F.col("q")
        chosen = Q.strategies(Q.route_class(q), Q.contains_any(Q.lower(q), list(Q.TEMPORAL_WORDS)), Q.ambiguity(q))
        wanted = cut(questions.where("q IS NOT NULL").select("query_id", "q", F.explode(chosen).alias("strategy")))
        run = {"direct": self.sparse, "standard": self.hybrid, "multi_query": self.multi_query, "graph": self.by_entities, "multi_head": self.heads, "corrective": self.corrective}
        of = lambda name: wanted.where(F.col("strategy") == name).select("query_id", "q")
        # the standard hits of a question with variations are those of the first of them: it is searched once
        varied = cut(self._variations(of("multi_query"), k))
        first = varied.where("n = 0").select(F.col("origin").alias("query_id"), "doc_id", "score", "rank").join(of("standard").select("query_id"), "query_id", "left_semi")
        rest = of("standard").join(of("multi_query"), "query_id", "left_anti")
        run |= {"standard": lambda _, k: first.unionByName(self.hybrid(rest, k)), "multi_query": lambda _, k: self._varied(varied, k)}
        out = None
        for name, branch in run.items():
            one = cut(branch(of(name), k).select("query_id", F.lit(name).alias("strategy"), "doc_id", "score", "rank"))
            out = one if out is None else out.unionByName(one)
        return out

    def by_tree(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """The nodes of the hierarchical index, of all its levels, that are most similar to each question; those of the
        lowest level are texts: ``query_id``, ``doc_id``, ``score``, ``rank``, ``level``."""
        if "tree" not in self._held:
            points = self.vectors().join(self.documents.select("doc_id", X.token_estimate(F.col("content")).alias("tokens")), "doc_id")
            self._held["tree"] = cut(tree.build(points.select(F.col("doc_id").alias("id"), "vector", "tokens")))
        nodes = self._held["tree"]
        asked = questions.select("query_id", models.embed(F.col("q"), self.embedder).alias("v"))
        return search.top_cosine(nodes, "node", "vector", asked, "query_id", "v", k).join(nodes.select(F.col("node").alias("doc_id"), "level"), "doc_id")

    def retrieve(self, questions: DataFrame, k: int = 5, method: str = "hybrid") -> DataFrame:
        """Hits by a named method: raptor (the hierarchical index), enhanced_corrective, hybrid (half of them from the
        hierarchical index, half from the basic search, by score), and the basic search for any other name."""
        columns = ["query_id", "doc_id", "score", "rank"]
        if method == "raptor":
            return self.by_tree(questions, k).select(*columns)
        if method == "enhanced_corrective":
            return self.corrective(questions, k).select(*columns)
        if method == "hybrid":
            both = self.by_tree(questions, k // 2).select("query_id", "doc_id", "score").unionByName(self.dense(questions, k // 2).select("query_id", "doc_id", "score"))
            return search.ranked(both.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), ["query_id"], "score", "doc_id", k)
        return self.dense(questions, k).select(*columns)

    def combined(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """The hits of a question's strategies together: a text is there once, with its best place and all strategies that
        found it, those with the best places first."""
        found = self.execute(questions, k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("best"), F.sort_array(F.collect_set("strategy")).alias("strategies"))
        return search.ranked(found.withColumn("score", F.size("strategies") - F.col("best")), ["query_id"], "score", "doc_id", k).select("query_id", "doc_id", "strategies", "rank")

    def context(self, hits: DataFrame, size: int = 5, characters: int = 500) -> DataFrame:
        """Numbered contents of each question's best hits as one text: ``query_id``, ``context``."""
        best = hits.where(F.col("rank") <= size).join(self.documents, "doc_id")
        line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("content", 1, characters)).alias("line")
        lines = best.select("query_id", "rank", line).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("l"))
        return lines.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("context"))

    def answer(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """Routes, gathers context and lets the generator answer: ``query_id``, ``answer``, ``sources``, ``confidence``."""
        hits = cut(self.route(questions, k))
        found = hits.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("sources"), F.count(F.lit(1)).alias("n"))
        prompt = F.concat_ws("\n\n", F.lit("Responda com base no contexto."), "context", F.concat(F.lit("Pergunta: "), F.col("q")))
        base = questions.join(self.context(hits, k), "query_id", "left").join(found, "query_id", "left")
        confidence = F.least(F.lit(1.0), F.lit(0.5) + F.when(F.col("n") > 3, 0.2).otherwise(0.0) + F.when(F.length("context") > 200, 0.1).otherwise(0.0))
        return base.select("query_id", models.generate(prompt, self.generator).alias("answer"), F.coalesce("sources", F.array().cast("array<long>")).alias("sources"), F.round(confidence, 6).alias("confidence"))
