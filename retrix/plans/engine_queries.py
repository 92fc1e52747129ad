"""Queries that run the engine over all documents, for the stated questions or for every cached one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrix.operators import models
from retrix.plans.engine import Engine
from retrix.plans.registry import query
from retrix.plans.text_queries import asked_queries, every_question
from retrix.sources.tables import table


def _engine(spark: SparkSession, directory: str) -> Engine:
    return Engine(table(spark, directory, "documents").select("doc_id", F.col("text").alias("content")))


@query()
def engine_route(spark: SparkSession, directory: str) -> DataFrame:
    """Each question by the strategy of its class."""
    return _engine(spark, directory).route(asked_queries(spark, directory))


@query()
def engine_answer(spark: SparkSession, directory: str) -> DataFrame:
    """Answers with sources and confidence."""
    return _engine(spark, directory).answer(asked_queries(spark, directory))


@query()
def engine_multi_query(spark: SparkSession, directory: str) -> DataFrame:
    """Hits of every cached question and its variations."""
    return _engine(spark, directory).multi_query(every_question(spark, directory))


@query()
def engine_corrective(spark: SparkSession, directory: str) -> DataFrame:
    """Hits that are relevant, after putting questions again where there were none."""
    return _engine(spark, directory).corrective(asked_queries(spark, directory))


@query()
def engine_decomposed(spark: SparkSession, directory: str) -> DataFrame:
    """Hits of the parts of questions."""
    return _engine(spark, directory).decomposed(asked_queries(spark, directory))


@query()
def engine_hypothetical(spark: SparkSession, directory: str) -> DataFrame:
    """Hits of hypothetical answers."""
    return _engine(spark, directory).hypothetical(asked_queries(spark, directory))


@query()
def engine_adaptive(spark: SparkSession, directory: str) -> DataFrame:
    """As many hits as each question calls for."""
    return _engine(spark, directory).adaptive(asked_queries(spark, directory))


@query()
def engine_execute(spark: SparkSession, directory: str) -> DataFrame:
    """Hits of each of the strategies that the router chose, for every cached question."""
    return _engine(spark, directory).execute(every_question(spark, directory))


@query()
def engine_retrieve(spark: SparkSession, directory: str) -> DataFrame:
    """Hits half from the hierarchical index and half from the basic search."""
    return _engine(spark, directory).retrieve(asked_queries(spark, directory), 6)


@query()
def engine_combined(spark: SparkSession, directory: str) -> DataFrame:
    """The hits of every cached question's strategies put together."""
    found = _engine(spark, directory).combined(every_question(spark, directory))
    return found.withColumn("strategies", F.array_join("strategies", ","))


@query()
def engine_rerank(spark: SparkSession, directory: str) -> DataFrame:
    """Hybrid hits in the order of a second judgement."""
    engine, asked = _engine(spark, directory), asked_queries(spark, directory)
    return engine.rerank(asked, engine.hybrid(asked))


@query()
def embedded_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Length of every document's vector by the default embedder."""
    docs = table(spark, directory, "documents")
    vector = models.embed(F.col("text"))
    return docs.select("doc_id", F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))
