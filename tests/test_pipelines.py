"""Expressions and folds behind the pipelines: questions, batches, memory, labels, running sums."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from retrix.functions import questions as Q
from retrix.functions import text as X
from retrix.operators import memory, models, monitor
from retrix.plans.engine import Engine


def test_rewritings_of_questions(spark):
    rows = spark.createDataFrame([(1, "Qual erro na função?"), (2, ""), (3, None), (4, "erro dados")], "k long, q string")
    found = {r["k"]: r for r in rows.select("k", Q.expanded(F.col("q")).alias("e"), Q.replaced(F.col("q")).alias("r"), Q.clauses(F.col("q")).alias("c"), Q.enhanced(F.col("q")).alias("n")).collect()}
    assert found[1]["e"].startswith("Qual erro na função? error bug falha problema")
    assert found[1]["r"] == ["Qual error na função?"] and found[1]["c"] == ["Qual erro na função"]
    assert found[4]["r"] == ["error dados", "erro data"] and found[4]["n"] == ["erro dados", "error dados", "erro data"]
    assert found[2]["e"] == "" and found[2]["r"] == [] and found[3]["e"] is None


def test_variations_are_read_and_filled_up(spark):
    rows = spark.createDataFrame([(1, " 1. primeira variação\n2) segunda variação\n- x\n3 - terceira variação\n4. quarta variação"), (2, "curta. fim"), (3, "")], "k long, r string")
    found = {r["k"]: r["v"] for r in rows.select("k", Q.variations(F.col("r")).alias("v")).collect()}
    assert found[1] == ["primeira variação", "segunda variação", "terceira variação"]
    assert found[2] == ["curta com exemplos práticos", "curta explicação detalhada", "curta casos de uso"] and len(found[3]) == 3


def test_explanations_and_merged_texts(spark):
    one = spark.range(1).select(
        Q.match_explanation(F.lit(0.9), F.lit(0.3), F.array(F.lit("cache"))).alias("a"), Q.match_explanation(F.lit(None).cast("double"), F.lit(0.1), F.array().cast("array<string>")).alias("b"),
        X.merge_context(F.lit("text"), F.lit("3 relations"), F.array(F.lit("x"), F.lit("y"))).alias("c"), X.merge_context(F.lit("text"), F.lit(None).cast("string"), F.array().cast("array<string>")).alias("d"),
        Q.combined_answer(F.array(F.lit("p"), F.lit("q")), F.lit("comparative")).alias("e"),
    ).first()
    assert one["a"] == "Alta similaridade semântica; Match parcial de keywords; Keywords encontradas: cache" and one["b"] == "Match geral"
    assert one["c"] == "text\n\n\n[Contexto do Grafo]\n3 relations\n\nEntidades relacionadas: x, y" and one["d"] == "text"
    assert one["e"] == "Comparando as informações:\n\nPerspectiva 1: p\n\nPerspectiva 2: q"


def test_memory_is_compressed_where_it_gains_and_comes_back_whole(spark):
    noise = "".join(random.Random(1).choices([chr(x) for x in range(33, 127)], k=20_000))
    rows = spark.createDataFrame([(1, "palavra " * 2000), (2, "short"), (3, noise), (4, None), (5, "")], "k long, t string")
    held = rows.select("k", "t", memory.compressed(F.col("t")).alias("c"))
    found = {r["k"]: (r["compressed"], r["back"], r["t"]) for r in held.select("k", "t", "c.compressed", memory.restored(F.col("c")).alias("back")).collect()}
    assert {k for k, x in found.items() if x[0]} == {1} and all(back == t for _, back, t in found.values())


def test_labels_come_from_whole_texts(spark):
    rows = spark.createDataFrame([(1, "x " * 2000 + "paciente médico hospital"), (2, "nada disto"), (3, None), (4, "contrato e lei, preço")], "k long, t string")
    found = {r["k"]: (r["label"], round(r["confidence"], 3)) for r in rows.select("k", models.content_label(F.col("t")).alias("c")).select("k", "c.*").collect()}
    assert found == {1: ("health", 1.0), 2: ("technology", 0.5), 3: ("technology", 0.5), 4: ("legal", 0.667)}
    assert rows.select(models.content_label(F.col("t"), lambda t: ("other", 1.0))["label"].alias("l")).distinct().collect()[0]["l"] == "other"


def test_running_sums_across_parts_are_those_of_one_window(spark):
    own = random.Random(2)
    rows = [(k, own.choice(["a", "b", None]), own.choice([None, 1, 2, 5]), own.randrange(50)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, v long, t long")
    found = {r["id"]: r["s"] for r in monitor.running(df, {"s": F.col("v"), "n": F.lit(1)}, ["g"], F.floor(F.col("t") / 7), ["t", "id"]).collect()}
    expected, sums = {}, {}
    for k, g, v, t in sorted(rows, key=lambda r: (r[3], r[0])):
        sums[g] = sums.get(g, 0) + (v or 0)
        expected[k] = sums[g]
    assert found == expected


def test_parts_of_questions_keep_their_question(spark):
    """A question with more than a hundred parts: none of them runs into another question."""
    docs = spark.createDataFrame([(k, f"assunto{k} detalhe") for k in range(300)], "doc_id long, content string")
    asked = spark.createDataFrame([(1, " e ".join(f"assunto{k}" for k in range(150))), (2, "assunto200 detalhe")], "query_id long, q string")
    hits = Engine(docs).decomposed(asked, 10).collect()
    assert {r["query_id"] for r in hits} == {1, 2} and sum(r["query_id"] == 2 for r in hits) == 10
    assert [r["doc_id"] for r in hits if r["query_id"] == 2 and r["rank"] == 1] == [200]


def test_strategies_of_a_question_are_all_run(spark):
    docs = spark.createDataFrame([(1, "Ana Lima escreve."), (2, "Outro texto sem nomes."), (3, None)], "doc_id long, content string")
    asked = spark.createDataFrame([(1, "Explique a relação entre Ana Lima e Rui Paz"), (2, None)], "query_id long, q string")
    found = {(r["strategy"], r["doc_id"]) for r in Engine(docs).execute(asked, 2).collect()}
    assert {s for s, _ in found} == {"graph", "multi_head"} and ("graph", 1) in found and ("graph", 2) not in found
