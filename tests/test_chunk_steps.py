"""Overlap, entities and packed sentences of the chunkers."""

from __future__ import annotations

from retrix.operators import chunking as C


def test_hybrid_chunks_share_text():
    first, second = C.hybrid("a" * 900 + "END\n\n" + "b" * 900, 1000, 3)
    assert second == "END " + "b" * 900


def test_entities_hold_chunks_together():
    assert C.STRATEGIES["entity_aware"]("Ana Lima wrote it. We thank Ana Lima. It rains.") == ["Ana Lima wrote it. We thank Ana Lima.", "It rains."]


def test_sentence_packs_share_words():
    found = C.sentence_packs("one two three. four five six. seven eight", tokens=8, overlap=2)
    assert found == ["one two three. four five six.", "five six. seven eight."]


def test_enhanced_semantic_chunks_use_the_mean_and_their_own_size():
    same = "The cache keeps answers."
    assert C.semantic_enhanced(" ".join([same] * 3)) == [" ".join([same] * 3)]
    assert C.semantic_enhanced(" ".join([same] * 30)) == [" ".join([same] * 21), " ".join([same] * 9)]  # 21 * 24 = 504 characters
    assert C.semantic_enhanced("The cache keeps answers. Zebras graze.") == ["The cache keeps answers.", "Zebras graze."]
    assert C.semantic_enhanced("") == []


def test_hybrid_chunks_carry_the_entities_of_their_text(spark):
    rows = [(1, "Ana Lima wrote it.\n\n" + "x" * 1000), (2, None), (3, "")]
    found = C.chunk(spark.createDataFrame(rows, "k long, t string"), "k", "t", "hybrid", entities=True).collect()
    assert [(r["id"], r["pos"], r["entities"]) for r in found] == [(1, 0, ["Ana Lima"]), (1, 1, ["Ana Lima"])]
