"""Long texts are read in blocks and through a rolling table; boundaries in the lower half are used."""

from __future__ import annotations

import random
import tracemalloc

import pytest

from retrix.llm import split

PARTS = ["a", "b", " ", "\n", "\n\n", ". ", "! ", "\r\n", "é", "👨‍👩", "🇧🇷", "。", "word ", '")', "́"]


@pytest.mark.parametrize("block", [5, 17, 50])
def test_blocks_change_no_strength(monkeypatch, block):
    own = random.Random(block)
    for _ in range(800):
        text = "".join(own.choices(PARTS, k=own.randint(0, 300)))
        whole = split.strengths(text)
        with monkeypatch.context() as changed:
            changed.setattr(split, "BLOCK", block)
            assert (split.strengths(text) == whole).all()


def test_a_word_end_in_the_lower_half_is_taken():
    text = "ab cd " + "x" * 200
    assert split.cut_points(text, 40, 0)[0] == (0, 6)


def test_memory_does_not_grow_with_levels_of_the_table():
    text = "palavra comum. outra " * 200_000
    tracemalloc.start()
    pieces = split.cut_points(text, 1500, 100)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert pieces[-1][1] == len(text) and peak < 12 * len(text)
