"""Neighbours in runs and across parts, limits of length relative to the lengths around, counts over all rows."""

from __future__ import annotations

import random

import numpy as np

from retrix.llm import defects


def test_contexts_are_those_of_the_words_before():
    own = random.Random(4)
    shapes = [[own.randrange(9) for _ in range(own.randint(1, 12))] for _ in range(60)]
    flat = [(k, p) for k, shape in enumerate(shapes) for p in range(len(shape))]
    found, last = defects.contexts(shapes)
    assert [flat[x] for x in last] == [(k, len(shape) - 1) for k, shape in enumerate(shapes)]
    for (n, begun), (keys, at) in zip(defects.KINDS, found):
        expected = {}
        for k, p in flat:
            if p >= max(n - 1, 4 if begun else 0):
                expected[(k, p)] = (tuple(shapes[k][p - n + 1 : p + 1]), tuple(shapes[k][:2]) if begun else ())
        assert [flat[x] for x in at] == list(expected)
        by_key = {}
        for key, context in zip(keys.tolist(), expected.values()):
            assert by_key.setdefault(key, context) == context
        assert len(set(by_key.values())) == len(by_key)


def test_a_run_of_neighbours_is_compared_across_parts(spark):
    rows = ["The cache keeps the newest", "The cache keeps the newest! No.", "The cache keeps the newest (all)", "The cache keeps the newest answers of a week.", "The queue", "Yes", "Another text."]
    rows += [f"The cache keeps the newest. {k}" for k in range(50)]
    texts = spark.createDataFrame([(x,) for x in rows], "answer string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 7, 23):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            assert {r["answer"] for r in defects.shortened_texts(texts).collect()} == {"The cache keeps the newest"}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_length_limits_stand_out_at_every_size(spark):
    for scale in (1, 50):
        own = np.random.default_rng(scale)
        lengths = [int(x) for x in own.integers(20, 400, 100 * scale)] + [256] * (12 * scale)
        found = defects.length_limits(spark.createDataFrame([(x,) for x in lengths], "n int"))
        assert [r["n"] for r in found.collect()] == [256]


def test_endings_are_learnt_from_every_row(spark):
    """One phrase ends sentences, another never does, in a corpus beyond any sample."""
    verbs, things, times = ("reads", "writes", "keeps", "counts", "merges"), ("notes", "pages", "links", "rows"), ("after every deploy", "during the night", "under heavy load")
    own = random.Random(3)
    text = lambda: f"The {own.choice(('cache', 'queue', 'index'))} {own.choice(verbs)} {own.choice(things)} {own.choice(times)}."
    rows = [(k, "What happens at night here?", '{"answer": "' + " ".join(text() for _ in range(3)) + '"}') for k in range(400)]
    odd = [(1000, "The queue reads notes after every", True), (1001, "The index keeps", True), (1002, "The queue reads notes after every deploy", False), (1003, "The cache merges rows during the night", False)]
    df = spark.createDataFrame(rows + [(k, "What happens at night here?", '{"answer": "' + text() + " " + tail + '"}') for k, tail, _ in odd], "i long, q string, r string")
    found = {r["id"]: r["rule"] for r in defects.find_defects(df, "i", "q", "r", with_rule=True).collect()}
    assert found == {k: "masked neighbours" for k, _, cut in odd if cut}
