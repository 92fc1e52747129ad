"""The prefix-tree join against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from retrix.llm import similar

WORD = re.compile(r"[^\W_]+")


def brute(rows, threshold=0.8):
    bags = {k: Counter(WORD.findall(t.lower())) for k, t in rows if t}
    bags = {k: b for k, b in bags.items() if b}
    out = set()
    for a in bags:
        for b in bags:
            if a < b:
                low, high = (bags[a] & bags[b]).total(), (bags[a] | bags[b]).total()
                if low / high >= threshold:
                    out.add((a, b))
    return out


def corpus(seed, n=260):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)] + [str(i) for i in range(60)]
    rows = []
    for k in range(n):
        if rows and random.random() < 0.6:
            words = rows[random.randrange(len(rows))][1].split()
            for _ in range(random.randint(0, max(1, len(words) // 5))):
                place = random.randrange(len(words) + 1)
                if random.random() < 0.5 and len(words) > 1:
                    words.pop(min(place, len(words) - 1))
                else:
                    words.insert(place, random.choice(vocabulary))
            random.shuffle(words)
        else:
            words = random.choices(vocabulary, k=random.choice([1, 3, 8, 30, 90, 200, 320]))
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "limit"), [(1, 20_000), (2, 3)])
def test_pairs_are_those_of_brute_force(spark, seed, limit):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "k long, t string")
    assert {tuple(r) for r in similar.similar_pairs(df, "k", "t", trie=similar.Trie(limit=limit)).collect()} == brute(rows)


def test_nodes_that_stay_hot_are_split_into_blocks(spark):
    """Sets of few words that nearly all of them have: hot at every depth, or from the second level on."""
    own = random.Random(9)
    rows = [(k, " ".join(own.choices("a b c d e f g h".split(), weights=[9, 8, 7, 6, 5, 1, 1, 1], k=own.randint(3, 24)))) for k in range(220)]
    df = spark.createDataFrame(rows, "k long, t string")
    for depth in (1, 2, 4):
        assert {tuple(r) for r in similar.similar_pairs(df, "k", "t", trie=similar.Trie(limit=9, depth=depth)).collect()} == brute(rows)


@pytest.mark.parametrize(("seed", "leaf", "down", "limit"), [(4, 1, 3, 10**6), (5, 3, 1, 10**6), (6, 2, 3, 40), (7, 1, 2, 5)])
def test_pairs_are_those_of_brute_force_down_the_trie(spark, seed, leaf, down, limit):
    rows = corpus(seed)
    own = random.Random(seed)
    rows += [(1000 + k, " ".join(own.choices("a b c d e f".split(), k=own.randint(1, 9)))) for k in range(60)]  # small sets of common words
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    assert {tuple(r) for r in similar.similar_pairs(df, "k", "t", trie=similar.Trie(limit=limit, leaf=leaf, down=down)).collect()} == brute(rows)


def test_sets_go_down_to_the_elements_that_can_be_next():
    """Two sets share what comes next, a third nothing: only the two are left together."""
    import numpy as np

    n, need = 10, 8
    rest = [np.array(x, dtype=np.uint16).tobytes() for x in ([7, 8, 9, 10, 11], [7, 8, 9, 10, 12], [20, 21, 22, 23, 24])]
    node = {k: np.arange(3) for k in ("c1", "c2", "b0", "b1", "before")} | {"path": np.zeros(3, np.int64), "size": np.full(3, n << 32), "depth": np.ones(3, np.int64), "more": np.zeros((3, similar.LONG), np.uint64)}
    node["rest"] = np.empty(3, dtype=object)
    node["rest"][:] = rest
    out = similar._down(node, 4, 5, similar.Trie(leaf=1))
    assert set(out["c1"].tolist()) == {0, 1} and (out["size"] >> 32 == n).all() and ((out["size"] & 0xFFFFFFFF) <= n - need).all()


def test_links_count_pairs_without_expanding_copies(spark):
    rows = corpus(3) + [(1000 + k, "a b c d e f g h i j") for k in range(40)] + [(2000, "a b c d e f g h i k")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(4)
    pairs = brute(rows)
    links = {r["id"]: r["n_links"] for r in similar.similar_links(df, "k", "t").collect()}
    assert all(links[k] == sum(k in p for p in pairs) for k in links)


def test_order_and_repeats_count_as_multisets(spark):
    df = spark.createDataFrame([(1, "a a a b"), (2, "b A a, a!"), (3, "a b"), (4, "_ - !")], "k long, t string")
    assert {tuple(r) for r in similar.similar_pairs(df, "k", "t").collect()} == {(1, 2)}


def test_shingles(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, " ".join(reversed(text.split())))], "k long, t string")
    assert {tuple(r) for r in similar.similar_pairs(df, "k", "t", gram=5).collect()} == {(1, 2)}
