"""Search for many questions: blocks of questions walk through the written texts.

A task holds a block of questions with the best hits of each and reads the written tables of vectors and of terms from the
folder all executors share, BATCH rows at a time: neither pairs of questions and texts nor single lists of hits are
written or shuffled, only what comes out of their fusion. The work still grows with the product of both.

Vectors: products in single precision give the greatest of each group of GROUP rows; only groups that can hold one of the
k best, errors of rounding allowed for, are looked at in double precision. Terms: numbered from those of most texts to
those of fewest; questions that share the frequent ones (more than 1 / RARE of the texts) share their sums, put together
along the paths of a trie, and only texts with a rarer term are summed up for a question of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from retrix.operators import models, search
from retrix.operators.fusion import RRF_K
from retrix.sources.tables import cut, folder_of

#: Questions from which they are searched in blocks, and those of a block; rows of a table that a task holds at once.
MANY, BLOCK, BATCH = 2000, 8192, 1 << 15
#: Rows whose greatest product is taken together; questions, and rows, of one product; pairs that are looked at at once.
GROUP, ASKING, ROWS, LOOKED = 16, 256, 16_384, 4096
#: Questions whose lists of texts are put together at once.
MERGED = 2048
#: A term is rare in fewer than 1 / RARE of the texts, or in FEW.
RARE, FEW = 200, 50
NO_KEY = np.iinfo(np.int64).min  # a null id, which comes first among equals


def many(questions: DataFrame) -> bool:
    return questions.limit(MANY + 1).count() > MANY


@dataclass(frozen=True)
class Vocabulary:
    """The terms that questions ask for, by falling number of texts, with their weights; the first ``common`` are frequent."""

    sent: Broadcast
    common: int

    def numbered(self, rows: DataFrame, terms: str, values: str | None = None, model: models.Embedder | None = None) -> DataFrame:
        """The array ``terms`` as sorted numbers with ``values``: those of a text, or of a question how often it has each
        term times the term's weight. Terms that nobody asks for are left out. With a model, ``q`` becomes a ``vector``."""
        sent, place = self.sent, rows.columns.index(terms)
        at = rows.columns.index(values) if values else None
        others = [c for c in rows.columns if c not in (terms, values)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, weights = sent.value
            wanted = pa.array(names, pa.string())
            for batch in batches:
                held = batch.column(place)
                number = pa.compute.fill_null(pa.compute.index_in(held.flatten(), value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), pa.compute.fill_null(pa.compute.list_value_length(held), 0).to_numpy(zero_copy_only=False))
                value = np.ones(len(number)) if at is None else batch.column(at).flatten().to_numpy(zero_copy_only=False)
                good = number >= 0
                key, back = np.unique(row[good] * max(len(names), 1) + number[good], return_inverse=True)
                row, number = np.divmod(key, max(len(names), 1))
                value = np.bincount(back, value[good], len(key)).astype(float)
                ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
                value = value if at is not None else value * weights[number]
                out = [batch.column(batch.schema.get_field_index(c)) for c in others] + [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (number.astype(np.int32), value)]
                if model:  # here, not in another worker beside this one
                    vectors = np.asarray(model(pa.compute.fill_null(batch.column(batch.schema.get_field_index("q")), "").to_pylist()), float)
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * (vectors.shape[1] if len(vectors) else 0), pa.int32()), pa.array(vectors.ravel())))
                yield pa.RecordBatch.from_arrays(out, names=[*others, "terms", "values", *(["vector"] if model else [])])

        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
        return rows.mapInArrow(run, f"{kinds}, terms array<int>, values array<double>" + (", vector array<double>" if model else ""))


def vocabulary(asked: DataFrame, texts: int) -> Vocabulary | None:
    """Of the terms asked for (``term``, ``df``, ``weight``; each once), if they are few enough to be sent."""
    asked = cut(asked)
    if not search.sendable(asked):
        return None
    held = sorted((-r["df"], r["term"], r["weight"]) for r in asked.collect())  # bounded by SENT
    sent = asked.sparkSession.sparkContext.broadcast(([t for _, t, _ in held], np.array([w for _, _, w in held], float)))
    return Vocabulary(sent, sum(-n > max(FEW, texts / RARE) for n, _, _ in held))


def _best(who: np.ndarray, key: np.ndarray, score: np.ndarray, k: int, digits: int = search.ROUND) -> tuple[np.ndarray, ...]:
    """The k rows of each question with the greatest rounded score, then the smallest key, and their places."""
    order = np.lexsort((key, -np.round(score, digits), who))
    who, key, score = who[order], key[order], score[order]
    first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))[: len(who)]
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who)))) + 1
    good = rank <= k
    return who[good], key[good], score[good], rank[good]


def _nothing() -> tuple[np.ndarray, ...]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)


def _read(folder: str, columns: list[str]) -> Iterator[pa.Table]:
    """A written table, about BATCH rows at a time."""
    import pyarrow.dataset as dataset
    from pyarrow import fs

    place = urlparse(folder)
    system, path = (fs.LocalFileSystem(), place.path) if place.scheme in ("", "file") else fs.FileSystem.from_uri(folder)
    waiting, rows = [], 0
    for batch in dataset.dataset(path, filesystem=system, format="parquet").to_batches(columns=columns, batch_size=BATCH // 4, batch_readahead=1, fragment_readahead=1, use_threads=False):
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _nearest(folder: str, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k rows of greatest cosine of each question's vector."""
    dimension, state, size = vectors.shape[1], _nothing(), np.sqrt((vectors**2).sum(axis=1))
    unit = np.divide(vectors, size[:, None], out=np.zeros_like(vectors), where=size[:, None] > 0).astype(np.float32)
    error = 2 * (dimension + 8) * 2.0**-23
    for table in _read(folder, ["doc_id", "vector"]):
        held, keys = _whole(table["vector"]), _whole(table["doc_id"])
        fits = pa.compute.fill_null(pa.compute.and_(pa.compute.equal(pa.compute.list_value_length(held), dimension), pa.compute.is_valid(keys)), False)
        held, keys = held.filter(fits), keys.filter(fits).to_numpy().astype(np.int64)
        rows = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
        good = ~np.isnan(rows).any(axis=1)
        rows, keys = rows[good], keys[good]
        if not len(keys):
            continue
        length = np.sqrt((rows**2).sum(axis=1))
        some = np.divide(rows, length[:, None], out=np.zeros_like(rows), where=length[:, None] > 0).astype(np.float32)
        some = np.concatenate([some, np.repeat(some[-1:], -len(some) % GROUP, axis=0)]).reshape(-1, GROUP, dimension)
        least = np.full(len(vectors), -np.inf)
        least[state[0][state[3] == k]] = state[2][state[3] == k]
        found = [state[:3]]
        for at in range(0, len(vectors), ASKING):
            asks = np.flatnonzero(size[at : at + ASKING] > 0) + at
            if not len(asks):
                continue
            step, parts = ROWS // GROUP, []
            for low in range(0, len(some), step):
                part = np.ascontiguousarray(some[low : low + step].transpose(1, 0, 2)).reshape(-1, dimension)
                parts.append((unit[asks] @ part.T).reshape(len(asks), GROUP, -1).max(axis=1))
            most = np.concatenate(parts, axis=1)
            floor = least[asks]
            if most.shape[1] > k:
                floor = np.maximum(floor, np.partition(most, most.shape[1] - k, axis=1)[:, -k])
            floor = floor - error - 2 * 10.0**-search.ROUND
            who, group = np.nonzero(most >= floor[:, None])
            for low in range(0, len(who), LOOKED):
                w, g = who[low : low + LOOKED], group[low : low + LOOKED]
                near = np.matmul(some[g], unit[asks[w]][:, :, None])[:, :, 0] >= floor[w][:, None]
                n, place = np.nonzero(near)
                q, row = asks[w[n]], g[n] * GROUP + place
                q, row = q[row < len(keys)], row[row < len(keys)]
                over = size[q] * length[row]
                value = np.divide(np.einsum("ij,ij->i", vectors[q], rows[row]), over, out=np.zeros(len(q)), where=over > 0)
                found.append((q, keys[row], np.round(value, search.ROUND)))
            if sum(len(x[0]) for x in found[1:]) > max(len(found[0][0]), search.AT_ONCE // 4):
                found = [_best(*map(np.concatenate, zip(*found)), k)[:3]]
        none = np.flatnonzero(size == 0)  # every row scores 0
        if len(none):
            first = np.sort(keys)[:k]
            found.append((np.repeat(none, len(first)), np.tile(first, len(none)), np.zeros(len(none) * len(first))))
        state = _best(*map(np.concatenate, zip(*found)), k)
    return state


def _leading(sums: np.ndarray, keys: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the greatest sums above 0, in order."""
    groups, floor = len(sums) // GROUP, 0.0
    if groups > count:
        most = sums[: groups * GROUP].reshape(GROUP, groups).max(axis=0)
        floor = np.partition(most, groups - count)[groups - count]
    place = np.flatnonzero(sums >= max(floor - 2 * 10.0**-search.ROUND, np.finfo(float).tiny))
    value = sums[place]
    order = np.lexsort((keys[place], -np.round(value, search.ROUND)))[:count]
    return place[order], value[order]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one run after another."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _greatest(folder: str, terms: list[list[int]], weights: list[list[float]], common: int, size: int, k: int) -> tuple[np.ndarray, ...]:
    """The k texts with the greatest sum of weight times value of each question; sums of 0 are no hits."""
    often = [tuple((t, w) for t, w in zip(*x) if t < common) for x in zip(terms, weights)]
    order = sorted(range(len(terms)), key=often.__getitem__)
    cuts = [n for n in range(len(order)) if not n or often[order[n]] != often[order[n - 1]]]
    seldom = [(n, t, w) for n, q in enumerate(order) for t, w in zip(terms[q], weights[q]) if t >= common]
    seldom_q, seldom_t, seldom_w = np.array([x[0] for x in seldom], np.int64), np.array([x[1] for x in seldom], np.int64), np.array([x[2] for x in seldom], float)
    state = _nothing()
    for table in _read(folder, ["doc_id", "terms", "values"]):
        held, values = _whole(table["terms"]), _whole(table["values"])
        keys = pa.compute.fill_null(_whole(table["doc_id"]), NO_KEY).to_numpy().astype(np.int64)
        n = len(keys)
        text = np.repeat(np.arange(n, dtype=np.int32), pa.compute.list_value_length(held).to_numpy(zero_copy_only=False))
        term, value = held.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
        by_term = np.argsort(term, kind="stable")
        term, text, value = term[by_term], text[by_term], value[by_term]
        del by_term, held, values, table
        starts = np.searchsorted(term, np.arange(size + 1))
        lengths = starts[seldom_t + 1] - starts[seldom_t]
        run = _runs(starts[seldom_t], lengths)
        own, back = np.unique(np.repeat(seldom_q, lengths) * n + text[run], return_inverse=True)
        own_sum = np.bincount(back, np.repeat(seldom_w, lengths) * value[run], len(own)).astype(float)  # of nothing it counts in whole numbers
        own_q, own_text = np.divmod(own, n)
        of = np.searchsorted(own_q, np.arange(len(order) + 1))
        path: list[tuple] = []
        lists, counts = [], []
        for low, high in zip(cuts, [*cuts[1:], len(order)]):
            wanted = often[order[low]]
            shared = 0
            while shared < min(len(path), len(wanted)) and path[shared][0] == wanted[shared]:
                shared += 1
            del path[shared:]
            for t, w in wanted[shared:]:
                sums = path[-1][1].copy() if path else np.zeros(n)
                a, b = starts[t], starts[t + 1]
                sums[text[a:b]] += w * value[a:b]
                path.append(((t, w), sums))
            if path:
                sums = path[-1][1]
                own_sum[of[low] : of[high]] += sums[own_text[of[low] : of[high]]]
                lists.append(_leading(sums, keys, k + int(np.diff(of[low : high + 1]).max())))
            else:
                lists.append((np.zeros(0, np.int64), np.zeros(0)))
            counts.append(high - low)
        ends = np.cumsum([len(x[0]) for x in lists])
        length = np.repeat(np.diff(np.append(0, ends)), counts)
        length = np.minimum(length, k + np.diff(of))  # texts that are summed up for the question come on top
        start = np.repeat(np.append(0, ends)[:-1], counts)
        places, sums = (np.concatenate(x) for x in zip(*lists))
        hit, merged = own_sum > 0, []
        for low in range(0, len(order), MERGED):
            high = min(low + MERGED, len(order))
            run = _runs(start[low:high], length[low:high])
            who, place, value = np.repeat(np.arange(low, high), length[low:high]), places[run], sums[run]
            a, b = of[low], of[high]
            if a < b:
                both = who * n + place
                apart = own[a:b][np.minimum(np.searchsorted(own[a:b], both), b - a - 1)] != both
                who, place, value = who[apart], place[apart], value[apart]
            c, d = np.searchsorted(state[0], [low, high])
            good = np.flatnonzero(hit[a:b]) + a
            merged.append(_best(*map(np.concatenate, ((state[0][c:d], own_q[good], who), (state[1][c:d], keys[own_text[good]], keys[place]), (state[2][c:d], own_sum[good], value))), k))
        state = tuple(map(np.concatenate, zip(*merged)))
    number = np.array(order, np.int64)[state[0]]
    back = np.lexsort((state[3], number))
    return number[back], state[1][back], state[2][back], state[3][back]


def _fused(near: tuple[np.ndarray, ...], lexical: tuple[np.ndarray, ...], questions: int, k: int) -> tuple[np.ndarray, ...]:
    """As fusion.reciprocal_rank does it."""
    if not len(near[0]) + len(lexical[0]):
        return _nothing()
    codes = np.unique(np.concatenate([near[1], lexical[1]]), return_inverse=True)[1]
    left, right = (x[0] * (codes.max() + 1) + c for x, c in ((near, codes[: len(near[0])]), (lexical, codes[len(near[0]) :])))
    order = np.argsort(right)  # a question's lexical hits are different texts; rows of one id are as many hits among the nearest
    at = order[np.minimum(np.searchsorted(right, left, sorter=order), len(right) - 1)] if len(right) else np.zeros(len(left), np.int64)
    met = right[at] == left if len(right) else np.zeros(len(left), bool)
    alone = ~np.isin(right, left)
    who, key = (np.concatenate([near[n], lexical[n][alone]]) for n in (0, 1))
    rank = np.zeros((2, len(who)), np.int64)
    rank[0, : len(left)], rank[1, len(left) :] = near[3], lexical[3][alone]
    rank[1, : len(left)][met] = lexical[3][at[met]]
    missing = [np.bincount(x[0], minlength=questions)[who] + 1 for x in (near, lexical)]
    score = sum(1.0 / (RRF_K + np.where(r > 0, r, m)) for r, m in zip(rank, missing))
    return _best(who, key, score, k, 12)


def found(asked: DataFrame, k: int, vectors: DataFrame | None = None, texts: DataFrame | None = None, terms: Vocabulary | None = None, each: int = 50) -> DataFrame:
    """The k best hits of each question (``query_id``, ``vector`` and/or ``terms`` and ``values`` as numbered): of one
    written table, or the ``each`` best of both fused by reciprocal rank. ``query_id``, ``doc_id``, ``score``, ``rank``."""
    asked = cut(asked)
    kind, cores = asked.schema["query_id"].dataType, asked.sparkSession.sparkContext.defaultParallelism
    parts = -(-max(1, asked.count()) // BLOCK)
    parts = -(-parts // cores) * cores
    near_in, terms_in = (folder_of(x) if x is not None else None for x in (vectors, texts))
    common, sent = (terms.common, terms.sent) if terms else (0, None)

    def search_block(block: pa.Table) -> pa.RecordBatch:
        near = lexical = None
        if near_in:
            column = _whole(block["vector"])
            held = column.flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
            named = np.flatnonzero(_whole(block["query_id"]).is_valid().to_numpy(zero_copy_only=False))
            who, *rest = _nearest(near_in, held[named], each if terms_in else k)
            near = (named[who], *rest)
        if terms_in:
            lexical = _greatest(terms_in, block["terms"].to_pylist(), block["values"].to_pylist(), common, len(sent.value[0]), each if near_in else k)
        who, key, score, rank = _fused(near, lexical, len(block), k) if near_in and terms_in else near or lexical
        ids = _whole(block["query_id"]).take(pa.array(who))
        return pa.RecordBatch.from_arrays([ids.cast(to_arrow_type(kind)), pa.array(key, mask=key == NO_KEY), pa.array(score), pa.array(rank, pa.int32())], names=["query_id", "doc_id", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                if rows + part.num_rows > BLOCK and waiting:
                    yield search_block(pa.Table.from_batches(waiting).combine_chunks())
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if rows:
            yield search_block(pa.Table.from_batches(waiting).combine_chunks())
        pa.default_memory_pool().release_unused()

    placed = asked.repartitionByRange(parts, "terms", "query_id") if terms_in else asked.repartition(parts, "query_id")
    hits = placed.mapInArrow(run, f"query_id {kind.simpleString()}, doc_id long, score double, rank int")
    return hits.withColumn("score", F.round("score", 12 if near_in and terms_in else search.ROUND))
