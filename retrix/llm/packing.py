"""Filling containers of fixed capacity with texts, by lexical retrieval.

The items are spread over shards of bounded size. A shard holds an inverted index of its items' terms with
BM25 weights. The largest unused item is the seed of a container; the index returns its unused neighbours,
which fill the container greedily in order of score, and what room is left goes to the largest unused items
that still fit. Items of poorly filled containers of all shards are put together and packed once more.

Only a text longer than the capacity is split: into full containers and a rest that is an item.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrix.llm.similar import _Codes, _WORD
from retrix.llm.tokens import DEFAULT_VOCABULARY, encoder, ship
from retrix.sources.tables import cut

CAPACITY = 2048
#: Items of one shard, about.
SHARD_ITEMS = 4000
#: BM25 parameters, and the share of a shard's items beyond which a term tells nothing.
K1, B, COMMON_SHARE = 1.2, 0.75, 0.1
#: Containers filled less than this in the first round are packed again.
WELL_FILLED = 0.98
MEMO_WORDS = 1_000_000


class Shard:
    """Inverted index over the terms of a shard's items, with the BM25 weight of each posting."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]):
        n = len(terms)
        self.n = n
        lengths = np.array([c.sum() for c in counts], dtype=np.float64)
        item = np.repeat(np.arange(n), [len(t) for t in terms])
        term = np.concatenate(terms) if n else np.zeros(0, np.uint32)
        count = np.concatenate(counts).astype(np.float64) if n else np.zeros(0)
        names, number, held = np.unique(term, return_inverse=True, return_counts=True)
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if n else 1.0, 1e-9))
        weight = np.log1p((n - held + 0.5) / (held + 0.5))[number] * count * (K1 + 1) / (count + norm[item])
        telling = (held > 1) & (held <= max(2, COMMON_SHARE * n))
        order = np.argsort(number, kind="stable")
        self.posting, self.weight = item[order].astype(np.int64), weight[order]
        self.starts = np.concatenate([[0], np.cumsum(held)])
        self.own = np.split(number, np.cumsum([len(t) for t in terms])[:-1]) if n else []
        self.telling = telling

    def neighbours(self, item: int) -> np.ndarray:
        """Items that share terms with one, best first."""
        own = self.own[item]
        own = own[self.telling[own]]
        if not len(own):
            return np.zeros(0, dtype=np.int64)
        at = np.concatenate([np.arange(self.starts[t], self.starts[t + 1]) for t in own])
        score = np.bincount(self.posting[at], weights=self.weight[at], minlength=self.n)
        score[item] = 0
        found = np.flatnonzero(score > 0)
        return found[np.lexsort((found, -score[found]))]


def pack(sizes: np.ndarray, shard: Shard, capacity: int) -> list[list[int]]:
    """Items by container; every size is at most the capacity."""
    by_size = np.lexsort((np.arange(len(sizes)), sizes))
    held: list[tuple[int, int]] = [(int(sizes[k]), int(k)) for k in by_size]  # unused items, by size
    unused = np.ones(len(sizes), dtype=bool)

    def largest(room: int) -> int | None:
        """The largest unused item that fits."""
        while True:
            at = bisect_right(held, (room, len(sizes))) - 1
            if at < 0:
                return None
            size, item = held[at]
            if unused[item]:
                return item
            del held[at]

    out = []
    while (seed := largest(capacity)) is not None:
        room, inside = capacity - int(sizes[seed]), [seed]
        unused[seed] = False
        if room:
            near = shard.neighbours(seed)
            near = near[unused[near] & (sizes[near] <= room)]
            for item in near.tolist():
                if sizes[item] <= room:
                    inside.append(item)
                    unused[item] = False
                    room -= int(sizes[item])
                    if not room:
                        break
        while room and (item := largest(room)) is not None:
            inside.append(item)
            unused[item] = False
            room -= int(sizes[item])
        out.append(inside)
    return out


def measure(df: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str) -> DataFrame:
    """One row per piece of each text with tokens: ``id``, ``piece``, ``first_token``, ``n_tokens`` and, of the
    last piece, its text's ``terms`` (hashes and counts, packed)."""
    kind = df.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in batches:
            counts, _ = encoder(vocabulary).batch(batch.column(1), ids=False)
            if len(codes) > MEMO_WORDS:
                codes = _Codes()
            row, piece, first, size, terms = [], [], [], [], []
            for k, (text, n) in enumerate(zip(batch.column(1).to_pylist(), counts.tolist())):
                if not n:
                    continue
                start = number = 0
                while n - start > capacity:
                    row.append(k), piece.append(number), first.append(start), size.append(capacity), terms.append(None)
                    start, number = start + capacity, number + 1
                row.append(k), piece.append(number), first.append(start), size.append(n - start)
                if n - start == capacity:
                    terms.append(None)
                    continue
                words = np.fromiter(map(codes.__getitem__, _WORD.findall(text.lower())), dtype=np.int64)
                own, times = np.unique((codes.hashes[words] >> np.uint64(32)).astype(np.uint32), return_counts=True)
                terms.append(own.tobytes() + np.minimum(times, 65535).astype(np.uint16).tobytes())
            ints = [pa.array(x, type=pa.int32()) for x in (piece, first, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, type=pa.int64())), *ints, pa.array(terms, type=pa.binary())], names=["id", "piece", "first_token", "n_tokens", "terms"])

    used = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).where("body is not null and body <> ''")
    return used.mapInArrow(read, f"id {kind}, piece int, first_token int, n_tokens int, terms binary")


def _packed(items: DataFrame, shards: int, capacity: int, name: str) -> DataFrame:
    """The items with their container: a shard's items are together in one task."""
    kind = items.schema["id"].dataType.simpleString()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            packed = [np.frombuffer(x, dtype=np.uint8) for x in whole.column(5).to_pylist()]
            counts = [len(x) // 6 for x in packed]
            terms, times = [x[: 4 * n].view(np.uint32) for x, n in zip(packed, counts)], [x[4 * n :].view(np.uint16) for x, n in zip(packed, counts)]
            sizes = whole.column(4).to_numpy().astype(np.int64)
            row, container, offset, used = [], [], [], []
            for k, inside in enumerate(pack(sizes, Shard(terms, times), capacity)):
                at = 0
                total = int(sizes[inside].sum())
                for item in inside:
                    row.append(item), container.append(f"{name}-{current}-{k}"), offset.append(at), used.append(total)
                    at += int(sizes[item])
            taken = whole.take(pa.array(row, type=pa.int64()))
            columns = [*(taken.column(c) for c in range(1, 6)), pa.array(container, type=pa.string()), pa.array(offset, type=pa.int32()), pa.array(used, type=pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "piece", "first_token", "n_tokens", "terms", "container", "start_at", "used"])

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                if high == low:
                    continue
                if current is not None and shard[low] != current:
                    yield done()
                    held = []
                current = int(shard[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield done()

    # the row's own number too: an id, null for one, that comes with a third of all rows must not fill one shard
    shard = F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard")
    spread = items.select(shard, "id", "piece", "first_token", "n_tokens", "terms").repartition("shard").sortWithinPartitions("shard", "id", "piece")
    return spread.mapInArrow(fill, f"id {kind}, piece int, first_token int, n_tokens int, terms binary, container string, start_at int, used int")


def fill_containers(
    df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, shard_items: int = SHARD_ITEMS
) -> DataFrame:
    """Every text with tokens assigned to containers of ``capacity`` tokens: ``id_col``, ``piece`` (from 0),
    ``first_token`` (of the piece in its text), ``n_tokens``, ``container``, ``start_at`` (place in the
    container) and ``used`` (tokens of the container).

    Only a text longer than the capacity has more than one piece, and all but the last fill a container
    alone. Null and empty texts have no tokens and are not assigned; a row that comes again is assigned
    again; a null id stays null. No container holds more than the capacity. An empty table gives an empty
    result.
    """
    ship(df.sparkSession, vocabulary)
    pieces = cut(measure(df, id_col, text_col, capacity, vocabulary))
    items = pieces.where("terms is not null")
    shards = max(1, -(-items.count() // shard_items))
    columns = [F.col("id").alias(id_col), "piece", "first_token", "n_tokens", "container", "start_at", "used"]
    alone = F.concat_ws("-", F.lit("full"), F.xxhash64("id", "first_token").cast("string"), F.monotonically_increasing_id().cast("string"))
    full = pieces.where("terms is null").withColumn("container", alone).withColumn("start_at", F.lit(0)).withColumn("used", F.col("n_tokens"))
    first = cut(_packed(items, shards, capacity, "a"))
    loose = first.where(F.col("used") < WELL_FILLED * capacity)
    again = _packed(loose, max(1, -(-loose.count() // shard_items)), capacity, "b")
    return full.select(*columns).unionByName(first.where(F.col("used") >= WELL_FILLED * capacity).select(*columns)).unionByName(again.select(*columns))
