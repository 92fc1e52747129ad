"""Search: the best rows for each of a stated set of queries.

Queries whose vectors take SENT bytes at most are sent to every task, and rows are held against them where they lie.
More of them meet the rows in cells of CELL_ROWS rows: a row goes to one cell, a query to all; nothing that grows with
the data reaches the driver. Terms of queries are sent likewise, and texts are held against them where they lie: pairs of
queries and texts with a term in common, whose number grows with the product of both, are never shuffled. As every task
gives k rows of each query, rows are gathered into as many tasks as the session has cores: hits grow with the queries only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import FloatType

from retrix.sources.tables import cut

#: Bytes of query vectors that are sent to every task; rows of a cell; numbers of a matrix that is made at once.
SENT, CELL_ROWS, AT_ONCE = 32 << 20, 1 << 18, 1 << 22
#: Bytes that a key takes where it is sent, at most.
KEY_BYTES = 64
ROUND = 9


def ranked(df: DataFrame, by: list[str], score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each group: highest score, then smallest ``tie``; ``rank`` counts from 1."""
    window = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


class _Best:
    """The k most similar rows of each query so far."""

    schema = "query_id long, key long, score double"

    def __init__(self, k: int):
        self.k, self.held, self.waiting = k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []
        # queries that have k rows, in order, and the score of place k
        self.full, self.least = np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, queries: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        size = np.outer(np.sqrt((queries**2).sum(axis=1)), np.sqrt((rows**2).sum(axis=1)))
        value = np.divide(queries @ rows.T, size, out=np.zeros_like(size), where=size > 0)
        floor = np.full(len(ids), -np.inf)
        if len(self.full):
            at = np.minimum(np.searchsorted(self.full, ids), len(self.full) - 1)
            floor = np.where(self.full[at] == ids, self.least[at], floor)
        new = np.flatnonzero(np.isneginf(floor))
        if len(new) and value.shape[1] > self.k:
            floor[new] = np.partition(value[new], value.shape[1] - self.k, axis=1)[:, -self.k]
        good = value >= (floor - 2 * 10.0**-ROUND)[:, None]  # ties and what may round to it included
        if value.shape[1] <= self.k:
            good[new] = True
        who, what = np.nonzero(good)
        self.waiting.append((ids[who], keys[what], np.round(value[who, what], ROUND)))
        if sum(len(x[0]) for x in self.waiting) > max(len(self.held[0]), AT_ONCE // 8):
            self.merge()

    def merge(self) -> None:
        query, key, score = (np.concatenate(x) for x in zip(self.held, *self.waiting))
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))[: len(query)]
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        self.full, self.least = query[rank == self.k - 1], score[rank == self.k - 1]
        self.held, self.waiting = (query[rank < self.k], key[rank < self.k], score[rank < self.k]), []

    def rows(self) -> list[np.ndarray]:
        self.merge()
        return list(self.held)


class _Leading:
    """The k greatest sums of each query so far, by the rounded sum, then the smallest key."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.waiting = k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []
        # score and key of a query's place k; a query with fewer takes what comes
        self.least, self.last = np.zeros(queries), np.full(queries, np.iinfo(np.int64).max)

    def add(self, sums: np.ndarray, keys: np.ndarray) -> None:
        """Sums of all queries (rows) and some keys (columns); 0 is no hit."""
        above = lambda floor: sums >= np.maximum(floor - 2 * 10.0**-ROUND, np.finfo(float).tiny)[:, None]  # noqa: E731  what may round to it included
        good = above(self.least)
        if len(keys) > self.k and np.count_nonzero(good) > AT_ONCE // 8:
            good = above(np.maximum(self.least, np.partition(sums, len(keys) - self.k, axis=1)[:, -self.k]))
        who, what = np.nonzero(good)
        value, key = sums[who, what], keys[what]
        score = np.round(value, ROUND)
        good = (score > self.least[who]) | ((score == self.least[who]) & (key <= self.last[who]))
        self.waiting.append((who[good], key[good], value[good]))
        if sum(len(x[0]) for x in self.waiting) > max(len(self.held[0]), AT_ONCE // 8):
            self.merge()

    def merge(self) -> None:
        query, key, value = (np.concatenate(x) for x in zip(self.held, *self.waiting))
        order = np.lexsort((key, -np.round(value, ROUND), query))
        query, key, value = query[order], key[order], value[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))[: len(query)]
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        full = rank == self.k - 1
        self.least[query[full]], self.last[query[full]] = np.round(value[full], ROUND), key[full]
        self.held, self.waiting = (query[rank < self.k], key[rank < self.k], value[rank < self.k]), []

    def rows(self) -> list[np.ndarray]:
        self.merge()
        return list(self.held)


class _Greatest:
    """The greatest dot product of each query with the rows of each key so far."""

    schema = "query_id long, key long, score double"

    def __init__(self):
        self.held: dict[tuple[int, int], float] = {}

    def add(self, ids: np.ndarray, queries: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        best = np.maximum.reduceat((queries @ rows.T)[:, order], starts, axis=1)
        for key, column in zip(keys[order][starts].tolist(), best.T):
            for query, value in zip(ids.tolist(), column.tolist()):
                self.held[query, key] = max(self.held.get((query, key), -np.inf), value)

    def rows(self) -> list[np.ndarray]:
        return [np.array([q for q, _ in self.held], np.int64), np.array([k for _, k in self.held], np.int64), np.array(list(self.held.values()))]


def _packed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``key`` and the vector's bytes, for rows that have both."""
    kind = np.float32 if isinstance(df.schema[vector_col].dataType.elementType, FloatType) else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False))]).astype(np.int64) * np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[s:e] for s, e in zip(ends, ends[1:])], type=pa.binary()), pa.array([kind().itemsize] * batch.num_rows, type=pa.int32())], names=["key", "packed", "width"])

    used = df.select(F.col(id_col).cast("long").alias("key"), F.col(vector_col).alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    return used.mapInArrow(pack, "key long, packed binary, width int")


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows in as many tasks as the session has cores, or fewer."""
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is among those of another table, picked where they lie; all rows if the keys are too many to be sent."""
    keys = cut(wanted.select(key).where(F.col(key).isNotNull()).distinct())
    return rows.join(F.broadcast(keys), key, "left_semi") if keys.count() * KEY_BYTES <= SENT else rows


def _matrix(packed: list[bytes], width: int, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float32 if width == 4 else np.float64).reshape(-1, dimension).astype(np.float64)


def _against(rows: DataFrame, asked: DataFrame, start: Callable[[], _Best | _Greatest], sent: int, cell_rows: int) -> DataFrame:
    """What a state makes of all queries (``key``, ``packed``, ``width``) and all rows of their length."""
    schema = "query_id long, key long, score double"
    asked = cut(asked)
    groups = asked.groupBy("width", (F.octet_length("packed") / F.col("width")).cast("int").alias("dimension")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("packed")).alias("bytes")).collect()  # one row per length
    out = None
    for group in groups:
        width, dimension = group["width"], group["dimension"]
        of_length = F.octet_length("packed") == F.lit(dimension) * F.col("width")
        own = asked.where((F.col("width") == width) & of_length)
        fitting = rows.where(of_length)

        def both(state, ids: np.ndarray, queries: np.ndarray, keys: np.ndarray, held: np.ndarray) -> None:
            step = max(1, AT_ONCE // 4 // max(len(keys), 1))  # a state makes several matrices
            for at in range(0, len(ids), step):
                state.add(ids[at : at + step], queries[at : at + step], keys, held)

        def batch_of(state) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in state.rows()], names=["query_id", "key", "score"])

        if group["bytes"] <= sent:
            few = own.collect()  # bounded by SENT
            known = rows.sparkSession.sparkContext.broadcast((np.array([r["key"] for r in few], np.int64), _matrix([bytes(r["packed"]) for r in few], width, dimension)))

            def walk(batches: Iterator[pa.RecordBatch], known=known, dimension=dimension) -> Iterator[pa.RecordBatch]:
                state = start()
                for batch in batches:
                    if batch.num_rows:
                        both(state, *known.value, batch.column(0).to_numpy(), _matrix(batch.column(1).to_pylist(), batch.column(2)[0].as_py(), dimension))
                yield batch_of(state)

            found = _gathered(fitting.select("key", "packed", "width")).mapInArrow(walk, schema)
        else:
            cells = max(1, -(-fitting.count() // cell_rows))

            def meet(batches: Iterator[pa.RecordBatch], dimension=dimension) -> Iterator[pa.RecordBatch]:
                """Rows come by cell, those that are searched before those that ask."""
                at, waiting, state = None, [], None
                for batch in batches:
                    cell, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                    cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1
                    for low, high in zip(np.append(0, cuts), np.append(cuts, len(cell))):
                        if low == high:
                            continue
                        if cell[low] != at:
                            if state is not None:
                                yield batch_of(state)
                            at, waiting, state = cell[low], [], start()
                        part = batch.slice(low, high - low)
                        keys, held = part.column(2).to_numpy(), _matrix(part.column(3).to_pylist(), part.column(4)[0].as_py(), dimension)
                        if not asks[low]:
                            waiting.append((keys, held))
                        else:
                            for some, vectors in waiting:
                                both(state, keys, held, some, vectors)
                if state is not None:
                    yield batch_of(state)

            placed = fitting.select(F.pmod(F.xxhash64("key", "packed"), F.lit(cells)).alias("cell"), F.lit(False).alias("asks"), "key", "packed", "width")
            spread = own.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), F.lit(True).alias("asks"), "key", "packed", "width")
            found = placed.unionByName(spread).repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(meet, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def top_cosine(rows: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, query_vector: str, k: int = 5, sent: int = SENT, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k rows most similar to each query: ``query_id``, ``doc_id``, ``score``, ``rank``.

    Scores are cosines in double precision, rounded to 9 decimals; a vector of length 0 scores 0. Rows and queries
    with a null id or vector, or with a null in it, are left out, and only vectors of the same length are compared. A
    task keeps k rows of each query it holds before anything is shuffled.
    """
    found = _against(_packed(rows, id_col, vector_col), _packed(queries, query_id, query_vector), lambda: _Best(k), sent, cell_rows)
    return ranked(found.withColumnRenamed("key", "doc_id"), ["query_id"], "score", "doc_id", k)


def sendable(asked: DataFrame, sent: int | None = None) -> bool:
    """Whether the terms of queries (``term``) are few enough to be sent to every task."""
    size = asked.agg((F.count(F.lit(1)) * 32 + F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).alias("bytes")).first()["bytes"]  # one row
    return size <= (SENT if sent is None else sent)


def top_sums(texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k texts (``doc_id``, ``terms``, ``values``; one row each) with the greatest sum of weight times value over the
    terms that they share with a query (``query_id``, ``term``, ``weight``; a term once a query, weights above 0):
    ``query_id``, ``doc_id``, ``score``, ``rank``. A task keeps k texts of each query before anything is shuffled.
    ``asked`` has to be sendable."""
    spark, kind = texts.sparkSession, asked.schema["query_id"].dataType
    few = asked.select("query_id", "term", "weight").collect()  # bounded by SENT
    number = {q: n for n, q in enumerate(dict.fromkeys(r["query_id"] for r in few))}
    terms = {t: n for n, t in enumerate(dict.fromkeys(r["term"] for r in few))}
    term = np.array([terms[r["term"]] for r in few], np.int64)
    order = np.argsort(term, kind="stable")
    of, weight = np.array([number[r["query_id"]] for r in few], np.int64)[order], np.array([r["weight"] for r in few], float)[order]
    known = spark.sparkContext.broadcast((list(number), list(terms), of, weight, np.searchsorted(term[order], np.arange(len(terms) + 1))))
    no_key = np.iinfo(np.int64).min  # a null id, which comes first among equals

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, of, weight, starts = known.value
        wanted, state = pa.array(held, pa.string()), _Leading(len(names), k)
        step = max(1, AT_ONCE // max(len(names), 1))
        for batch in batches:
            keys = pa.compute.fill_null(batch.column(0), no_key).to_numpy()
            text = np.repeat(np.arange(len(keys)), pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            term = pa.compute.fill_null(pa.compute.index_in(batch.column(1).flatten(), value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            value = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            text, term, value = text[term >= 0], term[term >= 0], value[term >= 0]
            for low in range(0, len(keys) if len(names) else 0, step):
                a, b = np.searchsorted(text, [low, low + step])
                if a == b:
                    continue
                place, back = np.unique(term[a:b] * step + text[a:b] - low, return_inverse=True)
                summed = np.bincount(back, value[a:b])
                t, d = np.divmod(place, step)
                cuts = np.flatnonzero(t[1:] != t[:-1]) + 1
                sums = np.zeros((len(names), min(step, len(keys) - low)))
                for s, e in zip(np.append(0, cuts), np.append(cuts, len(t))):
                    own = slice(starts[t[s]], starts[t[s] + 1])
                    sums[of[own][:, None], d[s:e]] += weight[own][:, None] * summed[s:e]
                state.add(sums, keys[low : low + step])
        query, key, score = state.rows()
        ids = pa.array(names, to_arrow_type(kind)).take(pa.array(query))
        yield pa.RecordBatch.from_arrays([ids, pa.array(key, mask=key == no_key), pa.array(score)], names=["query_id", "doc_id", "score"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "terms", F.col("values").cast("array<double>").alias("values"))
    found = _gathered(rows).mapInArrow(walk, f"query_id {kind.simpleString()}, doc_id long, score double")
    return ranked(found.withColumn("score", F.round("score", ROUND)), ["query_id"], "score", "doc_id", k)


def best_product(rows: DataFrame, group_col: str, vector_col: str, queries: DataFrame, query_id: str, query_vector: str, sent: int = SENT, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The greatest dot product of each query vector with the vectors of each group: ``query_id``, ``grp``, ``best``.
    A task keeps one number per query and group, so only these are shuffled. Odd vectors as in top_cosine."""
    found = _against(_packed(rows, group_col, vector_col), _packed(queries, query_id, query_vector), _Greatest, sent, cell_rows)
    return found.groupBy("query_id", F.col("key").alias("grp")).agg(F.max("score").alias("best"))


def post_filtered(hits: DataFrame, payload: DataFrame, id_col: str, condition: Column, k: int) -> DataFrame:
    """Of each query's hits (fetched twice as many as wanted) the first k that meet a condition on their payload."""
    kept = hits.join(payload, hits["doc_id"] == payload[id_col]).where(condition)
    window = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k).select("query_id", "doc_id", "score", "place")
