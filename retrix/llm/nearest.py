"""The k most similar vectors of every vector: an inverted file with product-quantised residuals.

Coarse centroids divide the vectors into lists; what is left after the centroid is quantised by parts.
Every vector asks the lists nearest to it: a table of distances between its own parts and the codebooks
gives an estimate for each code of a list, the best estimates are ranked again by the exact cosine in
double precision, and the answers of the lists are put together.

The models are fitted on a bounded sample (SAMPLE rows, the least by a hash of the vector); every vector is
indexed and every vector asks. Lists hold LIST_SIZE vectors on average whatever their number: beyond COARSE lists,
each is divided by a second level of centroids over what the first one leaves. So the work for a vector, and
the bytes sent for it, don't grow with the collection. Neighbouring lists form groups, so that a query is sent
once to all the lists it asks in a group; a group of more than GROUP_LIMIT vectors is divided into blocks of its
entries, each sent once, so no task holds a whole hot one.
Equal vectors are indexed once with their smallest ids: a group of copies of any size stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrix.llm.sampling import least_by_hash
from retrix.sources.tables import cut

#: Rows on which the models are fitted.
SAMPLE = 16_384
#: Vectors of a list on average, and lists up to which one level of centroids does (there are as many as the root of
#: the number of vectors at least).
LIST_SIZE, COARSE = 340, 1024
SUBSPACES = 16
CODEWORDS = 64
PROBES = 12
#: Neighbouring lists that lie in one cell, so that a query goes there once for all of them.
LISTS_PER_GROUP = 40
#: Groups at least, if there are that many lists, and groups that a task takes where there are many.
LEAST_GROUPS, GROUPS_PER_TASK = 9, 8
#: Vectors of a group of lists that one task holds.
GROUP_LIMIT = 65_536
#: Candidates of one list, besides k, whose exact cosine is computed.
RERANK = 32
#: Nearest centroids of the first level, for each list that is asked, below which lists of the second are sought.
BEAM = 2
#: Numbers of a matrix that a task makes at once.
AT_ONCE = 1 << 21
DIGITS = 12


def _kmeans(data: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one takes the point farthest from its own."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(data)))
    centroids = data[rng.choice(len(data), k, replace=False)].copy()
    for _ in range(rounds):
        nearest, distance = assign(data, centroids)
        order = np.argsort(nearest, kind="stable")
        starts = np.flatnonzero(np.append(True, nearest[order][1:] != nearest[order][:-1]))
        sums = np.add.reduceat(data[order], starts, axis=0)
        sizes = np.diff(np.append(starts, len(data)))
        centroids[nearest[order][starts]] = sums / sizes[:, None]
        empty = np.setdiff1d(np.arange(k), nearest)
        if len(empty):
            centroids[empty] = data[np.argsort(-distance)[: len(empty)]]
    return centroids


def assign(data: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the squared distance to it."""
    near, far = np.empty(len(data), dtype=np.int64), np.empty(len(data), dtype=np.float32)
    norms = (centroids**2).sum(axis=1)
    for at in range(0, len(data), 4096):
        part = data[at : at + 4096]
        scores = norms - 2 * part @ centroids.T
        near[at : at + 4096] = scores.argmin(axis=1)
        far[at : at + 4096] = scores.min(axis=1) + (part**2).sum(axis=1)
    return near, far


class Model:
    """Centroids of one or two levels, and the codebooks of the residuals' parts.

    List ``i * len(fine) + j`` has the centroid ``coarse[i] + fine[j]``.
    """

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, seed: int = 7, coarse: int = COARSE):
        self.coarse = _kmeans(sample, min(lists, coarse), 8, seed)
        residual = sample - self.coarse[assign(sample, self.coarse)[0]]
        self.fine = np.zeros((1, sample.shape[1]), dtype=sample.dtype)
        if lists > coarse:
            self.fine = _kmeans(residual, -(-lists // coarse), 8, seed + 101)
            residual = residual - self.fine[assign(residual, self.fine)[0]]
        first = -(-len(self.coarse) * min(len(self.fine), LISTS_PER_GROUP) // LISTS_PER_GROUP)
        self._first = assign(self.coarse, _kmeans(self.coarse, max(first, LEAST_GROUPS), 10, seed))[0]
        self._second = assign(self.fine, _kmeans(self.fine, -(-len(self.fine) // LISTS_PER_GROUP), 10, seed))[0]
        self._seconds = int(self._second.max()) + 1
        self.parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [_kmeans(np.ascontiguousarray(residual[:, p]), codewords, 6, seed + 1 + k) for k, p in enumerate(self.parts)]

    def centroid(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    @property
    def groups(self) -> int:
        return (int(self._first.max()) + 1) * self._seconds

    def group_of(self, lists: np.ndarray) -> np.ndarray:
        return self._first[lists // len(self.fine)] * self._seconds + self._second[lists % len(self.fine)]

    def place(self, data: np.ndarray) -> np.ndarray:
        """The list of each row."""
        near = assign(data, self.coarse)[0]
        if len(self.fine) == 1:
            return near
        return near * len(self.fine) + assign(data - self.coarse[near], self.fine)[0]

    def encode(self, data: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = data - self.centroid(lists)
        return np.stack([assign(np.ascontiguousarray(residual[:, p]), book)[0] for p, book in zip(self.parts, self.books)], axis=1).astype(np.uint8)

    def probes(self, data: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` lists nearest to each row."""
        beam = count if len(self.fine) == 1 else BEAM * count
        scores = (self.coarse**2).sum(axis=1) - 2 * data @ self.coarse.T
        near = np.tile(np.arange(len(self.coarse)), (len(data), 1)) if beam >= len(self.coarse) else np.argpartition(scores, beam - 1, axis=1)[:, :beam]
        if len(self.fine) == 1:
            return near
        between = 2 * self.coarse @ self.fine.T
        out = []
        step = max(1, AT_ONCE // (near.shape[1] * len(self.fine)))
        for at in range(0, len(data), step):
            some = near[at : at + step]
            own = (self.fine**2).sum(axis=1) - 2 * data[at : at + step] @ self.fine.T
            both = (np.take_along_axis(scores[at : at + step], some, axis=1)[:, :, None] + own[:, None, :] + between[some]).reshape(len(some), -1)
            best = np.argpartition(both, min(count, both.shape[1]) - 1, axis=1)[:, :count]
            out.append(np.take_along_axis(some, best // len(self.fine), axis=1) * len(self.fine) + best % len(self.fine))
        return np.concatenate(out) if out else near

    def estimate(self, queries: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the codes of a list: a table per part, looked up by code."""
        residual = queries - self.centroid(np.array([number]))
        total = np.zeros((len(queries), len(codes)), dtype=np.float32)
        for k, (p, book) in enumerate(zip(self.parts, self.books)):
            table = (book**2).sum(axis=1) - 2 * residual[:, p] @ book.T
            total += np.take(table, codes[:, k], axis=1)
        return total


def usable(df: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    """Rows with an id and a vector of the dimension, finite and not all zero: ``id``, ``vector``."""
    vector = F.col("vector")
    good = (F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & vector.isNotNull() & good)


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _matrix(packed: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), dtype=np.float32).reshape(-1, dimension)


def _best(score: np.ndarray, owner: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k best: highest score, then smallest other."""
    order = np.lexsort((other, -score, owner))
    sorted_owner = owner[order]
    first = np.flatnonzero(np.append(True, sorted_owner[1:] != sorted_owner[:-1]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def _keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of so many partitions, a number that Spark's hash partitioning puts there."""
    numbers = spark.range(0, 40 * parts + 400, 1, 1).select(F.col("id").cast("int").alias("key"))
    found = {r["part"]: r["key"] for r in numbers.groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("part")).agg(F.min("key").alias("key")).collect()}
    spare = next(iter(found.values()))
    return [found.get(part, spare) for part in range(parts)]


def top_similar(
    df: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 5,
    dimension: int = 64,
    probes: int = PROBES,
    rerank: int = RERANK,
    sample: int = SAMPLE,
    group_limit: int = GROUP_LIMIT,
    lists: int | None = None,
    coarse: int = COARSE,
    asking: Column | None = None,
) -> DataFrame:
    """The k most similar other vectors of every usable vector: ``id``, ``other``, ``cosine``, ``rank``.

    Cosines are in double precision, rounded to 12 decimals; ties go to the smaller id. A vector that is
    null, of another length, not finite or all zero takes no part; an id takes part once (with the least of
    its vectors, if it has several). With fewer than k others all of them come out. An empty table gives an
    empty result. ``lists`` defaults to one for LIST_SIZE different vectors, or their root if that is more.
    ``asking``: a condition on ``id`` for those that ask; all are answers.
    """
    spark = df.sparkSession
    keep = k + 1
    vectors = usable(df, id_col, vector_col, dimension)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32) + np.float32(0)  # no negative zero
            rows = flat.reshape(-1, dimension) if len(flat) else np.zeros((0, dimension), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([row.tobytes() for row in rows], type=pa.binary())], names=["id", "packed"])

    asks = asking if asking is not None else F.lit(True)
    keyed = vectors.mapInArrow(pack, "id long, packed binary").select("id", "packed", asks.alias("asks"), F.xxhash64("packed").alias("k1"), F.xxhash64(F.lit(1), "packed").alias("k2"))
    rows = cut(keyed.withColumn("row", F.monotonically_increasing_id()))
    # by keys of 128 bits, without the vectors: each id once, and equal vectors put together under their smallest id
    once = rows.groupBy("id").agg(F.min(F.struct("k1", "k2", "row")).alias("own"), F.max("asks").alias("asks"), F.count(F.lit(1)).alias("times"))
    ids = cut(once.select("id", "own.*", "asks", "times"))
    classes = ids.groupBy("k1", "k2").agg(F.min("id").alias("entry"), F.min_by("row", "id").alias("head"), F.max("asks").alias("any"), F.count(F.lit(1)).alias("size"))
    classes = cut(classes)
    total = classes.count()
    share = least_by_hash(rows.select("packed", "k1"), F.col("k1"), sample, total, distinct=True)
    if not share:
        return spark.createDataFrame([], "id long, other long, cosine double, rank int")
    points = _unit(np.frombuffer(b"".join(bytes(r["packed"]) for r in share), dtype=np.float32).reshape(-1, dimension)).astype(np.float32)
    lists = lists or max(1, round(total**0.5), -(-total // LIST_SIZE))
    model = spark.sparkContext.broadcast(Model(points, lists, coarse=coarse))  # at most COARSE centroids and SAMPLE rows below

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            if batch.num_rows:
                number = own.place(_unit(_matrix(batch.column(0), dimension)).astype(np.float32))
                columns = [pa.array(own.group_of(number)), pa.array(number), batch.column(1), batch.column(0), batch.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "list", "entry", "packed", "asks"])

    crowded = classes.where("size > 1")
    copies = cut(ids.join(crowded.select("k1", "k2", "entry"), ["k1", "k2"]).select("id", "asks", "entry"))
    # rows that are not the one of their class go; where a class has several, it asks if one of them does
    repeated = rows.join(ids.where("times > 1").select("id", F.col("row").alias("kept")), "id").where("row <> kept").select("row", F.lit(None).cast("boolean").alias("any"))
    others = ids.join(crowded, ["k1", "k2"]).select("row", F.when(F.col("row") == F.col("head"), F.col("any")).alias("any"))
    marks = others.unionByName(repeated).withColumn("several", F.lit(True))
    entries = rows.join(marks, "row", "left").where("several is null or any is not null").select("packed", F.col("id").alias("entry"), F.coalesce("any", "asks").alias("asks"))
    placed = cut(entries.mapInArrow(place, "group long, list long, entry long, packed binary, asks boolean"))
    hot = placed.groupBy("group").count().where(F.col("count") > group_limit).collect()  # one row for GROUP_LIMIT vectors at most
    grid = spark.sparkContext.broadcast({r["group"]: -(-r["count"] // group_limit) for r in hot})
    # groups in turn to partitions: few of them would by chance meet in one
    groups = model.value.groups + sum(grid.value.values()) - len(hot)
    parts = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS_PER_TASK)))
    keys = np.array(_keys(spark, parts), dtype=np.int32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries (``probed`` null, ``list`` their own), each once, and queries (``probed``: lists to ask), once for
        each block of each group they ask."""
        own, blocks = model.value, grid.value
        names = ["part", "group", "block", "list", "entry", "packed", "probed"]
        crowded_groups = np.array(sorted(blocks), dtype=np.int64)
        counts = np.array([blocks[x] for x in crowded_groups.tolist()], dtype=np.int64)

        def block_count(group: np.ndarray) -> np.ndarray:
            out = np.ones(len(group), dtype=np.int64)
            if len(crowded_groups):
                at = np.minimum(np.searchsorted(crowded_groups, group), len(crowded_groups) - 1)
                out = np.where(crowded_groups[at] == group, counts[at], out)
            return out

        def rows(batch, row, group, block, lists, probed):
            columns = [pa.array(keys[(group + block) % parts]), pa.array(group), pa.array(block.astype(np.int32)), pa.array(lists)]
            return pa.RecordBatch.from_arrays([*columns, batch.column(2).take(pa.array(row)), batch.column(3).take(pa.array(row)), probed], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            group, lists, share = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy() * 2654435761 % (1 << 31)
            yield rows(batch, np.arange(len(lists)), group, share % block_count(group), lists, pa.nulls(len(lists), pa.binary()))
            who = np.flatnonzero(batch.column(4).to_numpy(zero_copy_only=False))
            if not len(who):
                continue
            near = own.probes(_unit(_matrix(batch.column(3).take(pa.array(who)), dimension)).astype(np.float32), probes)
            asked, number = np.repeat(who, near.shape[1]), near.reshape(-1)
            group = own.group_of(number)
            order = np.lexsort((number, group, asked))
            asked, number, group = asked[order], number[order], group[order]
            first = np.flatnonzero(np.append(True, (asked[1:] != asked[:-1]) | (group[1:] != group[:-1])))
            last = np.append(first[1:], len(asked))
            packed_lists = pa.array([number[s:e].astype("<i8").tobytes() for s, e in zip(first, last)], type=pa.binary())
            asked, group = asked[first], group[first]
            times = block_count(group)
            row = np.repeat(np.arange(len(times)), times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield rows(batch, asked[row], group[row], block, np.full(len(row), -1), packed_lists.take(pa.array(row)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group and block, the entries before those that ask."""
        own, at, index = model.value, None, None
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def build() -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
            lists, ids, raw = (np.concatenate([x[c] for x in waiting]) for c in range(3))
            waiting.clear()
            order = np.argsort(lists, kind="stable")
            lists, ids, unit = lists[order], ids[order], _unit(raw[order])
            codes = own.encode(unit.astype(np.float32), lists)
            starts = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
            return {int(lists[s]): (ids[s:e], unit[s:e], codes[s:e]) for s, e in zip(starts, np.append(starts[1:], len(lists)))}

        def ask(entry: np.ndarray, raw: np.ndarray, probed: list[bytes]) -> pa.RecordBatch | None:
            unit = _unit(raw)
            narrow = unit.astype(np.float32)
            lists = np.frombuffer(b"".join(probed), dtype="<i8")
            asking = np.repeat(np.arange(len(entry)), [len(x) // 8 for x in probed])
            order = np.argsort(lists, kind="stable")
            lists, asking = lists[order], asking[order]
            starts = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
            owners, others, scores = [], [], []
            for s, e in zip(starts, np.append(starts[1:], len(lists))):
                held = index.get(int(lists[s]))
                if held is None:
                    continue
                ids, vectors, codes = held
                step = max(1, AT_ONCE // len(ids))
                for low in range(s, e, step):
                    who = asking[low : min(e, low + step)]
                    if len(ids) > keep + rerank:
                        near = np.argpartition(own.estimate(narrow[who], int(lists[s]), codes), keep + rerank - 1, axis=1)[:, : keep + rerank]
                    else:
                        near = np.broadcast_to(np.arange(len(ids)), (len(who), len(ids)))
                    exact = np.round(np.matmul(vectors[near], unit[who][:, :, None])[:, :, 0], DIGITS)
                    best = exact if exact.shape[1] <= keep else np.partition(exact, exact.shape[1] - keep, axis=1)[:, -keep:]
                    good = exact >= best.min(axis=1, keepdims=True)  # ties included
                    owners.append(np.broadcast_to(who[:, None], near.shape)[good])
                    others.append(ids[near[good]])
                    scores.append(exact[good])
            if not owners:
                return None
            owner, other, score = (np.concatenate(x) for x in (owners, others, scores))
            best = _best(score, owner, other, keep)
            return pa.RecordBatch.from_arrays([pa.array(entry[owner[best]]), pa.array(other[best]), pa.array(score[best])], names=["entry", "other", "cosine"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group, block, lists, entry = (batch.column(c).to_numpy() for c in range(1, 5))
            raw = _matrix(batch.column(5), dimension)
            asks = lists < 0
            change = np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip(np.append(0, change), np.append(change, len(group))):
                place = (int(group[low]), int(block[low]))
                if place != at:
                    at, index = place, None
                    waiting.clear()
                if not asks[low]:
                    waiting.append((lists[low:high].astype(np.int64), entry[low:high], raw[low:high]))
                    continue
                if waiting:
                    index = build()
                if index is None:
                    continue
                for start in range(low, high, 4096):
                    stop = min(high, start + 4096)
                    found = ask(entry[start:stop], raw[start:stop], batch.column(6).slice(start, stop - start).to_pylist())
                    if found is not None:
                        yield found

    spread_rows = placed.mapInArrow(spread, "part int, group long, block int, list long, entry long, packed binary, probed binary")
    in_blocks = spread_rows.repartition(parts, "part").sortWithinPartitions("group", "block", F.desc("list"))
    answers = in_blocks.mapInArrow(answer, "entry long, other long, cosine double")

    def choose(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by entry; the k + 1 best of each."""
        rest = None
        for batch in groups:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            whole = table.to_batches()[0]
            entry = whole.column(0).to_numpy()
            end = int(np.searchsorted(entry, entry[-1]))
            rest = whole.slice(end)
            if end:
                yield best_of(whole.slice(0, end))
        if rest is not None:
            yield best_of(rest)

    def best_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        entry, other, score = (batch.column(c).to_numpy() for c in range(3))
        return batch.take(pa.array(_best(score, entry, other, keep)))

    merged = answers.repartition("entry").sortWithinPartitions("entry").mapInArrow(choose, "entry long, other long, cosine double")
    # answers of entries -> answers of ids: an entry stands for its copies, of which the smallest can be answers
    smallest = copies.withColumn("nth", F.row_number().over(Window.partitionBy("entry").orderBy("id"))).where(F.col("nth") <= keep).select(F.col("entry").alias("other"), F.col("id").alias("copy"))
    widened = merged.join(smallest, "other", "left").select("entry", F.coalesce("copy", "other").alias("other"), "cosine")
    askers = copies.where("asks").select("entry", F.col("id").alias("asker"))  # an asking entry with copies has one here
    answered = widened.join(askers, "entry", "left").select(F.coalesce("asker", "entry").alias("id"), "other", "cosine").where("id <> other")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    return answered.withColumn("rank", rank).where(F.col("rank") <= k)


def similar_pairs(df: DataFrame, id_col: str, vector_col: str, k: int = 5, dimension: int = 64, **how) -> DataFrame:
    """Pairs ``id_a`` < ``id_b`` of which at least one is among the k most similar of the other."""
    found = top_similar(df, id_col, vector_col, k, dimension, **how)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
