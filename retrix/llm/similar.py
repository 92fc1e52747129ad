"""Near-duplicate texts by a prefix-tree join over multisets of words.

Every text becomes a set of n-grams (an n-gram that comes again is another element: its second
occurrence and so on), ordered rarest first by one global order. The ordered sets form a trie. Two sets
whose similarity reaches the threshold have a first common element, and for sets of sizes n and m that
need an overlap of o it lies among the first n - o + 1 elements of the one and m - o + 1 of the other.
So a set is stored under the paths that can be the beginning of an overlap:

* a path is one element, or where the global counts tell that too many sets hold that element, the first
  two, three or four common elements (a hot node of the trie is split by its children, never cut off); what is
  still hot then holds elements that nearly all sets have, and is split into blocks of its sets, every two of which
  meet in one task;
* at a node, pairs are pruned by the bound on the remaining lengths behind the shared element, and by the
  Hamming distance of bit signatures of the rarest elements, a lower bound of these elements' difference;
* what is left is checked against the texts themselves.

The global order comes from a table of counts of fixed size (hashed elements), so what is broadcast does
not grow with the data, though the counts cover all of it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrix.llm.hashing import mix as _mix
from retrix.sources.tables import cut

#: log2 of the size of the table of counts: 4 Mi entries, 16 MB.
COUNT_BITS = 22
#: Rows in which one task sends its part of that table.
COUNT_PARTS = 64
PAIRS_AT_ONCE = 1 << 21
MEMO_WORDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


@dataclass(frozen=True)
class Trie:
    """How the trie is divided.

    limit: sets at a node beyond which the node is split by its children before anything is sent, and from the depth
    ``depth`` on into blocks. leaf: sets of a subtree beyond which a task goes down it, and down: levels that it goes.
    """

    limit: int = 20_000
    depth: int = 4
    leaf: int = 256
    down: int = 3


class _Codes(dict):
    """Words by number; a new word gets the next number, and its hash is kept at that place."""

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros(1 << 16, dtype=_U)

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        if code >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[code] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


class _Tokenizer:
    """Words of texts as 64-bit elements; remembers the words it has seen."""

    def __init__(self, gram: int):
        self.gram, self.codes = gram, _Codes()

    def elements(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Element hashes, their row numbers (ascending), and the number of elements by row."""
        if len(self.codes) > MEMO_WORDS:
            self.codes = _Codes()
        find, code = _WORD.findall, self.codes.__getitem__
        flat: list[int] = []
        lengths = []
        for text in texts:
            words = find(text.lower()) if text else ()
            lengths.append(len(words))
            flat += map(code, words)
        sizes = np.array(lengths, dtype=np.int64)
        rows = np.repeat(np.arange(len(texts)), sizes)
        numbers = np.fromiter(flat, dtype=np.int64, count=len(flat))
        if self.gram == 1:
            order = np.argsort(rows << 32 | numbers)
            numbers, rows = numbers[order], rows[order]
            fresh = np.append(True, (numbers[1:] != numbers[:-1]) | (rows[1:] != rows[:-1]))[: len(numbers)]
            hashes = self.codes.hashes[numbers]
        else:
            hashes, n = self.codes.hashes[numbers], self.gram
            keep = np.arange(len(hashes)) + n <= np.repeat(np.cumsum(sizes), sizes)
            total = np.zeros(len(hashes), dtype=_U)
            for k in range(min(n, len(hashes))):
                total[: len(hashes) - k] = _mix(total[: len(hashes) - k] + hashes[k:])
            hashes, rows = total[keep], rows[keep]
            sizes = np.maximum(sizes - n + 1, 0)
            order = np.lexsort((hashes, rows))
            hashes, rows = hashes[order], rows[order]
            fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]))[: len(hashes)]
        starts = np.flatnonzero(fresh)
        nth = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
        return _mix(hashes + nth.astype(_U) * _U(0x9E3779B97F4A7C15)), rows, sizes


def _rarest_first(found: np.ndarray, rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The order by row, count and element."""
    if len(rows) and rows[-1] < 1 << 15:
        key = rows << 48 | np.minimum(count, (1 << 20) - 1).astype(np.int64) << 28 | (found >> _U(36)).astype(np.int64)
        order = np.argsort(key)
        key = key[order]
        if not (key[1:] == key[:-1]).any():
            return order
    return np.lexsort((found, np.minimum(count, (1 << 20) - 1), rows))


def element_counts(df: DataFrame, text_col: str, gram: int = 1, bits: int = COUNT_BITS) -> np.ndarray:
    """How often each hashed element occurs in all rows; the table has 2**bits entries whatever the data."""
    width = 1 << bits
    parts = min(COUNT_PARTS, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = _Tokenizer(gram), np.zeros(width, dtype=np.int64)
        for batch in batches:
            found, _, _ = own.elements(batch.column(0).to_pylist())
            total += np.bincount((found >> _U(64 - bits)).astype(np.int64), minlength=width)
        if total.any():
            for part, piece in enumerate(np.minimum(total, 2**31 - 1).astype(np.int32).reshape(parts, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([zlib.compress(piece.tobytes(), 1)])], names=["part", "counts"])

    def add(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(piece), dtype=np.int32).astype(np.int64) for piece in pieces["counts"])
        return pd.DataFrame({"part": [key[0]], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})

    sent = df.select(F.col(text_col).cast("string")).mapInArrow(count, "part long, counts binary")
    summed = sent.groupBy("part").applyInPandas(add, "part long, counts binary").collect()  # 2**bits numbers at most
    table = np.zeros((parts, width // parts), dtype=np.int32)
    for row in summed:
        table[row["part"]] = np.frombuffer(row["counts"], dtype=np.int32)
    return table.reshape(-1)


def _paths(
    found: np.ndarray, rows: np.ndarray, sizes: np.ndarray, counts: np.ndarray, need: np.ndarray, trie: Trie, sets: int, share: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, path, position of the path's last element, without those of the path before it, block, length, and whether
    more sets are expected than a leaf has, of all paths under which the rows' sets are stored.

    found, rows, counts: elements in global order within each row; need: least overlap by row; share: a number by row
    that tells its block. The block is 0 but where two blocks of a node meet: there sets of one block have the same.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    position = np.arange(len(found)) - starts[rows]
    first = position <= (sizes - need)[rows]
    at = np.flatnonzero(first & (counts > 1))  # an element that one row alone holds is shared by none
    row, path, estimate = rows[at], found[at], counts[at].astype(np.float64)
    out: list[tuple[np.ndarray, ...]] = []
    for depth in range(1, trie.depth + 1):
        hot = estimate > trie.limit
        # the elements of the path before the last one are common too: only those beyond them count for the bound
        none = np.zeros(int((~hot).sum()), dtype=np.int64)
        out.append((row[~hot], path[~hot], position[at[~hot]] - (depth - 1), none, none + depth, estimate[~hot] > trie.leaf))
        at, row, path, estimate = at[hot], row[hot], path[hot], estimate[hot]
        if not len(at):
            break
        if depth == trie.depth:
            blocks = np.ceil(estimate / trie.limit).astype(np.int64)
            node = np.repeat(np.arange(len(at)), blocks)
            other = np.arange(len(node)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            own = (share[row] % blocks.astype(_U)).astype(np.int64)[node]
            cell = np.minimum(own, other) * blocks[node] + np.maximum(own, other) + 1
            out.append((row[node], _mix(path[node] + cell.astype(_U)), position[at[node]] - (depth - 1), np.where(own == other, 0, own + 1), np.full(len(node), depth), np.ones(len(node), dtype=bool)))
            break
        # children: the next common element lies at most one position further than the last bound
        last = starts[row] + np.minimum((sizes - need)[row] + depth, sizes[row] - 1)
        width = np.maximum(last - at, 0)
        parent = np.repeat(np.arange(len(at)), width)
        child = np.arange(len(parent)) - np.repeat(np.cumsum(width) - width, width) + at[parent] + 1
        keep = counts[child] > 1
        parent, child = parent[keep], child[keep]
        row, path = row[parent], _mix(path[parent] * _U(0x9E3779B97F4A7C15) + found[child])
        estimate = estimate[parent] * counts[child] / max(sets, 1)
        at = child
    return tuple(np.concatenate(x) for x in zip(*out))


#: Words of 64 bits in the signature of every set, and in the second one that large sets have besides.
SHORT, LONG = 2, 6
#: Elements beyond which a set has the second signature.
LARGE = 150


def _marked(words: int) -> int:
    """The rarest elements of a set that a signature holds: about half of its bits are then set."""
    return int(words * 64 * 0.693)


def _marks(found: np.ndarray, rows: np.ndarray, sizes: np.ndarray, edges: np.ndarray, words: int, salt: int) -> list[np.ndarray]:
    """Words of 64 bits by row that has elements, from its first elements in global order."""
    rank = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = (found >> _U(salt)) % _U(words * 64)
    bit = np.where(rank < _marked(words), _U(1) << (place & _U(63)), _U(0))
    return [np.bitwise_or.reduceat(np.where(place >> _U(6) == _U(k), bit, _U(0)), edges).view(np.int64) for k in range(words)]


def _may_reach(apart: np.ndarray, n: np.ndarray, m: np.ndarray, need: np.ndarray, words: int) -> np.ndarray:
    """Whether sets of sizes n and m whose signatures differ in ``apart`` bits can share ``need`` elements."""
    marked, other = np.minimum(n, _marked(words)), np.minimum(m, _marked(words))
    behind = np.maximum(n - marked, m - other)  # elements that can be shared without being marked
    return apart <= marked + other - 2 * (need - behind)


#: A stored node: its path, the position of its last element, its block, its depth, and whether its subtree is large.
_NODE = np.dtype([("path", "<i8"), ("pos", "<i4"), ("block", "<i4"), ("depth", "u1"), ("large", "u1")])


def signatures(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, gram: int = 1, trie: Trie = Trie()) -> DataFrame:
    """One row per row of ``df`` that has elements: ``rid``, class key (``c1``, ``c2``), size ``n``, bit
    signature (``b0``, ``b1``), ``nodes``, the trie paths under which the set is stored, packed, and ``window``, the
    first elements of the set in global order.

    Texts with the same elements have the same class key (a 128-bit hash of the multiset). A task gives the
    nodes of a class once and leaves them null for further copies.
    """
    source = df.select(F.col(id_col).alias("rid"), F.col(text_col).cast("string").alias("body")).where("rid is not null and body is not null")
    ratio = Fraction(str(threshold))
    table = df.sparkSession.sparkContext.broadcast(element_counts(source, "body", gram))
    bits = COUNT_BITS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, seen = _Tokenizer(gram), table.value, set()
        sets = int(counts.max(initial=1))
        for batch in batches:
            found, rows, sizes = own.elements(batch.column(1).to_pylist())
            used = np.flatnonzero(sizes > 0)
            if not len(used):
                continue
            edges = (np.cumsum(sizes) - sizes)[used]
            keys = [np.add.reduceat(_mix(found + _U(salt)), edges).view(np.int64) for salt in (0x1B873593, 0xCC9E2D51)]
            count = counts[(found >> _U(64 - bits)).astype(np.int64)]
            order = _rarest_first(found, rows, count)
            marks = _marks(found[order], rows, sizes, edges, SHORT, 0)
            large = sizes[used] > LARGE
            more = np.stack(_marks(found[order], rows, sizes, edges, LONG, 7), axis=1)
            more = [bits.tobytes() if is_large else None for bits, is_large in zip(more, large.tolist())]
            need = -(-sizes * ratio.numerator // ratio.denominator)
            share = np.zeros(len(sizes), dtype=_U)
            share[used] = keys[1].view(_U)
            row, path, position, block, depth, wide = _paths(found[order], rows, sizes, count[order], need, trie, sets, share)
            by_row = np.lexsort((position, row))
            row, stored = row[by_row], np.zeros(len(row), dtype=_NODE)
            stored["path"], stored["pos"], stored["block"] = path[by_row].view(np.int64), position[by_row], block[by_row]
            stored["depth"], stored["large"] = depth[by_row], wide[by_row]
            # what a task may meet on its way down, in 16 bits each: two elements that fall together cost a comparison
            parts = (found[order] >> _U(20)).astype(np.uint16)
            begun, held = np.cumsum(sizes) - sizes, np.minimum(sizes, sizes - need + trie.depth + trie.down)
            ends = np.searchsorted(row, np.append(used, len(sizes)))
            nodes, windows = [], []
            if len(seen) > MEMO_WORDS:
                seen.clear()
            for k, key in enumerate(zip(keys[0].tolist(), keys[1].tolist())):
                known = key in seen
                nodes.append(None if known else stored[ends[k] : ends[k + 1]].tobytes())
                windows.append(None if known else parts[begun[used[k]] : begun[used[k]] + held[used[k]]].tobytes())
                seen.add(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(used)), *map(pa.array, keys), pa.array(sizes[used].astype(np.int32)), *map(pa.array, marks), pa.array(more, type=pa.binary()), pa.array(nodes, type=pa.binary()), pa.array(windows, type=pa.binary())],
                names=["rid", "c1", "c2", "n", "b0", "b1", "more", "nodes", "window"],
            )

    kind = source.schema["rid"].dataType.simpleString()
    return source.mapInArrow(sign, f"rid {kind}, c1 long, c2 long, n int, b0 long, b1 long, more binary, nodes binary, window binary")


def _nodes(signed: DataFrame, ratio: Fraction, trie: Trie) -> DataFrame:
    """One row per class and stored node; ``size`` holds the set's size and the position in the node, ``before`` the path
    stored before it. Where two blocks meet it is the block instead: sets of one block do not meet there. Where the
    subtree is large, ``rest`` has the elements that can be the next ones, else nothing."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(6).to_pylist()
            times = np.array([len(x) // _NODE.itemsize for x in packed], dtype=np.int64)
            stored = np.frombuffer(b"".join(packed), dtype=_NODE)
            c1, c2, n, b0, b1 = (np.repeat(batch.column(k).to_numpy(), times) for k in range(5))
            more = batch.column(5).take(pa.array(np.repeat(np.arange(batch.num_rows), times)))
            before, same = np.zeros(len(stored), dtype=np.int64), np.repeat(np.arange(len(times)), times)
            before[1:] = np.where((same[1:] == same[:-1]) & (stored["block"][:-1] == 0), stored["path"][:-1], 0)
            windows = batch.column(7).to_pylist()
            flat = np.frombuffer(b"".join(windows), dtype=np.uint16)
            begun = np.concatenate([[0], np.cumsum([len(x) // 2 for x in windows])])[same]
            need = -(-n.astype(np.int64) * ratio.numerator // ratio.denominator)
            depth = stored["depth"].astype(np.int64)
            first = stored["pos"] + depth
            width = np.where(stored["large"] > 0, np.maximum(np.minimum(n, n - need + depth + trie.down) - first, 0), 0)
            ends = np.concatenate([[0], np.cumsum(width)])
            place = np.arange(ends[-1]) - np.repeat(ends[:-1], width) + np.repeat(begun + first, width)
            rest = pa.Array.from_buffers(pa.binary(), len(stored), [None, pa.py_buffer((ends * 2).astype(np.int32).tobytes()), pa.py_buffer(flat[place].tobytes())])
            columns = [stored["path"], np.where(stored["block"] > 0, stored["block"], before), c1, c2, n.astype(np.int64) << 32 | stored["pos"], stored["depth"].astype(np.int32), b0, b1]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in columns), more, rest], names=["path", "before", "c1", "c2", "size", "depth", "b0", "b1", "more", "rest"])

    schema = "path long, before long, c1 long, c2 long, size long, depth int, b0 long, b1 long, more binary, rest binary"
    return signed.where("nodes is not null").select("c1", "c2", "n", "b0", "b1", "more", "nodes", "window").mapInArrow(unpack, schema)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The rows of stored nodes as numbers; ``more`` as a matrix that is zero where a set is not large."""
    rows = {k: batch.column(k).to_numpy() for k in batch.schema.names if k not in ("more", "rest")}
    rows["rest"] = np.empty(batch.num_rows, dtype=object)
    rows["rest"][:] = batch.column("rest").to_pylist()
    more = batch.column("more")
    held = more.is_valid().to_numpy(zero_copy_only=False)
    rows["more"] = np.zeros((len(held), LONG), dtype=_U)
    if held.any():
        rows["more"][held] = np.frombuffer(b"".join(more.drop_null().to_pylist()), dtype=_U).reshape(-1, LONG)
    return rows


def _runs(path: np.ndarray) -> np.ndarray:
    """How many rows have the path of each row; rows come by path."""
    starts = np.flatnonzero(np.append(True, path[1:] != path[:-1]))[: len(path)]
    sizes = np.diff(np.append(starts, len(path)))
    return np.repeat(sizes, sizes)


def _down(node: dict[str, np.ndarray], top: int, bottom: int, trie: Trie) -> dict[str, np.ndarray]:
    """The rows with those of large subtrees one level or more further down, where the subtrees are small.

    The common elements so far are carried along as the depth. A set goes to the child of each element that can be
    the next common one: the overlap still needed must lie behind it. Sets that are so small that what is common
    already may suffice also stay where they are.
    """
    column = {"path": node["path"], "pos": node["size"] & 0xFFFFFFFF, "depth": node["depth"].astype(np.int64), "source": np.arange(len(node["path"]))}
    n = node["size"] >> 32
    need = -(-n * top // bottom)
    lengths = np.array([len(x) // 2 for x in node["rest"]], dtype=np.int64)
    flat = np.frombuffer(b"".join(node["rest"]), dtype=np.uint16)
    column["from"] = np.cumsum(lengths) - lengths
    limit = column["from"] + lengths
    done = []
    for _ in range(trie.down):
        source = column["source"]
        go = (_runs(column["path"]) > trie.leaf) & (lengths[source] > 0)
        stay = ~go | (need[source] <= column["depth"])
        done.append({k: x[stay] for k, x in column.items()})
        column = {k: x[go] for k, x in column.items()}
        source = column["source"]
        if not len(source):
            break
        width = np.maximum(np.minimum(n[source] - need[source] + 1 - column["pos"], limit[source] - column["from"]), 0)
        parent = np.repeat(np.arange(len(source)), width)
        step = np.arange(len(parent)) - np.repeat(np.cumsum(width) - width, width)
        place = column["from"][parent] + step
        path = _mix(column["path"].view(_U)[parent] * _U(0x9E3779B97F4A7C15) + flat[place].astype(_U) + _U(1)).view(np.int64)
        child = {"path": path, "pos": column["pos"][parent] + step, "depth": column["depth"][parent] + 1, "source": source[parent], "from": place + 1}
        order = np.argsort(child["path"], kind="stable")
        child = {k: x[order] for k, x in child.items()}
        several = _runs(child["path"]) > 1
        column = {k: x[several] for k, x in child.items()}
    else:
        done.append(column)
    whole = {k: np.concatenate([x[k] for x in done]) for k in column}
    size = n[whole["source"]]
    order = np.lexsort((whole["source"], size, whole["path"]))
    source = whole["source"][order]
    out = {k: x[source] for k, x in node.items() if k not in ("path", "size", "depth", "rest")}
    return out | {"path": whole["path"][order], "size": size[order] << 32 | whole["pos"][order]}


def _pairs(node: dict[str, np.ndarray], top: int, bottom: int, trie: Trie) -> Iterator[pa.RecordBatch]:
    """Pairs of sets at the same node that pass the bounds; rows come by path, then size."""
    if (_runs(node["path"]) > trie.leaf).any():
        node = _down(node, top, bottom, trie)
    path, c1, c2 = node["path"], node["c1"], node["c2"]
    copy = np.append(False, (path[1:] == path[:-1]) & (node["size"][1:] == node["size"][:-1]) & (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1]))
    if copy.any():
        node = {k: x[~copy] for k, x in node.items()}
        path, c1, c2 = node["path"], node["c1"], node["c2"]
    group = np.append(0, np.cumsum(path[1:] != path[:-1]))
    n, pos, before = node["size"] >> 32, node["size"] & 0xFFFFFFFF, node["before"]
    b0, b1 = node["b0"].view(_U), node["b1"].view(_U)  # bits of a signed number would be those of its amount
    # the larger set has at most n * bottom / top elements
    reach = np.searchsorted(group * (1 << 40) + n, group * (1 << 40) + n * bottom // top, side="right")
    count = reach - np.arange(len(n)) - 1
    done = np.cumsum(count)
    start = 0
    while start < len(n):
        base = done[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(done, base + PAIRS_AT_ONCE, side="right")))
        some = count[start:end]
        a = np.repeat(np.arange(start, end), some)
        b = np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some) + a + 1
        start = end
        need = -(-(top * (n[a] + n[b])) // (top + bottom))
        keep = (pos[a] + need <= n[a]) & (pos[b] + need <= n[b])
        a, b, need = a[keep], b[keep], need[keep]
        keep = (before[a] != before[b]) | (before[a] == 0)  # else the pair has met at the node before
        a, b, need = a[keep], b[keep], need[keep]
        apart = np.bitwise_count(b0[a] ^ b0[b]).astype(np.int64) + np.bitwise_count(b1[a] ^ b1[b])
        keep = _may_reach(apart, n[a], n[b], need, SHORT) & ((c1[a] != c1[b]) | (c2[a] != c2[b]))
        a, b, need = a[keep], b[keep], need[keep]
        large = np.flatnonzero((n[a] > LARGE) & (n[b] > LARGE))
        if len(large):
            x, y = a[large], b[large]
            apart = np.bitwise_count(node["more"][x] ^ node["more"][y]).sum(axis=1, dtype=np.int64)
            keep = np.ones(len(a), dtype=bool)
            keep[large] = _may_reach(apart, n[x], n[y], need[large], LONG)
            a, b = a[keep], b[keep]
        if len(a):
            first = (c1[a] < c1[b]) | (c1[a] == c1[b]) & (c2[a] < c2[b])
            a, b = np.where(first, a, b), np.where(first, b, a)
            found = np.unique(np.stack([c1[a], c2[a], c1[b], c2[b]]), axis=1)  # a pair can meet in several subtrees
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a1", "a2", "z1", "z2"])


def candidates(signed: DataFrame, threshold: float = 0.8, trie: Trie = Trie()) -> DataFrame:
    """Pairs of classes that share a node of the trie and pass its bounds: their keys a1, a2 and z1, z2, the smaller one first."""
    ratio = Fraction(str(threshold))
    top, bottom = ratio.numerator, ratio.denominator

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _columns(batch)
            if rest:
                rows = {k: np.concatenate([rest[k], x]) for k, x in rows.items()}
            end = int(np.searchsorted(rows["path"], rows["path"][-1]))
            rest = {k: x[end:] for k, x in rows.items()}
            if end:
                yield from _pairs({k: x[:end] for k, x in rows.items()}, top, bottom, trie)
        if rest:
            yield from _pairs(rest, top, bottom, trie)

    in_order = _nodes(signed, ratio, trie).repartition("path").sortWithinPartitions("path", "size", "c1", "c2")
    return in_order.mapInArrow(walk, "a1 long, a2 long, z1 long, z2 long").distinct()


def _similar(threshold: float, gram: int):
    """A column function that tells whether two texts reach the threshold, by their words."""
    ratio = Fraction(str(threshold))

    def bag(text: str) -> Counter:
        words = _WORD.findall(text.lower())
        return Counter(words) if gram == 1 else Counter(zip(*(words[k:] for k in range(gram))))

    @F.pandas_udf("boolean")
    def reach(left: pd.Series, right: pd.Series) -> pd.Series:
        out, known, own = [], None, Counter()
        for x, y in zip(left, right):
            if x != known:
                known, own = x, bag(x)
            other = bag(y)
            shared = sum(min(k, other[w]) for w, k in own.items() if w in other)
            either = own.total() + other.total() - shared
            out.append(ratio.denominator * shared >= ratio.numerator * either)
        return pd.Series(out, dtype=bool)

    return reach


def similar_classes(
    df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, gram: int = 1, trie: Trie = Trie()
) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with the same elements, and the links between classes.

    Returns members (``rid``, ``c1``, ``c2``: one row per id) and links (``a1``, ``a2``, ``z1``, ``z2``:
    one row per pair of different classes whose similarity, the multisets' overlap over their union,
    reaches ``threshold``).

    Rows with a null id or text, and texts without words, belong to no class. A repeated row gives one
    member; where one id comes with different texts it is a member of each text's class. Ties can't
    occur: the threshold is compared in whole numbers. An empty table gives empty results. Other columns
    of ``df`` are ignored.
    """
    signed = cut(signatures(df, id_col, text_col, threshold, gram, trie))
    members = signed.select("rid", "c1", "c2").distinct()
    pairs = cut(candidates(signed, threshold, trie))
    ends = pairs.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).union(pairs.select("z1", "z2")).distinct()
    heads = signed.select("rid", "c1", "c2").join(ends, ["c1", "c2"], "left_semi").groupBy("c1", "c2").agg(F.min("rid").alias("rid"))
    source = df.select(F.col(id_col).alias("rid"), F.col(text_col).cast("string").alias("body")).where("rid is not null and body is not null")
    texts = cut(heads.join(source, "rid").groupBy("c1", "c2").agg(F.min("body").alias("body")))
    left = texts.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("body").alias("left"))
    right = texts.select(F.col("c1").alias("z1"), F.col("c2").alias("z2"), F.col("body").alias("right"))
    checked = pairs.join(left, ["a1", "a2"]).join(right, ["z1", "z2"])
    links = checked.where(_similar(threshold, gram)("left", "right")).select("a1", "a2", "z1", "z2")
    return members, links


def similar_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, gram: int = 1, trie: Trie = Trie()) -> DataFrame:
    """All pairs of different ids whose texts reach the threshold: ``id_a`` < ``id_b``. See similar_classes for odd rows."""
    members, links = similar_classes(df, id_col, text_col, threshold, gram, trie)
    links = cut(links)
    one = members.select(F.col("rid").alias("x"), "c1", "c2")
    crowded = members.groupBy("c1", "c2").count().where("count > 1").select("c1", "c2")
    same = one.join(crowded, ["c1", "c2"], "left_semi")
    copies = same.join(same.withColumnRenamed("x", "y"), ["c1", "c2"]).where("x < y").select("x", "y")
    across = (
        links.join(one.select("x", F.col("c1").alias("a1"), F.col("c2").alias("a2")), ["a1", "a2"])
        .join(one.select(F.col("x").alias("y"), F.col("c1").alias("z1"), F.col("c2").alias("z2")), ["z1", "z2"])
        .where("x <> y")
        .select("x", "y")
    )
    both = copies.union(across)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similar_links(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, gram: int = 1) -> DataFrame:
    """One row per id with words: ``class_id`` (the smallest id with the same elements) and ``n_links``
    (other ids that reach the threshold), counted over classes, so copies are not expanded."""
    members, links = similar_classes(df, id_col, text_col, threshold, gram)
    classes = members.groupBy("c1", "c2").agg(F.min("rid").alias("class_id"), F.count(F.lit(1)).alias("size"))
    both = links.union(links.select("z1", "z2", "a1", "a2")).toDF("c1", "c2", "o1", "o2")
    other = classes.select(F.col("c1").alias("o1"), F.col("c2").alias("o2"), F.col("size").alias("other"))
    linked = both.join(other, ["o1", "o2"]).groupBy("c1", "c2").agg(F.sum("other").alias("linked"))
    counted = classes.join(linked, ["c1", "c2"], "left").withColumn("n_links", F.col("size") - 1 + F.coalesce("linked", F.lit(0)))
    return members.join(counted, ["c1", "c2"]).select(F.col("rid").alias("id"), "class_id", "n_links")
