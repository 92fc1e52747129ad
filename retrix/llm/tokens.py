"""Encoding of whole corpora with a byte-level BPE, by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can be crossed by no merge, so the text may be
cut between the two bytes and the fragments encoded on their own. Cuts are taken only where the split
pattern that runs before the merges gives the same pieces on both sides:

* the byte before the cut is not the end of a white-space character, because the pattern looks ahead
  over runs of white space;
* the byte after the cut starts a character and is no apostrophe, because a contraction is tried at the
  start of a piece only.

Equal fragments have equal ids, so each task encodes a fragment once and looks it up afterwards.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the public split pattern of this family of byte-level vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of text that are cut and looked up at once, and fragments that a task remembers.
SLICE_BYTES = 4 << 20
MEMO_FRAGMENTS = 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def crossable_pairs(tokens) -> np.ndarray:
    """A table over all pairs of bytes: True where some token holds the pair inside."""
    table = np.zeros(1 << 16, dtype=bool)
    for token in tokens:
        if len(token) > 1:
            raw = np.frombuffer(token, dtype=np.uint8).astype(np.uint16)
            table[raw[:-1] << 8 | raw[1:]] = True
    return table


class ForcedBoundaryEncoder:
    """Encodes slices of UTF-8 text; one per worker process and vocabulary."""

    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        self._encode = tiktoken.Encoding(
            "corpus", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_ordinary
        self.safe = ~crossable_pairs(ranks)
        first = np.arange(256)
        before = (first > 0x20) & (first < 0x7F) | (first >= 0x80)  # ends of wide white space are taken out by position
        after = ((first < 0x80) | (first >= 0xC0)) & (first != ord("'"))
        self.safe &= (before[:, None] & after[None, :]).reshape(-1)
        self._forget()

    def _forget(self) -> None:
        self._memo: dict[bytes, int] = {}
        self._ids: list[list[int]] = []
        self._flat = np.zeros(0, dtype=np.int32)
        self._starts = np.zeros(1, dtype=np.int64)
        self._built = 0

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Positions in ``raw`` before which it may be cut."""
        if len(raw) < 2:
            return np.zeros(0, dtype=np.int64)
        pairs = raw[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= raw[1:]
        at = np.flatnonzero(self.safe[pairs]) + 1
        wide = at[raw[at - 1] >= 0x80]
        if len(wide):
            blank = self._ends_wide_blank(raw, wide)
            if blank.any():
                at = np.setdiff1d(at, wide[blank], assume_unique=True)
        return at

    @staticmethod
    def _ends_wide_blank(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the character that ends before ``at`` is white space outside ASCII (or can't be told)."""
        last = raw[at - 1]
        second = np.where(at >= 2, raw[at - 2], 0)
        third = np.where(at >= 3, raw[at - 3], 0)
        two = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
        ogham = (third == 0xE1) & (second == 0x9A) & (last == 0x80)
        general = (third == 0xE2) & (second == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
        medium = (third == 0xE2) & (second == 0x81) & (last == 0x9F)
        ideographic = (third == 0xE3) & (second == 0x80) & (last == 0x80)
        return two | ogham | general | medium | ideographic

    def _codes(self, data: bytes, bounds: list[int]) -> np.ndarray:
        """For each fragment between two bounds the place of its ids in the memo."""
        memo = self._memo
        if len(memo) > MEMO_FRAGMENTS:
            self._forget()
            memo = self._memo
        codes = []
        add = codes.append
        start = 0
        for end in bounds:
            piece = data[start:end]
            start = end
            try:
                add(memo[piece])
            except KeyError:
                code = memo[piece] = len(memo)
                self._ids.append(self._encode(piece.decode("utf-8")))
                add(code)
        if len(self._ids):
            fresh = self._ids
            lengths = np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh))
            flat = np.fromiter((i for ids in fresh for i in ids), dtype=np.int32, count=int(lengths.sum()))
            self._flat = np.concatenate([self._flat, flat])
            self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(lengths)])
            self._ids = []
        return np.array(codes, dtype=np.int64)

    def slice(self, data: bytes, ends: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of tokens, and if ``ids`` the ids one after another, of the texts in ``data`` that end at ``ends``."""
        raw = np.frombuffer(data, dtype=np.uint8)
        bounds = np.union1d(self.cuts(raw), ends[ends > 0])
        codes = self._codes(data, bounds.tolist())
        size = self._starts[codes + 1] - self._starts[codes]
        total = np.concatenate([[0], np.cumsum(size)])
        upto = total[np.searchsorted(bounds, ends, side="right")]
        counts = np.diff(np.concatenate([[0], upto]))
        if not ids:
            return counts, None
        shift = np.repeat(self._starts[codes] - total[:-1], size)
        return counts, self._flat[shift + np.arange(len(shift))]

    def batch(self, texts: pa.Array, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """As ``slice`` for a column of texts; null counts as empty."""
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        counts, parts, at = [], [], 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            upto = min(upto, len(texts))
            low, high = int(offsets[at]), int(offsets[upto])
            n, flat = self.slice(data[low:high].to_pybytes() if data else b"", offsets[at + 1 : upto + 1] - low, ids)
            counts.append(n)
            if ids:
                parts.append(flat)
            at = upto
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(counts) if counts else none), (np.concatenate(parts) if parts else none.astype(np.int32)) if ids else None


def ship(spark: SparkSession, path: str) -> None:
    """Send the vocabulary's file to every executor, if the driver holds it (a few hundred kilobytes to a few megabytes)."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> ForcedBoundaryEncoder:
    """The encoder of a worker process; from the copy that was sent to it, else from the path itself."""
    sent = SparkFiles.get(os.path.basename(path)) if getattr(SparkFiles, "_is_running_on_worker", False) else path
    return ForcedBoundaryEncoder(sent if os.path.exists(sent) else path)


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The ids of every text, without special tokens: columns ``id_col`` and ``ids`` (array<int>).

    One row per input row, in no order. A null and an empty text give the empty list; a null id stays
    null. A text of any length is encoded whole. Other columns of ``df``, whatever their names, are ignored.
    Nothing is shuffled. ``vocabulary`` is a path of the driver; the file is sent to the executors.
    """
    ship(df.sparkSession, vocabulary)
    kind = df.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            counts, flat = own.batch(batch.column(1), ids=True)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(encode, schema)


def token_counter(vocabulary: str = DEFAULT_VOCABULARY):
    """A column function that gives the number of tokens of a text; null counts as empty."""
    import pandas as pd

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counts, _ = encoder(vocabulary).batch(pa.Array.from_pandas(texts, type=pa.string()), ids=False)
        return pd.Series(counts)

    return count


def token_count(text: Column | str, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    return token_counter(vocabulary)(text)
