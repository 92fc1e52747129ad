"""Cutting oversized texts at natural boundaries, with overlap.

Every position of a text has a boundary strength. A sparse table holds the strongest boundary of every
window whose length is a power of two, so the strongest cut of any permissible window is found with two
look-ups; positions are part of the value, so among equal strengths the rightmost wins. The next piece
steps back by the overlap.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of the end of a paragraph, sentence, line, word; of any character; inside a joined character.
PARAGRAPH, SENTENCE, LINE, WORD, ANY, JOINED = 5, 4, 3, 2, 1, 0
DEFAULT_SIZE = 500
#: The least share of the size that a piece takes if a boundary is to be preferred at all.
MIN_FILL = 0.5
#: Characters whose strengths are found at once, and windows that a sparse table covers.
BLOCK, WINDOWS = 1 << 20, 8

#: Marks that end sentences, those that do so without a blank after them, and closing marks.
TERMINATORS = ".!?…。！？؟।"
WIDE_TERMINATORS = "。！？"
CLOSERS = "\"')]}»”’"

_SPACE, _NEWLINE, _END, _WIDE, _CLOSE, _MARK, _JOINER = 1, 2, 4, 8, 16, 32, 64
_POINTS = 0x20000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Classes of code points below _POINTS."""
    table = np.zeros(_POINTS, dtype=np.uint8)
    for point in range(_POINTS):
        character = chr(point)
        if character.isspace():
            table[point] |= _SPACE
        if unicodedata.category(character) in ("Mn", "Me", "Mc"):
            table[point] |= _MARK
    for character in "\n\r\x0b\x0c\x85  ":
        table[ord(character)] |= _NEWLINE
    for marks, flag in ((TERMINATORS, _END), (WIDE_TERMINATORS, _WIDE), (CLOSERS, _CLOSE)):
        for character in marks:
            table[ord(character)] |= flag
    table[0x200D] |= _JOINER | _MARK
    table[0x1F3FB:0x1F400] |= _MARK  # skin tones join the character before
    return table


def _points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _kinds(points: np.ndarray) -> np.ndarray:
    kind = _classes()[np.minimum(points, _POINTS - 1)]
    return np.where((points >= 0xE0020) & (points < 0xE01F0), _MARK, kind).astype(np.uint8)


def _flags(points: np.ndarray) -> np.ndarray:
    return (points >= 0x1F1E6) & (points <= 0x1F1FF)


def strengths(text: str) -> np.ndarray:
    """Boundary strength of a cut before each position 0..len(text), a byte each.

    A text is read in blocks that begin at a letter or the like behind another one: there the strengths before and
    behind don't depend on each other, so nothing but the result grows with the text.
    """
    parts, at = [], 0
    while len(text) - at > BLOCK:
        points = _points_of(text[at + BLOCK - 1 : at + BLOCK + 4096])
        plain = (_kinds(points) == 0) & ~_flags(points)
        fit = np.flatnonzero(plain[1:] & plain[:-1])
        shift = BLOCK + (int(fit[0]) if len(fit) else 4096)
        while not len(fit) and at + shift < len(text):  # no such place near: look on
            points = _points_of(text[at + shift - 1 : at + shift + 4096])
            plain = (_kinds(points) == 0) & ~_flags(points)
            fit = np.flatnonzero(plain[1:] & plain[:-1])
            shift += int(fit[0]) if len(fit) else 4096
        if at + shift >= len(text):
            break
        parts.append(_block_strengths(text[at : at + shift])[:-1])
        at += shift
    parts.append(_block_strengths(text[at:]))
    if at:  # the first place of a block is one between two letters
        ends = np.cumsum([len(x) for x in parts[:-1]])
        out = np.concatenate(parts)
        out[ends] = ANY
        return out
    return parts[0]


def _block_strengths(text: str) -> np.ndarray:
    points = _points_of(text)
    n = len(points)
    kind = _kinds(points)
    space = (kind & _SPACE) > 0
    out = np.full(n + 1, ANY, dtype=np.int8)
    after = out[1:]
    after[space] = WORD
    line = (kind & _NEWLINE) > 0
    after[line] = LINE
    # the last character before a run of blanks, without closing marks
    place = np.arange(n, dtype=np.int32)
    solid = np.maximum.accumulate(np.where(space, -1, place))
    bare = np.maximum.accumulate(np.where(space | ((kind & _CLOSE) > 0), -1, place))
    ends = (kind & _END) > 0
    sentence = space & (solid >= 0) & (bare >= 0) & (solid - bare <= 3) & ends[np.maximum(bare, 0)]
    after[sentence] = SENTENCE
    after[(kind & _WIDE) > 0] = SENTENCE
    breaks = np.flatnonzero(line & ~((points == 13) & (np.append(points[1:], 0) == 10)))
    if len(breaks) > 1:
        filled = np.cumsum(~space)
        blank = filled[breaks[1:]] == filled[breaks[:-1]]
        after[breaks[1:][blank]] = PARAGRAPH
    # never between a carriage return and its line feed or inside a joined character, if there is a choice
    joined = np.zeros(n, dtype=bool)
    joined[1:] = ((kind[1:] & _MARK) > 0) | ((kind[:-1] & _JOINER) > 0) | ((points[:-1] == 13) & (points[1:] == 10))
    flag = (points >= 0x1F1E6) & (points <= 0x1F1FF)
    if flag.any():
        start = np.maximum.accumulate(np.where(~flag, place + 1, 0))
        joined |= flag & ((place - start) % 2 == 1)
    out[:-1][joined] = JOINED
    out[n] = PARAGRAPH
    return out


class SparseTable:
    """Range maximum over strengths; answers with the position of the rightmost strongest.

    The table covers the part of the positions that is asked for at the moment, ``WINDOWS`` times the longest
    window, and is built anew further on: it takes the same room for a text of any length. Questions come in
    ascending order, or each builds its own part.
    """

    def __init__(self, values: np.ndarray, longest: int):
        self.values, self.longest = values, max(1, longest)
        self._cover(0)

    def _cover(self, low: int) -> None:
        self.low = low
        part = self.values[low : low + (WINDOWS + 1) * (self.longest + 1)]
        self.high = low + len(part) - 1
        self.levels = [part.astype(np.int64) << 40 | np.arange(low, low + len(part))]
        width = 1
        while width * 2 <= min(self.longest, len(part)):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-width], below[width:]))
            width *= 2

    def strongest(self, low: int, high: int) -> int:
        """Position of the rightmost strongest in low..high, both included, at most ``longest`` of them."""
        if low < self.low or high > self.high:
            self._cover(low)
        level = (high - low + 1).bit_length() - 1
        row = self.levels[level]
        best = max(row[low - self.low], row[high - (1 << level) + 1 - self.low])
        return int(best) & ((1 << 40) - 1)


def cut_points(text: str, size: int, overlap: int, min_fill: float = MIN_FILL) -> list[tuple[int, int]]:
    """Start and end of each piece; one piece where the text fits.

    A cut is sought in the window from ``min_fill`` of the size on, and where that holds no boundary, in what
    lies before it.
    """
    n = len(text)
    if n <= size:
        return [(0, n)]
    overlap = min(max(overlap, 0), size - 1)
    values = strengths(text)
    table = SparseTable(values, size)
    least = max(overlap + 1, int(size * min_fill))
    pieces, start = [], 0
    while n - start > size:
        end = table.strongest(start + least, start + size)
        if values[end] < WORD and least > overlap + 1:
            earlier = table.strongest(start + overlap + 1, start + least - 1)
            end = earlier if values[earlier] >= WORD else end
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, n)]


def split_oversized(
    items: DataFrame,
    id_col: str,
    text_col: str,
    size_col: str,
    overlap_col: str,
    default_size: int = DEFAULT_SIZE,
    min_fill: float = MIN_FILL,
    with_text: bool = True,
) -> DataFrame:
    """Pieces of every text longer than its size: ``id_col``, ``piece_no`` (from 1), ``start``, ``end``
    (code points, end excluded) and, if ``with_text``, ``piece``.

    No piece is longer than the size, each starts ``overlap`` characters before the end of the one before,
    and together they are the whole text. A null size means ``default_size``; a size of zero or less gives no
    piece. A null or negative overlap is none, one of the size or more becomes the size less one. Texts that
    fit, null and empty texts give no piece. Cuts fall inside a joined character only where a window holds
    no other place. A repeated row gives its pieces again. Rows are cut where they lie: no shuffle.
    """
    kind = items.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(default_size))
    used = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("body"), size.alias("size"), F.coalesce(F.col(overlap_col).cast("long"), F.lit(0)).alias("overlap"))
    used = used.where((F.col("size") > 0) & (F.length("body") > F.col("size")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, starts, ends, texts = [], [], [], [], []
            for k, (body, size, overlap) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                for no, (start, end) in enumerate(cut_points(body, size, overlap, min_fill), 1):
                    row.append(k)
                    number.append(no)
                    starts.append(start)
                    ends.append(end)
                    if with_text:
                        texts.append(body[start:end])
            columns = [batch.column(0).take(pa.array(row, type=pa.int64())), *(pa.array(x, type=pa.int32()) for x in (number, starts, ends))]
            names = [id_col, "piece_no", "start", "end"]
            if with_text:
                columns.append(pa.array(texts, type=pa.string()))
                names.append("piece")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return used.mapInArrow(split, f"`{id_col}` {kind}, piece_no int, start int, end int" + ", piece string" * with_text)
