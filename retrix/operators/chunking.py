"""Chunkers: one text in, several rows out.

Windows are plain expressions. Greedy packing depends on what was packed before, so it runs as a fold per
text in Arrow batches, where the texts lie; no chunker shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrix.functions.text import ENTITIES, words

#: Separators from the strongest on, sizes by language, factors by complexity.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SIZES = {"python": 500, "javascript": 450, "typescript": 450, "java": 600, "csharp": 600}
COMPLEXITY = {"low": 1.2, "medium": 1.0, "high": 0.8}


def char_windows(df: DataFrame, id_col: str, text_col: str, window: int = 400, stride: int = 200) -> DataFrame:
    """Windows of characters, one every ``stride``, those at the end cut short: ``id``, ``pos``, ``start``, ``chunk``.
    Null and empty texts give none."""
    used = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where(F.length("body") > 0)
    starts = F.sequence(F.lit(0), F.length("body") - 1, F.lit(stride))
    return used.select("id", "body", F.posexplode(starts).alias("pos", "start")).select("id", "pos", "start", F.expr(f"substring(body, start + 1, {window})").alias("chunk"))


def word_windows(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0) -> DataFrame:
    """Windows of words joined by blanks, one every ``size`` - ``overlap`` words: ``id``, ``pos``, ``n_words``, ``chunk``."""
    used = df.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.size("ws") - 1, F.lit(size - overlap))
    cut = used.select("id", "ws", F.posexplode(starts).alias("pos", "start")).select("id", "pos", F.slice("ws", F.col("start") + 1, F.lit(size)).alias("part"))
    return cut.select("id", "pos", F.size("part").alias("n_words"), F.array_join("part", " ").alias("chunk"))


def with_overlap(chunks: DataFrame, overlap: int) -> DataFrame:
    """Each chunk with the last characters of the original one before it in front."""
    before = F.lag("chunk").over(Window.partitionBy("id").orderBy("pos"))
    return chunks.withColumn("chunk", F.when(before.isNull(), F.col("chunk")).otherwise(F.concat(F.right(before, F.lit(overlap)), "chunk")))


def optimal_size(language: Column, complexity: str = "medium") -> Column:
    """Chunk size for a language, 500 where it is not known."""
    table = F.create_map(*(x for k, v in SIZES.items() for x in (F.lit(k), F.lit(v))))
    return F.floor(F.coalesce(table[language], F.lit(500)) * F.lit(COMPLEXITY[complexity])).cast("int")


def combine(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Packs pieces, joined by blanks, while they fit; a new chunk begins with the end of the one before."""
    out: list[str] = []
    current = ""
    for piece in pieces:
        joined = f"{current} {piece}" if current else piece
        if len(joined) <= size or not current:
            current = joined
        else:
            out.append(current)
            current = f"{current[-overlap:]} {piece}" if overlap else piece
    return [*out, current] if current else out


def recursive(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Splits by the first separator; pieces that are too long by the next one; then packs on every level."""
    if len(text) <= size:
        return [text]
    separator, rest = separators[0], separators[1:]
    if separator == "":
        return [text[at : at + size] for at in range(0, len(text), max(size - overlap, 1))]
    pieces: list[str] = []
    for piece in text.split(separator):
        pieces += [piece] if len(piece) <= size else recursive(piece, size, overlap, rest)
    return combine([p for p in pieces if p], size, overlap)


def structural(text: str, size: int = 1000) -> list[str]:
    """Paragraphs packed while their lengths add up to the size at most; separators don't count."""
    out, current, used = [], [], 0
    for paragraph in re.split(r"\n{2,}", text):
        if current and used + len(paragraph) > size:
            out.append("\n\n".join(current))
            current, used = [], 0
        current.append(paragraph)
        used += len(paragraph)
    return [c for c in [*out, "\n\n".join(current)] if c]


def by_lines(text: str, target: int = 500) -> list[str]:
    """Lines packed until the next one would exceed the target; line ends don't count."""
    out, current, used = [], [], 0
    for line in text.split("\n"):
        if current and used + len(line) > target:
            out.append("\n".join(current))
            current, used = [], 0
        current.append(line)
        used += len(line)
    return [*out, "\n".join(current)] if current else out


def semantic(text: str, threshold: float = 0.5, longest: int = 1000, shortest: int = 0) -> list[str]:
    """Sentences joined while the running mean of their vectors stays similar; chunks below ``shortest`` are dropped."""
    import numpy as np

    from retrix.operators.models import hash_vector

    out, current, mean = [], "", None
    for sentence in (s.strip() for s in re.split(r"(?<=[.!?])\s+", text)):
        if not sentence:
            continue
        vector = hash_vector(sentence)
        near = mean is not None and float(np.dot(mean, vector)) / ((np.linalg.norm(mean) * np.linalg.norm(vector)) or 1.0) >= threshold
        if current and (not near or len(current) + len(sentence) + 1 > longest):
            out.append(current)
            current, mean = sentence, vector
        else:
            current, mean = (f"{current} {sentence}", (mean + vector) / 2) if current else (sentence, vector)
    return [c for c in ([*out, current] if current else out) if len(c) >= shortest]


def semantic_enhanced(text: str, threshold: float = 0.6, longest: int = 512) -> list[str]:
    """Sentences joined while they are similar to the mean of all vectors of the chunk so far and their lengths add up
    to ``longest`` at most; short chunks are kept."""
    import numpy as np

    from retrix.operators.models import hash_vector

    out: list[list[str]] = []
    total, used = None, 0
    for sentence in (s.strip() for s in re.split(r"(?<=[.!?])\s+", text)):
        if not sentence:
            continue
        vector = hash_vector(sentence)
        near = out and float(np.dot(total, vector)) / ((np.linalg.norm(total) * np.linalg.norm(vector)) or 1.0) >= threshold  # a sum points where the mean does
        if near and used + len(sentence) <= longest:
            out[-1].append(sentence)
            total, used = total + vector, used + len(sentence)
        else:
            out.append([sentence])
            total, used = vector, len(sentence)
    return [" ".join(group) for group in out]


def hybrid(text: str, size: int = 1000, overlap: int = 50) -> list[str]:
    """Paragraph packing, with semantic cuts inside what is still too long; each chunk begins with the end of the
    original one before it."""
    plain = [c for block in structural(text, size) for c in (semantic_enhanced(block) if len(block) > size else [block])]
    if overlap <= 0:
        return plain
    return [f"{before[-overlap:]} {c}".strip() for before, c in zip(["", *plain], plain)]


def entity_names(text: str) -> set[str]:
    """Entities of a text by the patterns of ``functions.text``, of more than two characters."""
    return {x for p, g in ENTITIES for x in (m.group(g).strip() for m in re.finditer(p, text)) if len(x) > 2}


def entity_aware(text: str, size: int = 1000) -> list[str]:
    """Sentences joined while they share an entity with those of the chunk so far, and fit."""
    names = {n: n.lower() for n in entity_names(text)}
    out: list[list[str]] = []
    held: set[str] = set()
    for sentence in re.split(r"(?<=[.!?]) +", text):
        low = sentence.lower()
        own = {n for n, x in names.items() if x in low}
        if out and held & own and len(" ".join([*out[-1], sentence])) <= size:
            out[-1].append(sentence)
            held |= own
        else:
            out.append([sentence])
            held = set(own)
    return [" ".join(group) for group in out]


def sentence_packs(text: str, tokens: int = 250, overlap: int = 50) -> list[str]:
    """Sentences packed up to a count of tokens (1.3 a word); a new chunk begins with the last words of the one before."""
    out, current, used = [], "", 0.0
    for sentence in (s.strip() + ". " for s in text.split(". ")):
        count = len(sentence.split()) * 1.3
        if current and used + count > tokens:
            out.append(current.strip())
            current = f"{' '.join(current.split()[-overlap:])} {sentence}" if overlap else sentence
            used = len(current.split()) * 1.3
        else:
            current, used = current + sentence, used + count
    return [*out, current.strip()] if current.strip() else out


STRATEGIES: dict[str, Callable[..., list[str]]] = {
    "recursive": recursive, "structural": structural, "lines": by_lines, "semantic": semantic, "semantic_basic": semantic, "semantic_enhanced": semantic_enhanced, "topic_based": semantic, "hybrid": hybrid,
    "sliding_window": lambda text, window=400, stride=200: [text[at : at + window] for at in range(0, len(text), stride)],
    "entity_aware": entity_aware, "sentence_packs": sentence_packs,
}


def chunk(df: DataFrame, id_col: str, text_col: str, strategy: str = "hybrid", entities: bool = False, **how) -> DataFrame:
    """Chunks of every text by a named strategy: ``id``, ``pos`` (its place before blank chunks are dropped), ``chunk``
    and, if wanted, ``entities``, those of the whole text. Null texts give none; an unknown strategy is an error."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    split = STRATEGIES[strategy]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, pieces, named = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = sorted(entity_names(text)) if entities else None
                for place, piece in enumerate(split(text, **how)):
                    if piece.strip():
                        rows.append(k), places.append(place), pieces.append(piece), named.append(found)
            columns = [batch.column(0).take(pa.array(rows, type=pa.int64())), pa.array(places, type=pa.int32()), pa.array(pieces, type=pa.string())]
            if entities:
                columns.append(pa.array(named, type=pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "pos", "chunk", "entities"][: len(columns)])

    used = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).where(F.col("body").isNotNull())
    return used.mapInArrow(cut, f"id {df.schema[id_col].dataType.simpleString()}, pos int, chunk string" + ", entities array<string>" * entities)
