"""Expressions over vectors held as arrays. Sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where either vector is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """The vector at length 1; unchanged where its length is 0."""
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def combine(vectors: Column, how: str = "mean") -> Column:
    """One vector out of an array of vectors of one length: element-wise ``mean`` or ``max``."""
    if how not in ("mean", "max"):
        raise ValueError(f"unknown way to combine vectors: {how}")
    fold = (lambda x, y: F.greatest(x, y)) if how == "max" else (lambda x, y: x + y)
    wide = F.transform(vectors, lambda v: F.transform(v, lambda x: x.cast("double")))
    total = F.reduce(F.slice(wide, 2, F.greatest(F.size(wide) - 1, F.lit(0))), F.element_at(wide, 1), lambda acc, v: F.zip_with(acc, v, fold))
    return total if how == "max" else F.transform(total, lambda x: x / F.size(wide))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Value between 0 and 1 within its range; 0.5 where the range is empty."""
    return F.when(high == low, F.lit(0.5)).otherwise((value - low) / (high - low))


#: What the heads' matrices hold. Factual: the unit matrix, every tenth row by 1.2. Conceptual: 0.1 from
#: five places before the diagonal to four behind it. Procedural: 1 on the diagonal and 0.8 behind it, the last row
#: empty. Contextual: 0.1 everywhere. The noise that could be added to them is left out.
FACTUAL, NEAR, NEXT, EVERYWHERE = 1.2, (5, 0.1), 0.8, 0.1


def head_projections(vector: Column) -> dict[str, Column]:
    """A vector times the matrix of each head, by its name."""
    size = F.size(vector)
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    near = lambda k: F.slice(vector, F.greatest(k - NEAR[0] + 2, F.lit(1)), F.least(size, k + NEAR[0] + 1) - F.greatest(k - NEAR[0] + 2, F.lit(1)) + 1)
    return {
        "factual": F.transform(vector, lambda x, k: F.when(k % 10 == 0, x * FACTUAL).otherwise(x)),
        "conceptual": F.transform(vector, lambda x, k: F.aggregate(near(k), F.lit(0.0), lambda a, y: a + y * NEAR[1])),
        "procedural": F.transform(vector, lambda x, k: F.when(k < size - 1, x).otherwise(0.0) + F.when(k > 0, F.get(vector, k - 1) * NEXT).otherwise(0.0)),
        "contextual": F.transform(vector, lambda x, k: total * EVERYWHERE),
    }
