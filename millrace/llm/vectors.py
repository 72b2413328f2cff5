"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str):
    """Condition: a vector that is not null and has finite components only."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.col(column).isNotNull() & F.forall(column, finite)


def matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    out = np.zeros((len(vectors), dim))
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    at = np.repeat(np.arange(len(vectors)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def sample(vectors: DataFrame, id_column: str, column: str, most: int) -> np.ndarray:
    """At most `most` vectors, the first in the order of a hash of their id."""
    rows = vectors.orderBy(F.xxhash64(id_column), id_column).limit(most).select(column).toArrow()
    sizes = [len(x) for x in rows.column(0)] or [0]
    return matrix(rows.column(0), max(sizes)) if len(rows) else np.zeros((0, 0))


def spread(rows: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """Up to `count` different ones of the rows, each drawn with a weight of its squared distance from those drawn before: a crowd gives few, an outlier is no likelier than it is far."""
    if not len(rows):
        return rows
    rng, square = np.random.default_rng(seed), (rows**2).sum(1)
    apart = lambda i: np.maximum(0.0, square + square[i] - 2 * (rows @ rows[i]))
    chosen, gap = [0], apart(0)
    while len(chosen) < count and gap.max() > 1e-12:
        total = np.cumsum(gap * (gap > 1e-12))
        chosen.append(int(np.searchsorted(total, rng.random() * total[-1], side="right")))
        gap = np.minimum(gap, apart(chosen[-1]))
        gap[chosen[-1]] = 0.0
    return rows[chosen]
