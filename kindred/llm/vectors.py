"""Vectors as whole numbers, and their exact inner products inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.llm.words import column

#: Vectors take part whose inner product with themselves is below this, so that by Cauchy and
#: Schwarz every score fits 64 bits.
LARGEST = 9.0e18


def whole(vector_col: str, scale: int = 256) -> Column:
    """Each component x as floor(scale * x), x as double."""
    return F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))


def usable(vector_col: str, scale: int = 256) -> Column:
    """Not null or empty, only finite components, and scores that fit 64 bits."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    square = F.aggregate(
        vector_col,
        F.lit(0.0),
        lambda total, x: total + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)),
    )
    return F.coalesce(
        F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite & (square < LARGEST),
        F.lit(False),
    )


def matrix(batch: pa.RecordBatch | pa.Table, name: str, width: int) -> np.ndarray:
    """A column of vectors of one length, a row for each, as 64-bit whole numbers."""
    rows = batch[name] if isinstance(batch, pa.Table) else column(batch, name)
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    return rows.flatten().to_numpy().reshape(-1, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, exact in 64 bits."""
    largest = np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0).astype(float)
    if largest * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
