"""Vectors as whole numbers: each component x becomes floor(1024 * x)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1024.0


def complete(x: Column) -> Column:
    """Whether a vector is there and holds neither a null nor a non-finite component."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & finite, F.lit(False))


def largest(d: int) -> int:
    """The largest component that d components can have so that squared distances fit into 63 bits."""
    return math.isqrt((2**63 - 1) // max(d, 1)) // 2


def rows_of(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of d numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def integers(column: pa.Array, d: int) -> np.ndarray:
    """A column of vectors of d components in whole numbers; what is beyond largest(d) is held there."""
    most = largest(d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows_of(column, d).astype(np.float64) * SCALE), -most, most).astype(np.int64)
