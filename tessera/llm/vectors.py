"""Rows of a vector column as blocks of integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers of entries are held within these bounds, so that sums with small constants stay longs.
BOUND = float(1 << 62)


def whole_entries(vector: str | Column) -> Column:
    """True where a vector is there, has entries, and all are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine), F.lit(False))


def integers(vector: str | Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of each entry, as longs."""
    v = F.col(vector) if isinstance(vector, str) else vector
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * float(scale), F.lit(-BOUND)), F.lit(BOUND))) + F.lit(shift).cast("long")
    return F.transform(v, whole)


def usual_length(rows: DataFrame, vector: str) -> int:
    """The number of entries that most rows have, of equally frequent ones the larger; 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def block(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
