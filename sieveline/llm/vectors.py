"""What the vector operators share: valid rows, copies collapsed, packed blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(table: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows whose vector is neither null, empty nor zero and has no null
    or non-finite component; rows without an id are left out."""
    v = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one width as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, in double precision."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))
