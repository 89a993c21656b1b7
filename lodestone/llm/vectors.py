"""Integer vectors: what the search, the clustering and the whitening share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components must lie below this in size: then products and squared distances of thousands of them stay exact.
LIMIT = 1 << 23


def usable(vector: Column) -> Column:
    """True for vectors that are there, without null, NaN or infinite components. Never null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def scaled(df: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the usable vectors, x = floor(scale * component) as longs. Other columns are left out."""
    v = F.col(vector_col)
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return df.where(usable(v)).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as int64; shorter ones are filled up with zeros to the longest, or to width."""
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if flat.size and max(int(flat.max()), -int(flat.min())) >= LIMIT:
        raise ValueError(f"scaled components have to be below {LIMIT} in size")
    width = max(int(size.max(initial=0)), width or 0)
    if flat.size == width * len(size):
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(flat.size) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
