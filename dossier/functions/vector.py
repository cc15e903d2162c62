"""Vector helpers: Arrow-batched, zero-copy from list columns to NumPy.

Vectors are ``array<float>`` or ``array<double>`` of one common length.
Rows without a vector must be filtered out first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

# float32 products are only used to select candidates; this margin covers
# their rounding error before the exact float64 test.
CANDIDATE_MARGIN = 1e-4


def as_matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a (n, d) matrix without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size % len(column):
        raise ValueError("vectors must be present and of one common length")
    return flat.reshape(len(column), -1)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in float64; zero rows stay zero."""
    matrix = matrix.astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def as_list_column(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


@F.arrow_udf(ArrayType(DoubleType()))
def unit(vector: pa.Array) -> pa.Array:
    """L2-normalised vector; a zero vector stays zero."""
    return as_list_column(unit_rows(as_matrix(vector)))


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity of a vector column to one given query vector."""
    target = unit_rows(np.asarray([query]))[0]

    @F.arrow_udf(DoubleType())
    def score(batch: pa.Array) -> pa.Array:
        return pa.array(unit_rows(as_matrix(batch)) @ target)

    return score(vector)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, 0 when either is a zero vector (JVM-side)."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


DIGEST = ["digest_1", "digest_2"]


def with_digest(frame: DataFrame, vector: str = "vector") -> DataFrame:
    """Add two 64-bit digests of different seeds that stand for a vector as a key."""
    return frame.withColumns({
        "digest_1": F.xxhash64(vector), "digest_2": F.xxhash64(F.lit(0x5EED), F.col(vector)),
    })
