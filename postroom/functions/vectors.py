"""Dense vectors: similarity, pooling, validation.

Similarity runs as an Arrow UDF: a batch of ``array<float>`` arrives as one flat
buffer, so a 768-wide dot product is a single matrix product instead of 768
interpreted lambda calls per row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom import fixed_values as fv

# Distances are kept to 12 decimals so that equal vectors tie exactly, whatever the
# batch they arrive in and the order in which the processor adds the products.
DISTANCE_DECIMALS = 12


def dense_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the non-null rows of the given width."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False)
    return rows, flat.astype(np.float64, copy=False).reshape(len(rows), dim)


def cosine_distances(matrix: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """rows x queries; a zero vector on either side gives NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        norms = np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        return np.round(1.0 - (matrix @ queries.T) / norms, DISTANCE_DECIMALS)


def cosine_distance(c: Column, query: Sequence[float]) -> Column:
    """Distance to one query vector; null where the vector is null or of another width."""
    wanted = np.asarray(query, dtype=np.float64).reshape(1, -1)

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        rows, matrix = dense_rows(vectors, wanted.shape[1])
        out = np.full(len(vectors), np.nan)
        missing = np.ones(len(vectors), dtype=bool)
        out[rows] = cosine_distances(matrix, wanted)[:, 0]
        missing[rows] = False
        return pa.array(out, pa.float64(), mask=missing)

    return distance(c)


def similarity_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.coalesce(distance, F.lit(1.0))))


def is_nonzero(c: Column) -> Column:
    return F.exists(c, lambda x: x != 0)


def weighted_mean(vectors: Column, weights: Column) -> Column:
    """Weighted mean of a row's own vectors; [] on a length mismatch, zeros at zero weight."""
    wide = F.transform(vectors, lambda v: v.cast("array<double>"))
    ws = F.transform(weights, lambda w: w.cast("double"))
    zeros = F.transform(F.element_at(wide, 1), lambda _: F.lit(0.0))
    total = F.aggregate(ws, F.lit(0.0), lambda a, w: a + w)
    summed = F.aggregate(
        F.zip_with(wide, ws, lambda v, w: F.transform(v, lambda x: x * w)),
        zeros,
        lambda a, v: F.zip_with(a, v, lambda x, y: x + y),
    )
    mean = F.when(total == 0, zeros).otherwise(
        F.transform(summed, lambda x: F.try_divide(x, total))
    )
    usable = (
        vectors.isNotNull()
        & weights.isNotNull()
        & (F.size(vectors) > 0)
        & (F.size(vectors) == F.size(weights))
    )
    return F.when(usable, mean).otherwise(F.array().cast("array<double>"))


def vector_problem(c: Column, name: str, expected: Column, dim: int = fv.EMBEDDING_DIM) -> Column:
    """Null when the vector is acceptable, otherwise a message; rows never raise."""
    absent = c.isNull() | (F.size(c) == 0)
    return (
        F.when(absent & expected, F.lit(f"{name} is missing but content was expected"))
        .when(absent, F.lit(None).cast("string"))
        .when(
            F.size(c) != dim,
            F.concat(
                F.lit(f"{name} has wrong dim "),
                F.size(c).cast("string"),
                F.lit(f" (expected {dim})"),
            ),
        )
        .when(expected & ~is_nonzero(c), F.lit(f"{name} is all zeros; embedding likely failed"))
    )
