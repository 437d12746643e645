"""Vector expressions, and the NumPy view of an Arrow list column used inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.binding import bind

# Distances are compared at this many decimals, so that equal vectors tie
# whatever block of a matrix product they fall into.
DISTANCE_DECIMALS = 12


def sum_of_squares(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))


def mrl_reduce(vector: Column, dim: int) -> Column:
    """Keep the first ``dim`` values and divide them by their L2 norm.

    A vector that is short enough is returned untouched, and a zero norm leaves
    the cut values as they are.
    """

    def scale(head: Column) -> Column:
        return bind(
            F.sqrt(sum_of_squares(head)).cast("float"),
            lambda norm: F.when(norm == 0, head).otherwise(F.transform(head, lambda v: (v / norm).cast("float"))),
        )

    return F.when(F.size(vector) <= dim, vector).otherwise(bind(F.slice(vector, 1, dim), scale))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NaN if a norm is zero, an error if the lengths differ."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, v: total + v
    )
    norms = F.sqrt(sum_of_squares(a)) * F.sqrt(sum_of_squares(b))
    distance = bind(norms, lambda n: F.when(n == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot / n))
    wrong = F.raise_error(F.concat(F.lit("different vector dimensions "), F.size(a), F.lit(" and "), F.size(b)))
    return F.when(F.size(a) != F.size(b), wrong.cast("double")).otherwise(F.round(distance, DISTANCE_DECIMALS))


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column without nulls as a float64 matrix."""
    values = np.asarray(column.flatten())
    if len(values) != len(column) * dim or not (np.diff(np.asarray(column.offsets)) == dim).all():
        raise ValueError(f"a stored vector has not the {dim} dimensions of the query")
    return values.astype(np.float64).reshape(len(column), dim)


def distances(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine distances, one row per stored vector and one column per query."""
    norms = np.sqrt((rows * rows).sum(axis=1))[:, None] * np.sqrt((queries * queries).sum(axis=1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1.0 - (rows @ queries.T) / norms
    out[norms == 0] = np.nan
    return np.round(out, DISTANCE_DECIMALS) + 0.0  # no negative zero
