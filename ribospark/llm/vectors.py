"""Embedding rows as integer vectors: what the operators on vectors share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components of this size and more count as non-finite: beyond it a double has no unit digit.
LARGEST = 2.0**52


def scaled_floor(vector: Column, scale: int) -> Column:
    """The vector's components c as ``floor(scale * c)``, or null where one of them is null, non-finite or ``LARGEST``."""
    scaled = F.transform(vector.cast("array<double>"), lambda c: c * F.lit(float(scale)))
    sound = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))  # a NaN is larger than all numbers
    return F.when(sound, F.transform(scaled, lambda c: F.floor(c)))


def integer_vectors(df: DataFrame, columns: list[Column], vector: Column, scale: int) -> tuple[DataFrame, int]:
    """(``columns`` with ``x`` of array<long>, their length): the rows with a sound vector of the most frequent length.

    Of two lengths that occur equally often the larger counts; empty vectors go. Only the
    asked columns stay, so no other column's name can clash.
    """
    rows = df.select(*columns, scaled_floor(vector, scale).alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.filter(F.size("x") == d), d


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as rows of an integer matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def largest(x: np.ndarray) -> int:
    """The largest absolute value, 0 of nothing."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python integers, whatever their size."""
    high, low = x >> 26, x & ((1 << 26) - 1)
    return [(int(h) << 26) + int(s) for h, s in zip(high.sum(axis=0), low.sum(axis=0))]


def integer_roots(squares: np.ndarray) -> np.ndarray:
    """Floors of the square roots of integers below 2^53 (int64) or of any Python integers (object)."""
    if squares.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(squares) if squares.size else squares
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)
