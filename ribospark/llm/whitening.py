"""Embedding whitening by a tiled covariance.

The fit list (each distinct integer vector once) is cut into row-blocks of some thousand
vectors and those into column blocks of ``TILE`` dimensions. A tile key is a pair of column
blocks; the column blocks meet by row-block in a join, each pair is multiplied where it
meets, and the products are summed for each tile. Only the tiles' sums (the square of the
number of dimensions, whatever the number of rows) reach the driver, which puts them together
and takes the eigenvectors. Every covariance is over the fit list with divisor n.

Values are centred exactly: with S = n*q + r the centred value is (x - q) - r/n, where x - q
is an integer, so no digits are lost to the offset of the values.

Defined results: rows with a null vector, with a null or non-finite entry, of another length
than most or with an entry of 2^46 and more are left out; repeated rows each give their rows,
the fit list holds them once; an empty table gives no rows; components without variance
(their eigenvalue is rounding error beside the largest) have ``whitened`` null and are left
out of ``identity_error``, which is 0 if there is no other; ``deviation`` beyond a long is
null. Texts don't occur here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ribospark.llm.common import Stored, map_batches
from ribospark.llm.vectors import exact_sums, integer_vectors, largest, matrix

#: Dimensions of a tile's side and vectors of a row-block.
TILE, ROW_BLOCK = 32, 2048
#: Sums of a tile that are made apart before the last sum.
PARTS = 32
#: What is added to every floor(64 * c).
OFFSET = 1_000_000


@dataclass
class Whitening:
    """The fit: n vectors, sums S by dimension, components as columns with their eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    @property
    def sound(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > 1e-11 * max(self.values[0], 1e-300)

    def centred(self, x: np.ndarray, low: int = 0) -> np.ndarray:
        """x - S/n of the dimensions from ``low`` on."""
        return centre(x, self.n, self.sums[low : low + x.shape[1]])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.sound, np.sqrt(np.where(self.sound, self.values, 1)), np.nan)
        return self.centred(x) @ self.vectors / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2, null beyond a long."""
        q, r = (np.array(v) for v in zip(*(divmod(s, self.n) for s in self.sums)))
        near = x - q.astype(np.int64)
        if x.shape[1] * (self.n * (largest(near) + 1)) ** 2 >= 2**63:
            near = near.astype(object)
        return [int(v) if v < 2**63 else None for v in ((self.n * near - r) ** 2).sum(axis=1)]


def centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    q, r = (np.array(v) for v in zip(*(divmod(s, n) for s in sums)))
    return (x - q.astype(np.int64)).astype(np.float64) - (r / n).astype(np.float64)


def _column_blocks(distinct: DataFrame, dims: int, tile: int, row_block: int) -> DataFrame:
    """(block, col, n, sums, data): the row-blocks of each task, cut into column blocks of long integers."""

    def cut_up(x: np.ndarray, block: int) -> dict:
        cols = range(0, dims, tile)
        parts = [x[:, c : c + tile] for c in cols]
        return {"block": [block] * len(parts), "col": list(range(len(parts))), "n": [len(x)] * len(parts), "sums": [list(map(str, exact_sums(p))) for p in parts], "data": [np.ascontiguousarray(p, np.int64).tobytes() for p in parts]}

    def blocks(batches: Iterator[dict]):
        first = TaskContext.get().partitionId() << 32
        held, size, made = [], 0, 0
        for b in batches:
            x = matrix(b["x"], dims)
            for at in range(0, len(x), row_block):
                held.append(x[at : at + row_block])
                size += len(held[-1])
                while size >= row_block:
                    whole = np.concatenate(held)
                    yield cut_up(whole[:row_block], first + made)
                    held, size, made = [whole[row_block:]], size - row_block, made + 1
        if size:
            yield cut_up(np.concatenate(held), first + made)

    return map_batches(distinct, blocks, "block long, col int, n long, sums array<string>, data binary")


def _sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sums by dimension: one row for each dimension reaches the driver."""
    each = blocks.select("col", "n", F.posexplode("sums").alias("at", "s")).groupBy("col", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = each.orderBy("col", "at").collect()
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in found]


def _summed(products: DataFrame) -> list:
    """Tiles' sums (i, j, cells) of the tasks' parts (i, j, part, cells): first the parts with one remainder, then all."""

    def added(table: pa.Table) -> pa.Table:
        cells = table.column("cells").combine_chunks()
        total = cells.flatten().to_numpy().reshape(len(cells), -1).sum(axis=0)
        head = table.slice(0, 1)
        return pa.table({"i": head.column("i"), "j": head.column("j"), "cells": pa.array([total], pa.list_(pa.float64()))})

    some = products.groupBy("i", "j", F.pmod("part", F.lit(PARTS)).alias("p")).applyInArrow(added, "i int, j int, cells array<double>")
    return some.groupBy("i", "j").applyInArrow(added, "i int, j int, cells array<double>").collect()


def _covariance(blocks: DataFrame, n: int, sums: list[int], tile: int) -> np.ndarray:
    """The covariance from all tiles."""
    dims = len(sums)
    left = blocks.select("block", F.col("col").alias("i"), F.col("data").alias("a"))
    right = blocks.select(F.col("block").alias("_block"), F.col("col").alias("j"), F.col("data").alias("b"))
    met = left.join(right, (F.col("block") == F.col("_block")) & (F.col("i") <= F.col("j")))

    def multiplied(batches: Iterator[dict]):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, x, y in zip(b["i"].to_pylist(), b["j"].to_pylist(), b["a"], b["b"]):
                own, other = sums[i * tile : (i + 1) * tile], sums[j * tile : (j + 1) * tile]
                u = centre(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, len(own)), n, own)
                v = centre(np.frombuffer(y.as_buffer(), np.int64).reshape(-1, len(other)), n, other)
                total[i, j] = total.get((i, j), 0) + u.T @ v
        if total:
            yield {"i": [k[0] for k in total], "j": [k[1] for k in total], "part": [TaskContext.get().partitionId()] * len(total), "cells": [m.ravel() for m in total.values()]}

    out = np.zeros((dims, dims))
    for r in _summed(map_batches(met.select("i", "j", "a", "b"), multiplied, "i int, j int, part int, cells array<double>")):
        own, other = slice(r["i"] * tile, (r["i"] + 1) * tile), slice(r["j"] * tile, (r["j"] + 1) * tile)
        cells = np.array(r["cells"]).reshape(out[own, other].shape) / n
        out[own, other], out[other, own] = cells, cells.T
    return out


def _identity_error(blocks: DataFrame, model: Whitening, tile: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured over all of it."""
    sound, dims = np.flatnonzero(model.sound), len(model.sums)
    if not len(sound):
        return 0.0
    whole = blocks.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("col", "data"))).alias("x"))  # a row-block has a bounded size

    def multiplied(batches: Iterator[dict]):
        total = np.zeros((len(sound), len(sound)))
        for b in batches:
            for parts in b["parts"].to_pylist():
                columns = [np.frombuffer(p, np.int64).reshape(-1, min(tile, dims - k * tile)) for k, p in enumerate(parts)]
                w = model.whiten(np.concatenate(columns, axis=1))[:, sound]
                total += w.T @ w
        yield {"i": [0], "j": [0], "part": [TaskContext.get().partitionId()], "cells": [total.ravel()]}

    (found,) = _summed(map_batches(whole.select(F.col("x.data").alias("parts")), multiplied, "i int, j int, part int, cells array<double>"))
    return float(np.abs(np.array(found["cells"]).reshape(len(sound), -1) / model.n - np.eye(len(sound))).max())


def fit_whitening(rows: DataFrame, dims: int, components: int = 16, tile: int = TILE, row_block: int = ROW_BLOCK) -> Whitening | None:
    """The whitening of integer vectors ``x`` of ``dims`` dimensions over their distinct values; None of no rows."""
    blocks = Stored(_column_blocks(rows.select("x").distinct(), dims, tile, row_block))
    try:
        n, sums = _sums(blocks.table)
        if n == 0:
            return None
        covariance = _covariance(blocks.table, n, sums, tile)
        values, vectors = np.linalg.eigh(covariance)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)] < 0, -1, 1)
        model = Whitening(n, sums, np.ascontiguousarray(vectors[:, :components]), values[:components], float(np.trace(covariance)))
        model.error = _identity_error(blocks.table, model, tile)
        return model
    finally:
        blocks.drop()


def whiten_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, components: int = 16, tile: int = TILE, row_block: int = ROW_BLOCK) -> DataFrame:
    """A row for each sound vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Only the sums and the components (dimensions x ``components`` numbers) travel to the rows.
    """
    kept, dims = integer_vectors(df, [F.col(id_col).cast("long").alias("id")], F.col(vector_col), scale)
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = kept.withColumn("x", F.transform("x", lambda v: v + OFFSET))
    model = fit_whitening(kept, dims, components, tile, row_block) if dims else None
    if model is None:
        return kept.sparkSession.createDataFrame([], schema)
    count = len(model.values)
    explained = np.where(model.sound, model.values / (model.trace or 1), 0.0)

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x = matrix(part.column("x"), dims)
                again = pa.array(np.repeat(np.arange(len(x)), count))
                white = model.whiten(x).ravel()
                out = [part.column("id").take(again), np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)), np.full(len(again), model.n), pa.array(model.deviations(x), pa.int64()).take(again), pa.array(white, pa.float64(), mask=np.isnan(white)), np.tile(explained, len(x)), np.full(len(again), model.error)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in out], names=[c.split()[0] for c in schema.split(", ")])

    return kept.mapInArrow(rows, schema)
