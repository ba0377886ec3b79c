"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

The codebooks are refined by rounds of integer arithmetic (nearest entry, then floor of the
mean), so the result doesn't depend on the order of rows, on partitions or on lost tasks.
Nearest entries are found by a vantage-point tree over the entries of a part position:

* a node keeps, for the entries nearer to its vantage point and for the others, the least and
  the largest distance from it, rounded down and up to whole numbers;
* a subtree is left out only if the rounded bound on its distance, squared, is *larger* than
  the best squared distance so far (equality is visited, as a tie may go to a lower index);
* what is compared in the end are exact squared distances in integers.

All parts of an Arrow batch walk the tree together, as index arrays over its nodes.

Defined results: rows with a null vector, with a null or non-finite component, of another
length than most or with a component of 2^42 and more are left out; a null ``vec_id`` counts
as the largest; rows of one id start the codebook in the order of their vectors; repeated rows
count as often as they come; an empty table gives no rows; fewer than 256 kept rows give
smaller codebooks; ``error`` (or a label's sum) beyond a long is null. Texts don't occur here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribospark.llm.common import Stored, map_batches
from ribospark.llm.vectors import exact_sums, integer_roots, integer_vectors, largest, matrix
from ribospark.plans.runtime import cut

#: Entries of a part position, indexes of one byte.
ENTRIES = 256
#: Entries that are compared without a further vantage point.
LEAF = 12


@dataclass
class Node:
    """Entries as indexes: a leaf, or a vantage point with two subtrees and the rounded distances to them."""

    members: np.ndarray
    vantage: int = -1
    children: tuple = ()  # of (least distance rounded down, largest rounded up, Node)


class VantageTree:
    """Exact nearest entries, ties to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._grow(np.arange(len(entries)))

    def _squares(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact squared distances from points to the entries ``at``.

        Doubles hold all integers below 2^53, so for components of usual size the product
        of matrices is integer arithmetic; else Python's integers are used.
        """
        some = self.entries[at]
        if 4 * points.shape[1] * max(largest(points), largest(some), 1) ** 2 < 2**53:
            p, e = points.astype(np.float64), some.astype(np.float64)
            return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]).astype(np.int64)
        p, e = points.astype(object), some.astype(object)
        return np.stack([((p - one) ** 2).sum(axis=1) for one in e], axis=1) if len(e) else np.empty((len(p), 0), object)

    def _grow(self, members: np.ndarray) -> Node:
        if len(members) <= LEAF:
            return Node(members)
        vantage, rest = int(members[0]), members[1:]
        squares = self._squares(self.entries[[vantage]], rest)[0]
        middle = np.sort(squares)[len(rest) // 2]
        near = squares < middle
        if not near.any():  # half of the entries or more are as near as the nearest
            near = squares <= middle
        if near.all():
            return Node(members)
        low = integer_roots(squares)
        high = low + (low * low < squares)
        sides = [(low[s].min(), high[s].max(), self._grow(rest[s])) for s in (near, ~near)]
        return Node(members, vantage, tuple(sides))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row of ``points``."""
        best = self._squares(points, np.array([0]))[:, 0]
        index = np.zeros(len(points), np.int64)

        def meet(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            squares = self._squares(points[rows], at)
            k = squares.argmin(axis=1)  # the first of equals, and ``at`` ascends
            found, entry = squares[np.arange(len(rows)), k], at[k]
            better = (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = found[better], entry[better]
            return squares

        def descend(node: Node, rows: np.ndarray) -> None:
            """One way down for every point, so that a good distance is known before the search."""
            while node.children and len(rows):
                root = integer_roots(meet(rows, np.array([node.vantage]))[:, 0])
                inner = root <= node.children[0][1]
                descend(node.children[1][2], rows[~inner])
                node, rows = node.children[0][2], rows[inner]
            if len(rows):
                meet(rows, node.members)

        def search(node: Node, rows: np.ndarray) -> None:
            if not node.children:
                meet(rows, node.members)
                return
            squares = meet(rows, np.array([node.vantage]))[:, 0]
            down = integer_roots(squares)
            up = down + (down * down < squares)
            for low, high, child in node.children:
                gap = np.maximum(np.maximum(low - up, down - high), 0)  # no entry of the child is nearer
                left = rows[gap * gap <= best[rows]]
                if len(left):
                    search(child, left)

        if len(points):
            descend(self.root, np.arange(len(points)))
            search(self.root, np.arange(len(points)))
        return index, best


class Quantiser:
    """The codebooks of all part positions."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.trees = [VantageTree(b) for b in books]
        self.width = books[0].shape[1]

    def parts(self, x: np.ndarray) -> Iterator[np.ndarray]:
        return (x[:, p * self.width : (p + 1) * self.width] for p in range(len(self.books)))

    def encode(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(index, squared distance) of every row, by part position."""
        return [tree.nearest(part) for tree, part in zip(self.trees, self.parts(x))]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel()).encode()).hexdigest()


def _start(rows: DataFrame, parts: int, width: int, entries: int) -> Quantiser:
    first = rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()  # a stated number of rows
    x = np.array([r["x"] for r in first], np.int64)
    return Quantiser([x[:, p * width : (p + 1) * width] for p in range(parts)])


def _refined(rows: DataFrame, model: Quantiser) -> Quantiser:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean.

    A task adds up what it reads and hands on one row for each used entry.
    """
    width, dims = model.width, model.width * len(model.books)

    def sums(batches: Iterator[dict]):
        total: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for b in batches:
            x = matrix(b["x"], dims)
            for p, (part, (index, _)) in enumerate(zip(model.parts(x), model.encode(x))):
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                for entry, own in zip(used.tolist(), np.split(order, starts[1:])):
                    n, old = total.get((p, entry), (0, [0] * width))
                    total[p, entry] = (n + len(own), [a + s for a, s in zip(old, exact_sums(part[own]))])
        if total:
            keys = list(total)
            yield {"part": [k[0] for k in keys], "entry": [k[1] for k in keys], "n": [total[k][0] for k in keys], "sums": [[str(s) for s in total[k][1]] for k in keys]}

    found = map_batches(rows.select("x"), sums, "part int, entry int, n long, sums array<string>")
    whole = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    books = [b.copy() for b in model.books]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *whole).collect():  # a row for each entry at most
        books[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return Quantiser(books)


def fit_codebooks(rows: DataFrame, dims: int, parts: int = 4, entries: int = ENTRIES, rounds: int = 4) -> Quantiser:
    """Codebooks of the integer vectors (id, x): the first ``entries`` ids' parts, refined ``rounds`` times over all rows."""
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    model = _start(rows, parts, dims // parts, entries)
    for _ in range(rounds):
        model = _refined(rows, model)
    return model


def encode_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024, parts: int = 4, entries: int = ENTRIES, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a sound vector.

    ``code`` has two hexadecimal digits for each part, ``error`` the squared distances summed
    over the parts, ``label_error`` the sum of errors of all rows with the same label (nulls
    together). The integer vectors are written once to the shared folder and read by every
    round; only the codebooks travel.
    """
    columns = [F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")]
    kept, dims = integer_vectors(df, columns, F.col(vector_col), scale)
    if dims == 0:
        none = F.lit(None)
        return kept.limit(0).select(F.col("id").alias(id_col), none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), none.cast("string").alias("codebooks_sha256"))
    vectors = Stored(kept)
    model = fit_codebooks(vectors.table, dims, parts, entries, rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.encode(matrix(b.column("x"), dims))
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = [e if e < 2**63 else None for e in sum(e.astype(object) for _, e in found)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    kind = dict(kept.dtypes)["label"]
    codes = Stored(vectors.table.mapInArrow(coded, f"id long, label {kind}, code string, error long"))
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    sums = Stored(codes.table.groupBy(F.col("label").alias("_label")).agg(whole.alias("label_error")))  # written apart, so that a hot label's rows can be split in the join
    joined = codes.table.join(sums.table, F.col("label").eqNullSafe(F.col("_label")))
    out = cut(joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256")))
    for table in (vectors, codes, sums):
        table.drop()
    return out
