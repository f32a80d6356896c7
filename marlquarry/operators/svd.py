"""The right singular vectors of a tall sparse matrix, by block Lanczos: a pass over all rows gives a block of vectors, not one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Vectors that a pass over the rows multiplies, vectors that the driver holds before it keeps the best alone, and passes at most.
BLOCK, HELD, PASSES = 64, 640, 300
#: Rows and entries, about, that a worker takes at once, and the first columns, the most frequent ones, that it opens in full.
ROWS, ENTRIES, FULL = 4096, 1 << 20, 1024
#: A vector has converged when what is left of it is this small beside the least singular value wanted, both squared.
TOLERANCE = 1e-8

ROW = "column binary, weight binary"


def as_bytes(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """For each row, that ends where the next begins, the bytes of its numbers."""
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def packed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, x: array of column, weight) as doc_id and ROW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            cut = np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy())))
            column, weight = (np.asarray(v) for v in x.flatten().flatten())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_bytes(column.astype(np.int32), cut), as_bytes(weight.astype(float), cut)], names=["doc_id", "column", "weight"])

    return rows.select("doc_id", "x").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ROW}")


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of rows, and row, column and weight of each entry, of some rows at a time."""
    numbers = lambda c, kind: np.frombuffer(c.buffers()[2] or b"", kind)
    column = batch.column("column")
    cut = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    columns, weights = numbers(column, np.int32), numbers(batch.column("weight"), np.float64)
    start = 0
    while start < len(column):
        stop = max(start + 1, min(start + ROWS, int(np.searchsorted(cut, cut[start] + ENTRIES, side="right")) - 1))
        own = slice(cut[start], cut[stop])
        yield stop - start, np.repeat(np.arange(stop - start), np.diff(cut[start : stop + 1])), columns[own], weights[own]
        start = stop


#: Entries of a column that are summed by one product, and such products that are made at once: they stay in a core's cache.
WIDTH, GROUPS = 8, 256


class _Slab:
    """Some rows. Vectors are columns throughout, so that an entry meets all of them in one stretch of memory."""

    def __init__(self, n: int, row: np.ndarray, column: np.ndarray, weight: np.ndarray):
        self.n, self.row, self.column, self.weight = n, row, column, weight

    def times(self, block: np.ndarray) -> np.ndarray:
        """The slab's rows by block's vectors."""
        out = np.empty((self.n, block.shape[1]))
        ends = np.searchsorted(self.row, np.arange(self.n + 1)).tolist()
        for y, start, stop in zip(out, ends, ends[1:], strict=False):
            np.dot(self.weight[start:stop], block.take(self.column[start:stop], axis=0), out=y)
        return out

    def add(self, y: np.ndarray, own: np.ndarray, full: int) -> None:
        """Adds to own, a row for each column, the slab's rows by their numbers in y. The first `full` columns, the most frequent ones, are opened."""
        often = self.column < full
        opened = np.zeros((self.n, full))
        opened[self.row[often], self.column[often]] = self.weight[often]
        own[:full] += opened.T @ y
        column, row, weight = self.column[~often], self.row[~often], self.weight[~often]
        # Numbers of two bytes are sorted by digits.
        order = np.argsort(column.astype(np.uint16) if len(own) <= 1 << 16 else column, kind="stable")
        column = column[order]
        first = np.flatnonzero(np.diff(column, prepend=-1))
        size = np.diff(np.append(first, len(column)))
        groups = -(-size // WIDTH)
        # Each column's entries fill whole groups; what is left of the last one weighs nothing.
        at = np.arange(len(column)) + np.repeat((np.cumsum(groups) - groups) * WIDTH - first, size)
        rows, weights = np.zeros(groups.sum() * WIDTH, np.int64), np.zeros(groups.sum() * WIDTH)
        rows[at], weights[at] = row[order], weight[order]
        rows, weights, column = rows.reshape(-1, WIDTH), weights.reshape(-1, 1, WIDTH), np.repeat(column[first], groups)
        for start in range(0, len(column), GROUPS):
            part = slice(start, start + GROUPS)
            sums = np.matmul(weights[part], y.take(rows[part], axis=0))[:, 0]
            first = np.flatnonzero(np.diff(column[part], prepend=-1))
            own[column[part][first]] += np.add.reduceat(sums, first, axis=0)


def _gram(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """For each vector of block its product with the matrix and then with the transposed matrix: one pass over all rows."""
    spark = matrix.sparkSession
    told = spark.sparkContext.broadcast(np.ascontiguousarray(block.T))
    shape, full = block.shape, min(FULL, block.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(shape[::-1])
        for batch in batches:
            for opened in _opened(batch):
                slab = _Slab(*opened)
                slab.add(slab.times(told.value), own, full)
        for k, x in enumerate(own.T):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()])], names=["vector", "x"])

    def total(part: pa.Table) -> pa.Table:
        x = np.zeros(shape[1])
        for own in part["x"]:
            x += np.frombuffer(own.as_buffer(), np.float64)
        return pa.table({"vector": part["vector"].slice(0, 1), "x": pa.array([x.tobytes()])})

    kind = "vector int, x binary"
    out = np.zeros(shape)
    for k, x in matrix.select("column", "weight").mapInArrow(run, kind).groupBy("vector").applyInArrow(total, kind).collect():
        out[k] = np.frombuffer(x, np.float64)
    told.destroy()
    return out


#: Spark then deletes a pass's shuffled sums when the pass has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def right_vectors(matrix: DataFrame, size: int, k: int, seed: int = 20240607) -> np.ndarray:
    """The k right singular vectors (rows) of the greatest singular values of matrix (ROW, of size columns), or as many as it has.

    Block Lanczos on the Gram matrix with full orthogonalisation; where the driver holds HELD vectors it keeps the best of them and goes on. What the driver
    holds follows the number of columns, not of rows. A pass shuffles a block of sums for each core.
    """
    spark = matrix.sparkSession
    matrix = matrix.coalesce(spark.sparkContext.defaultParallelism)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        block = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(BLOCK, size))))[0].T
        basis, h = np.zeros((0, size)), np.zeros((0, 0))
        for _ in range(PASSES):
            made = _gram(matrix, np.ascontiguousarray(block))
            b = len(block)
            basis = np.concatenate((basis, block))
            m = len(basis)
            along = basis @ made.T
            h = np.block([[h, along[: m - b]], [along[: m - b].T, (along[m - b :] + along[m - b :].T) / 2]])
            made -= along.T @ basis
            made -= (made @ basis.T) @ basis
            values, s = np.linalg.eigh(h)
            values, s = values[::-1], s[:, ::-1]
            # What the product has outside the basis: its directions, and how much of each.
            q, r = np.linalg.qr(made.T)
            u, length, v = np.linalg.svd(r)
            own = length > 1e-13 * max(values[0], 1e-300)
            left = length[own, None] * v[own]
            rest = np.linalg.norm(left @ s[m - b :, :k], axis=0).max(initial=0.0)
            if not own.any() or (m >= k and rest <= TOLERANCE * values[min(k, m) - 1]):
                break
            block = (q @ u[:, own]).T
            block -= (block @ basis.T) @ basis
            block = np.linalg.qr(block.T)[0].T
            if m + len(block) > max(HELD, 2 * k + BLOCK):
                kept = min(m, k + BLOCK)
                basis, h = s[:, :kept].T @ basis, np.diag(values[:kept])
        else:
            raise RuntimeError(f"no singular vectors after {PASSES} passes")
        found = s[:, :k].T @ basis
        found = found[values[:k] > 1e-14 * max(values[0], 1e-300)]
        at = np.abs(found).argmax(1) if len(found) else np.zeros(0, int)
        return found * np.sign(found[np.arange(len(found)), at])[:, None]
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def unit_rows(matrix: DataFrame, vectors: np.ndarray, width: int) -> DataFrame:
    """doc_id and the row's product with the vectors, of unit length, or zeros, of matrix (doc_id, ROW)."""
    told = matrix.sparkSession.sparkContext.broadcast(np.ascontiguousarray(vectors.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for opened in _opened(batch):
                n = opened[0]
                out = np.zeros((n, width))
                if told.value.size:
                    out[:, : told.value.shape[1]] = _Slab(*opened).times(told.value)
                length = np.linalg.norm(out, axis=1, keepdims=True)
                out /= np.where(length > 0, length, 1.0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, n), lists], names=["doc_id", "embedding"])
                start += n

    return matrix.mapInArrow(run, f"doc_id {matrix.schema['doc_id'].dataType.simpleString()}, embedding array<double>")
