"""Singular vectors from few passes over the rows, against numpy's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from marlquarry.operators import retrieval as R
from marlquarry.operators import svd


def _same(own: np.ndarray, x: np.ndarray, k: int) -> None:
    want = np.linalg.svd(x, full_matrices=False)[2][:k]
    assert own.shape == want.shape and np.allclose(np.abs((own * want).sum(1)), 1, atol=1e-8)


def test_few_passes_find_the_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((400, 90)) < 0.2, rng.random((400, 90)), 0) @ np.diag(0.95 ** np.arange(90.0))
    x[7] = 0
    rows = [(i, [(int(c), float(r[c])) for c in np.flatnonzero(r)]) for i, r in enumerate(x)]
    matrix = svd.packed(spark.createDataFrame(rows, "doc_id long, x array<struct<column:int,weight:double>>").repartition(3)).cache()
    passes = []
    monkeypatch.setattr(svd, "_gram", lambda m, b, own=svd._gram: (passes.append(len(b)), own(m, b))[1])
    for name, small in (("ENTRIES", 50), ("ROWS", 9), ("FULL", 16)):
        monkeypatch.setattr(svd, name, small)
    monkeypatch.setattr(svd, "BLOCK", 8)
    _same(svd.right_vectors(matrix, 90, 10), x, 10)
    # A pass for each vector, at the least, took hundreds.
    assert len(passes) <= 14
    # The driver keeps the best vectors alone where it holds too many.
    monkeypatch.setattr(svd, "HELD", 30)
    _same(svd.right_vectors(matrix, 90, 10), x, 10)
    found = {r.doc_id: r.embedding for r in svd.unit_rows(matrix, np.eye(90)[:3], 5).collect()}
    assert sorted(found) == list(range(400)) and not any(found[7])
    assert all(np.allclose(found[i], np.append(x[i, :3], [0, 0]) / (np.linalg.norm(x[i, :3]) or 1)) for i in range(400))
    # What the matrix lacks isn't made up: its rank is two.
    two = svd.packed(spark.createDataFrame([(1, [(0, 1.0)]), (2, [(0, 2.0)]), (3, [(1, 1.0), (2, 1.0)])], "doc_id long, x array<struct<column:int,weight:double>>"))
    _same(svd.right_vectors(two, 3, 3), np.array([[1, 0, 0], [2, 0, 0], [0, 1, 1.0]]), 2)
    assert svd.right_vectors(two.limit(0), 3, 2).shape == (0, 3)


def test_texts_and_weights_give_the_same_vectors(spark):
    texts = ["red green", "red green blue", "cold wind", "cold wind rain", None, "", "red", "rain rain green"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    cosines = lambda df: (lambda v: v @ v.T)(np.array([r.embedding for r in df.orderBy("doc_id").collect()]))
    whole = cosines(R.svd_texts(docs, 4))
    assert np.allclose(whole, cosines(R.svd_vectors(R.tfidf(docs), 4, docs)), atol=1e-8) and not whole[4:6].any()
    # An id with several texts is one document, as for the weights.
    twice = docs.withColumn("doc_id", docs.doc_id % 6)
    assert np.allclose(cosines(R.svd_texts(twice, 4)), cosines(R.svd_vectors(R.tfidf(twice), 4, twice)), atol=1e-8)
    assert R.svd_texts(docs.filter("doc_id = 5"), 4).first().embedding == [0.0] and R.svd_texts(docs.limit(0), 4).count() == 0


def test_bytes_of_slices_are_their_rows():
    cut = np.array([0, 2, 2, 5])
    batch = pa.RecordBatch.from_arrays([svd.as_bytes(np.arange(5, dtype=np.int32), cut), svd.as_bytes(np.arange(5.0) / 2, cut)], names=["column", "weight"])
    ((n, row, column, weight),) = svd._opened(batch.slice(1, 2))
    assert (n, row.tolist(), column.tolist(), weight.tolist()) == (2, [1, 1, 1], [2, 3, 4], [1.0, 1.5, 2.0])


def test_a_slab_multiplies_all_vectors_of_an_entry_together():
    """Columns of many entries and of one, rows without any, numbers over two bytes: the products are those of the full matrix."""
    rng = np.random.default_rng(5)
    for size, full in ((40, 8), (70_000, 8), (40, 40), (40, 0)):
        x = np.where(rng.random((90, 40)) < np.linspace(0.9, 0.01, 40), rng.random((90, 40)), 0)
        x[7] = x[:, 20] = 0
        place = np.concatenate((np.arange(20), np.arange(size - 20, size)))
        row, column = np.nonzero(x)
        slab = svd._Slab(90, row, place[column].astype(np.int32), x[row, column])
        block, y, own = rng.random((size, 5)), rng.random((90, 5)), np.ones((size, 5))
        assert np.allclose(slab.times(block), x @ block[place])
        slab.add(y, own, full)
        want = np.ones((size, 5))
        want[place] += x.T @ y
        assert np.allclose(own, want)
    nothing = svd._Slab(2, *(np.zeros(0, t) for t in (np.int64, np.int32, float)))
    assert not nothing.times(block).any() and nothing.add(np.ones((2, 5)), own, 3) is None
