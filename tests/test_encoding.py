"""The vector table and its models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlquarry.operators import encoding as V

DOCS = "doc_id long, text string"


class Counting:
    """Leaves a file for each model made and a line for each text, so that calls on workers can be counted."""

    def __init__(self, folder):
        import os
        import tempfile

        self.file = tempfile.NamedTemporaryFile("w", dir=os.fspath(folder), delete=False)

    def encode(self, texts):
        self.file.writelines(t.replace("\n", " ") + "\n" for t in texts)
        self.file.flush()
        return np.array([[len(t), 1.0] for t in texts])


def test_only_what_is_new_is_encoded(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    seen = lambda: sorted(line for p in calls.iterdir() for line in p.read_text().splitlines())
    cfg, folder = V.EncoderConfig(model="m", dim=2, batch=2), str(tmp_path / "table")
    load = lambda: Counting(str(calls))
    run = lambda rows, batch, c=cfg: {(r.doc_id, r.fresh, tuple(r.embedding)) for r in V.refresh_vectors(spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as batch", "1 as content_key"), folder, batch, c, load).collect()}
    first = [(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")]
    assert run(first, "one") == {(1, True, (10, 1)), (2, True, (11, 1)), (3, True, (10, 1)), (4, True, (9, 1)), (5, True, (9, 1))}
    assert seen() == ["passage: ", "passage: a", "passage: bb"]
    second = [(1, "a"), (2, "bbb"), (6, "bb"), (6, "bb"), (7, "c" * 50_000)]
    want = {(1, False, (10, 1)), (2, True, (12, 1)), (6, False, (11, 1)), (7, True, (50_009, 1))}
    assert run(second, "two") == want
    assert len(seen()) == 5
    # The batch again: the same partition, the same rows; an unknown model's vectors are others.
    assert run(second, "two") == want
    assert spark.read.parquet(folder).count() == 5
    assert {f for _, f, _ in run(second, "three", V.EncoderConfig(model="other", dim=2))} == {True}
    assert run([], "four") == set()
    kept = V.compact(spark.createDataFrame(second, DOCS), folder, str(tmp_path / "small"), cfg)
    assert {r.batch for r in kept.collect()} == {"compacted"} and kept.count() == 4
    again = V.refresh_vectors(spark.createDataFrame(second, DOCS), str(tmp_path / "small"), "five", cfg, load)
    assert {r.fresh for r in again.collect()} == {False}


def test_prefixes_tell_queries_from_documents(spark):
    cfg = V.EncoderConfig(dim=1024)
    rows = spark.createDataFrame([(1, "palace gate"), (2, None)], DOCS)
    made = rows.select("doc_id", V.vectors(F.col("text"), cfg, "query").alias("q"), V.vectors(F.col("text"), cfg).alias("d")).orderBy("doc_id").collect()
    model = V.HashingModel(1024)
    assert np.allclose(made[0].q, model.encode(["query: palace gate"])[0]) and np.allclose(made[0].d, model.encode(["passage: palace gate"])[0])
    assert made[0].q != made[0].d and abs(np.linalg.norm(made[1].d) - 1) < 1e-6
    with pytest.raises(KeyError):
        cfg.prefix("other")
