"""The jobs, over growing and repeated input."""

from __future__ import annotations

import json
import logging
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import chunk_refresh as C
from jobs import retrieval_report as R

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, k: int) -> str:
    return "\n".join(f"Line {i} of text {n} tells of a thing that happened there long ago, and of what came after it." for i in range(k))


def add(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(map(str, (r[c] for c in columns))) for r in df.collect()))


def fresh(spark, tmp_path, name, rows):
    """The chunks that one run over all of rows gives."""
    add(spark, tmp_path / name / "in", rows)
    return rows_of(C.refresh(spark, str(tmp_path / name / "in"), str(tmp_path / name / "out"), str(tmp_path / name / "mark")))


def test_chunks_of_growing_input(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, logger="chunk_refresh")
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    first = [(1, prose(1, 30), "en", "a", 1), (2, prose(2, 8), None, "b", 1), (3, None, "de", "a", 0), (4, "", "de", None, 0), (None, prose(9, 9), "en", "a", 0), (5, "see C:\\data\\x and what lies in it, all of it\nshort", "en", "a", 9)]
    add(spark, folder, first)
    run = lambda: C.refresh(spark, str(folder), out, mark)
    one = run()
    assert one.columns == ["doc_id", "chunk_id", "parent_id", "source", "n_blocks", "text_length", "quality_flags", "public_allowed", "text", "text_hash", "lang"]
    assert {r.doc_id for r in one.collect()} == {1, 2, 5}
    assert [r.public_allowed for r in one.collect() if r.doc_id == 5] == [False]
    assert rows_of(one) == fresh(spark, tmp_path, "first", first)
    # Nothing new: nothing is read, and the output stays as it is.
    caplog.clear()
    before = sorted(p.name for p in Path(out).rglob("*.parquet"))
    assert rows_of(run()) == rows_of(one) and "took 0 micro-batches" in caplog.text
    assert sorted(p.name for p in Path(out).rglob("*.parquet")) == before
    # A new document, one that comes again as it was, one that is edited, one that loses its text, one twice in a file.
    second = [(6, prose(6, 12), "fr", "c", 1), (6, prose(6, 12), "fr", "c", 1), (1, prose(1, 30), "en", "a", 1), (2, prose(22, 9), "en", "b", 1), (5, None, "en", "a", 0)]
    add(spark, folder, second)
    caplog.clear()
    two = run()
    assert "batch 1: read 5 rows, wrote 3 new or changed documents" in caplog.text
    latest = [first[0], first[2], second[0], second[3], second[4]]
    assert rows_of(two) == fresh(spark, tmp_path, "second", latest)
    assert rows_of(run()) == rows_of(two)


def test_a_batch_that_was_cut_off_is_written_anew(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    add(spark, folder, [(i, prose(i, 10), "en", "a", 1) for i in range(5)])
    whole = rows_of(C.refresh(spark, str(folder), out, mark))
    batch = spark.read.parquet(str(folder))
    # The same files come again under the same number, as after a failure between the two tables.
    C.take(batch, 0, out, C.RefreshConfig())
    assert rows_of(C.current(spark, out)) == whole
    # Under another number all of it is known.
    C.take(batch, 7, out, C.RefreshConfig())
    assert rows_of(C.current(spark, out)) == whole
    assert spark.read.parquet(f"{out}/versions").select("batch").distinct().count() == 1


def test_micro_batches_give_what_one_batch_gives(spark, tmp_path):
    rows = [(i, prose(i, 5 + i), "en", "a", 1) for i in range(6)]
    for r in rows:
        add(spark, tmp_path / "in", [r])
    split = C.refresh(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), C.RefreshConfig(max_files=2))
    assert rows_of(split) == fresh(spark, tmp_path, "whole", rows)
    assert spark.read.parquet(str(tmp_path / "out" / "versions")).select("batch").distinct().count() == 3


def test_empty_input(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "in"))
    assert C.refresh(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")).collect() == []


def report_input(spark, tmp_path):
    docs = [(i, f"{prose(i, 3)}\nthe {w} river bends twice before it meets the {w} bridge in town", "en", "a", 1) for i, w in enumerate(["amber", "birch", "cedar", "dune"])]
    docs += [(None, "the amber river", "en", "a", 1), (9, None, None, None, None), (10, docs[0][1], "en", "b", 1)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "docs"))
    asked = [(100, "river bends twice before it meets the cedar bridge"), (101, "nothing of this kind is written anywhere"), (102, "the amber river bends twice before"), (103, None), (None, "x")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    spark.createDataFrame([(2, 1, 0), (2, 0, 0), (0, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels"))
    return [str(tmp_path / n) for n in ("docs", "asked", "labels")]


def test_report_reruns_to_the_same(spark, tmp_path):
    paths, out = report_input(spark, tmp_path), str(tmp_path / "out")
    one = rows_of(R.report(spark, *paths, out))
    assert rows_of(R.report(spark, *paths, out)) == one
    rows = {(r.method, r.query_id): r for r in R.report(spark, *paths, out).collect()}
    assert {k[1] for k in rows} == {100, 101, 102, 103} and {k[0] for k in rows} == {"bm25", "rerank", "rrf"}
    assert rows["bm25", 100].hit_1 == 1 and rows["bm25", 100].ndcg == 1
    assert rows["bm25", 101].expected == "abstain" and rows["bm25", 101].rr is None
    assert rows["bm25", 102].n_queries == 2 and rows["bm25", 102].decision == "baseline" and rows["rrf", 102].decision in ("adopt", "keep_baseline")
    # A run of one method replaces its own partitions and leaves the others'.
    alone = R.report(spark, *paths, out, R.ReportConfig(methods=("bm25",)))
    assert rows_of(alone) == one
    assert sorted(p.name for p in (tmp_path / "out" / "summary").iterdir() if p.is_dir()) == ["method=bm25", "method=rerank", "method=rrf"]


def test_report_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels"))
    assert R.report(spark, *(str(tmp_path / n) for n in ("docs", "asked", "labels")), str(tmp_path / "out")).collect() == []


def test_configs(tmp_path):
    assert C.RefreshConfig.read(str(ROOT / "jobs" / "chunk_refresh.json")) == C.RefreshConfig()
    assert R.ReportConfig.read(str(ROOT / "jobs" / "retrieval_report.json")) == R.ReportConfig()
    (tmp_path / "bad.json").write_text(json.dumps({"methods": ["rerank"]}))
    with pytest.raises(ValueError):
        R.ReportConfig.read(str(tmp_path / "bad.json"))


def test_command_lines(spark, tmp_path):
    add(spark, tmp_path / "in", [(i, prose(i, 6), "en", "a", 1) for i in range(3)])
    given = [f"--{n}={tmp_path / p}" for n, p in (("documents", "in"), ("output", "out"), ("checkpoint", "mark"))]
    said = subprocess.run([sys.executable, str(ROOT / "jobs" / "chunk_refresh.py"), *given], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and "read 3 rows, wrote 3 new or changed documents" in said.stderr, said.stderr[-2000:]
    assert C.current(spark, str(tmp_path / "out")).select("doc_id").distinct().count() == 3
