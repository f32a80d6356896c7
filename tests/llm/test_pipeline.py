from __future__ import annotations

import zlib

import corpus_pipeline as cp
import numpy as np
import pytest
from tests.llm.test_dedup import brute

from marlquarry.llm import mixing as M
from marlquarry.llm import queries as Q
from marlquarry.llm import secrets as S
from marlquarry.llm import toxicity as T
from marlquarry.llm.packing import cut
from marlquarry.llm.tokens import document_ids


def test_stages_against_brute_force(spark, sf):
    """Each stage on what the one before it keeps, decided anew in Python where the operator is not itself the definition."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = T.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.predicted for r in T.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {i: t for i, t in texts.items() if not scores[i]}
    groups = brute(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    novelty = S._Novelty(S.NoveltyConfig())
    masked = {}
    for i, t in texts.items():
        out, done = "", 0
        for a, b, _ in S.scan_text(t, novelty)[1]:
            if a >= done:
                out += t[done:a] + "<SECRET>"
            done = max(done, b)
        masked[i] = out + t[done:]
    stage = docs
    for name, f in cp.STAGES[:3]:
        stage = f(spark, stage, sf)
        assert stage.columns == columns, name
    got = {r.doc_id: r.text for r in stage.collect()}
    assert got == masked
    mixed = M.mix(stage, cp.MIXING).collect()
    chosen = {r.doc_id for r in mixed if r.selected}
    rows = cp.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == chosen
    for r in rows:
        ids = document_ids(masked[r.doc_id])
        assert (r.start, r.length) in cut(len(ids), 2048) and r.ids_crc32 == zlib.crc32(np.ascontiguousarray(ids[r.start : r.start + r.length]).tobytes())
    assert sum(r.length for r in rows) == sum(len(document_ids(masked[i])) for i in chosen)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, "a b c", None, "s", 5)]])
def test_odd_tables_pass_every_stage(spark, sf, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in cp.STAGES:
        docs = spark.createDataFrame(f(spark, docs, sf).toArrow()) if rows else f(spark, docs, sf)
        assert docs.count() >= 0, name


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_queries_return_a_row_for_each_input(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    n, size = df.count(), spark.read.parquet(f"{sf}/{'pages' if name == 'op2_warc' else 'documents'}.parquet").count()
    if name.startswith("op10"):
        assert sum(r.length for r in df.collect()) > size
    elif name.startswith("op11"):
        assert n == 600 * spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().count()
    else:
        assert n >= size if name.startswith("op6") else n == size
