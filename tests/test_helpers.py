"""Small operators that no registered query uses, by hand."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marlquarry.operators import decisions as D
from marlquarry.operators import normalize as N
from marlquarry.operators import retrieval as R
from marlquarry.operators import speech as V
from marlquarry.sources import files as S


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_texts_are_recovered_by_their_keys(spark):
    schema = "doc_id string, page_local int, element_id string, element_type string"
    blocks = spark.createDataFrame([("d", 1, "e1", "text"), ("d", 1, "e2", "text"), ("d", 2, "e1", "text")], schema)
    source = spark.createDataFrame([("d", 1, "e1", "text", "old", 1), ("d", 1, "e1", "text", "new", 2), ("d", 1, "e2", "table", "no", 1)], schema + ", text string, ordinal int")
    assert rows(N.recover_text(blocks, source).select("page_local", "element_id", "source_text")) == [(1, "e1", "new"), (1, "e2", None), (2, "e1", None)]
    assert rows(N.public_sample(blocks, "element_id", ["page_local", "element_id"], 2)) in ([(1, "e1"), (2, "e1")],)
    held = spark.createDataFrame([(1, "see D:\\Private\\Books\\a"), (2, "see d:/private/books"), (3, "see /else"), (4, None)], "id long, v string")
    assert [r.id for r in N.roots_in(held, "v", spark.createDataFrame([("d:\\private\\BOOKS",)], "root string")).orderBy("id").collect()] == [1, 2]
    entities = spark.createDataFrame([("&eacute;&#8364;&lt;b&gt;",), (None,), ("&unknown;",)], "t string")
    assert [r[0] for r in entities.select(N.unescape_all("t")).collect()] == ["é€<b>", None, "&unknown;"]


def test_lists_of_results(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    ranked = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.4, 2), (3, 1, 0.1, 1), (4, 1, 0.1, 2), (5, 1, 0.2, 1), (5, 2, 0.2, 1)], "query_id long, doc_id long, score double, rank int")
    assert rows(R.result_rows(queries, ranked)) == [(1, 10, 0.5, 1), (1, 11, 0.4, 2), (2, None, None, None)]
    assert rows(S.contiguous_ranks(ranked)) == [(4,), (5,)]
    docs = spark.createDataFrame([("c1", "p1", "d1"), ("c2", "p1", "d1")], "child_id string, parent_id string, doc_id string")
    assert rows(S.target_inventory(docs)) == [("child", "c1"), ("child", "c2"), ("doc", "d1"), ("parent", "p1")]
    runs = spark.createDataFrame([("b", 0.5, 3.0), ("a", 0.5, 3.0), ("c", 0.4, 1.0)], "run_label string, recall double, ms double")
    assert D.best_run(runs, F.desc("recall"), F.col("ms")).first().run_label == "a"
    kinds = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "k string")
    assert rows(D.buckets(kinds, {"x": "one", "y": "one"}, "k")) == [("one", 2), ("other", 2)] and rows(D.buckets(kinds, {}, "k")) == [("other", 4)]


def test_speech_helpers(spark):
    said = spark.createDataFrame([("경복궁과 광화문", ["경복궁", "북촌"]), ("x", []), ("x", ["y"])], "t string, names array<string>")
    assert [r[0] for r in said.select(V.name_accuracy(F.col("t"), F.col("names"))).collect()] == [0.5, 1.0, 0.0]
    x = np.sin(np.linspace(0, 3, 1600))
    half = V.resample_linear(x, 16_000, 8_000)
    assert len(half) == 800 and np.allclose(V.resample_linear(half, 8_000, 16_000), x, atol=1e-2) and len(V.resample_linear(np.zeros(0), 16_000, 8_000)) == 0
    runs = spark.createDataFrame([("tiny", 0.2, 0.4, 100.0), ("base", 0.1, 0.5, 200.0), ("small", 0.05, 0.2, 4000.0)], "model string, cer double, wer double, p95_ms double")
    got = {r.model: r for r in V.model_deltas(runs).collect()}
    assert (got["base"].delta_cer, got["base"].reasons, got["base"].recommended) == (-0.1, "wer_regression", True)
    assert (got["small"].reasons, got["small"].recommended, got["tiny"].delta_wer) == ("too_slow", False, 0.0)


def test_audits_and_costs(spark):
    targets = spark.createDataFrame([(1, "c1", "p1"), (2, "c2", "p1"), (3, "c9", "p1"), (4, "c3", "p3")], "query_id long, child_id string, parent_id string")
    children = spark.createDataFrame([("c1", "p1", 1, 100, 1, 2), ("c2", "p2", 0, 5, 3, 2), ("c3", "p3", 2, 1200, 1, 1)], "child_id string, parent_id string, n_blocks int, text_length int, page_start int, page_end int")
    assert rows(D.target_audit(targets, children)) == [(1, "c1", ""), (2, "c2", "wrong_parent,no_refs,bad_pages,too_short"), (3, "c9", "missing_child"), (4, "c3", "too_long")]
    cited = spark.createDataFrame([("c1", "b1", 1, 2), ("c1", "b2", 1, 2), ("c2", "b3", 1, 1), ("c3", "b9", 1, 1)], "child_id string, block_id string, page_start int, page_end int")
    blocks = spark.createDataFrame([("b1", 1, "f"), ("b2", 2, "f"), ("b3", 2, "f")], "block_id string, page int, source_file string")
    assert rows(D.recoverability(cited, blocks)) == [(3, round(1 / 3, 6))] and rows(D.recoverability(cited.limit(0), blocks)) == [(0, 1.0)]
    items = spark.createDataFrame([("a", "dev"), ("a", "dev"), ("a", "test"), ("z", "dev")], "query_type string, split string")
    assert rows(D.split_readiness(items, ["a", "b"], {"dev": 2, "test": 3})) == [("a", 2, 1, 0, 2), ("b", 0, 0, 2, 3)]
    one = spark.createDataFrame([(1, "t", 0.2, 10.0), (2, "t", 0.4, 30.0)], "query_id long, query_type string, rr double, latency_ms double")
    two = spark.createDataFrame([(1, "t", 0.4, 50.0), (2, "t", 0.4, 20.0), (9, "t", 1.0, 1.0)], one.schema)
    assert rows(D.policy_deltas(one, two, ["rr"])) == [("t", 2, 0.1, 30.0, 50.0)]
    schema = "called boolean, tokens_in long, tokens_out long, price_in double, price_out double, latency_ms double, a_recall double, b_recall double, a_mrr double, b_mrr double"
    calls = [(True, 1_000_000, 0, 2.0, 8.0, 5.0, 0.0, 1.0, 0.5, 0.5), (False, 0, 500_000, 2.0, 8.0, 9.0, 1.0, 1.0, 0.5, 0.25)]
    made = D.generation_costs(spark.createDataFrame(calls, schema)).first()
    assert (made.calls, made.tokens_in, made.cost, made.p95_ms, made.delta_recall, made.delta_mrr, made.decision) == (1, 1_000_000, 6.0, 9.0, 0.5, -0.125, "trade_off")
