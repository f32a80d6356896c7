"""Percentiles without lists, resampling by counts, and products of sparse matrices, each against its plain form."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlquarry.functions.scalars import nearest_percentiles
from marlquarry.operators import metrics as M
from marlquarry.operators import products as P


def test_percentiles_are_those_of_the_sorted_list(spark):
    rng = random.Random(8)
    rows = [("a", rng.randrange(50)) for _ in range(700)] + [("b", 7)] + [(None, rng.randrange(10**6)) for _ in range(300)] + [("c", None), ("d", None), ("d", 3), ("d", -3)]
    df = spark.createDataFrame(rows, "g string, x long")
    ps = {"low": 0.0, "half": 0.5, "most": 0.95, "all": 1.0}
    for kind in ("long", "double"):
        got = {r.g: tuple(r[p] for p in ps) for r in nearest_percentiles(df.withColumn("x", F.col("x").cast(kind)), ["g"], "x", ps, parts=5).collect()}
        want = {}
        for g in ("a", "b", None, "d"):
            v = sorted(x for k, x in rows if k == g and x is not None)
            want[g] = tuple(v[round((len(v) - 1) * p)] for p in ps.values())
        assert got == want
    assert nearest_percentiles(df.limit(0), ["g"], "x", ps).collect() == []
    whole = nearest_percentiles(df, [], "x", {"p": 0.5}).first()
    v = sorted(x for _, x in rows if x is not None)
    assert whole.p == v[round((len(v) - 1) * 0.5)]


def test_resampled_interval_is_numpys(spark):
    rng = np.random.default_rng(3)
    values = [*np.round(rng.normal(0.1, 1, 300), 1), *([0.5] * 100)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "value double")
    means = np.array([rng.choice(values, len(values)).mean() for _ in range(10_000)])
    low, high = np.percentile(means, [2.5, 97.5])
    error = 4 * means.std() / 30
    one = M.bootstrap_interval(df).first()
    assert one.n == 400 and one.mean == pytest.approx(np.mean(values), abs=1e-6)
    assert abs(one.ci_low - low) < error and abs(one.ci_high - high) < error
    # Several ranges draw other numbers of the same law; the order of rows and partitions doesn't matter.
    split = M.bootstrap_interval(df, most=7).first()
    assert abs(split.ci_low - low) < error and abs(split.ci_high - high) < error and split.ci_low != one.ci_low
    assert M.bootstrap_interval(df.repartition(5, "value")).first() == one
    same = M.bootstrap_interval(spark.createDataFrame([(2.0,)] * 5, "value double")).first()
    assert (same.mean, same.ci_low, same.ci_high) == (2.0, 2.0, 2.0)
    none = M.bootstrap_interval(df.limit(0)).first()
    assert (none.n, none["mean"], none.ci_low) == (0, None, None)


def test_products_are_those_of_dense_matrices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    q = np.where(rng.random((30, 40)) < 0.2, rng.integers(1, 4, (30, 40)), 0)
    d = np.where(rng.random((2, 300, 40)) < 0.1, rng.integers(1, 5, (2, 300, 40)) / 2, 0)
    queries = spark.createDataFrame([(i, f"t{t}", float(q[i, t])) for i, t in zip(*map(lambda x: x.tolist(), np.nonzero(q)))], "query_id long, term string, w double")
    items = spark.createDataFrame([(f"c{c}", i, f"t{t}", float(d[c, i, t])) for c, i, t in zip(*map(lambda x: x.tolist(), np.nonzero(d)))] + [("c0", 999, "alone", 1.0)], "corpus string, item long, term string, w double")

    def want(c, last_first, k):
        scores = q @ d[c].T
        return {(i, j, s, r + 1) for i in range(30) for r, (s, j) in enumerate(sorted(((s, j) for j, s in enumerate(scores[i]) if s), key=lambda x: (-x[0], -x[1] if last_first else x[1]))[:k])}

    for block, per_range, step in ((256, 2_000_000, 1 << 22), (7, 60, 100)):
        for name, value in (("BLOCK", block), ("RANGE", per_range), ("STEP", step)):
            monkeypatch.setattr(P, name, value)
        got = P.top_products(queries, items, 6, by=("corpus",)).collect()
        for c in (0, 1):
            assert {(r.query_id, r.item, r.score, r.place) for r in got if r.corpus == f"c{c}"} == want(c, True, 6)
        first = P.top_products(queries, items.filter("corpus = 'c0'").drop("corpus"), 4, last_first=False).collect()
        assert {(r.query_id, r.item, r.score, r.place) for r in first} == want(0, False, 4)
    # Weights of zero and below still count as met.
    signed = spark.createDataFrame([(1, "t", -1.0), (2, "t", 0.0), (3, "u", 5.0)], "item long, term string, w double")
    one = P.top_products(spark.createDataFrame([(1, "t", 2.0)], "query_id long, term string, w double"), signed, 5).collect()
    assert sorted((r.item, r.score, r.place) for r in one) == [(1, -2.0, 2), (2, 0.0, 1)]
    assert P.top_products(queries.limit(0), items, 3, by=("corpus",)).collect() == [] and P.top_products(queries, signed.limit(0), 3).collect() == []


def test_terms_are_counted_as_columns_cut_them(spark, monkeypatch):
    from marlquarry.functions import terms
    from marlquarry.functions.scalars import GRAPH_TOKEN, tokens

    texts = ["The the cat, 서울 CAT", "", None, "!!", "xKy İz", "one two one two", "a " * 5000, "Ab9-9bA"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (1 << 20, 4):
        monkeypatch.setattr(terms, "SLICE", size)
        got = {(r.doc_id, r.token): (r.dl, r.tf) for r in terms.term_counts(df).collect()}
        want = {}
        for r in df.select("doc_id", tokens("text").alias("t")).collect():
            want |= {(r.doc_id, x): (len(r.t), r.t.count(x)) for x in ["", *r.t]}
        assert got == want
    grams = {r.token: r.tf for r in terms.term_counts(df.filter("doc_id = 5"), n=3).collect()}
    assert grams == {"": 0, "one": 2, "two": 2, "one two": 2, "two one": 1, "one two one": 1, "two one two": 1}
    assert {r.token for r in terms.term_counts(df.filter("doc_id = 4"), pattern=GRAPH_TOKEN, n=1).collect()} == {""}


def test_dense_groups_hold_one_pair_of_blocks(spark, monkeypatch):
    """However many vectors there are, a group of the dense search is one block of queries and one of documents."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from marlquarry.operators import retrieval as R

    rng = np.random.default_rng(4)
    vectors = rng.integers(-3, 4, (400, 8)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "doc_id long, embedding array<double>")
    queries = df.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    sizes = spark.sparkContext.accumulator(0)
    grouped = PandasCogroupedOps.applyInArrow

    def counted(self, run, schema):
        def seen(left, right):
            sizes.add(int(left.num_rows > 40 or right.num_rows > 100))
            return run(left, right)

        return grouped(self, seen, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", counted)
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in R.dense_topk(df, queries, 7, 50, 20).collect()}
    assert sizes.value == 0
    for q in range(0, 400, 10):
        scores = vectors @ vectors[q]
        best = sorted(range(400), key=lambda d: (-scores[d], -d))[:7]
        assert [got[q, r + 1] for r in range(7)] == [(d, scores[d]) for d in best]
    assert R.dense_topk(df.limit(0), queries, 3).collect() == [] and R.dense_topk(df, queries.limit(0), 3).collect() == []


def test_methods_share_the_lists_they_begin_from(spark, monkeypatch):
    from marlquarry.operators import retrieval as R
    from marlquarry.plans import methods

    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1}", "retrieve") for i in range(6)], "query_id long, query_text string, expected string")
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "doc_id long, embedding array<double>")
    x = methods.Inputs(docs, queries, vectors, vectors.filter("doc_id < 6").withColumnRenamed("doc_id", "query_id"))
    alone = {n: sorted(map(tuple, methods.METHODS[n](x).select("query_id", "doc_id", "score", "rank").collect())) for n in ("bm25", "dense", "hybrid_rrf")}
    calls = []
    for name in ("bm25_topk", "dense_topk"):
        monkeypatch.setattr(R, name, lambda *a, f=getattr(R, name), n=name: calls.append(n) or f(*a))
    rows = methods.run(x, ["bm25", "dense", "hybrid_rrf"]).collect()
    assert sorted(calls) == ["bm25_topk", "dense_topk"]
    assert {n: sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in rows if r.run_label == n) for n in alone} == alone


def test_encoder_keeps_few_words():
    from marlquarry.operators.encoding import HashingModel

    assert HashingModel(8).place.cache_info().maxsize <= 1 << 16


def test_chunks_are_handed_on_in_slices(spark, monkeypatch):
    """A task of the chunk cutter holds a few chunks at a time, not those of a whole batch under every policy."""
    from marlquarry.operators import chunking as C
    from marlquarry.operators import normalize as N

    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of {i} " + "word " * (j % 40) for j in range(30))) for i in range(60)] + [(60, ""), (61, None)], "doc_id long, text string")
    blocks = N.line_blocks(docs)
    whole = sorted(map(str, C.variant_children(blocks, C.VARIANTS, text=True, parents=True).collect()))
    frame, cut = type(docs), type(docs).mapInArrow
    longest = spark.sparkContext.accumulator(0)

    def counted(self, run, schema, *more):
        def seen(batches):
            for batch in run(batches):
                longest.add(int(batch.num_rows > 30))
                yield batch

        return cut(self, seen, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    monkeypatch.setattr(C, "SLICE", 10_000, raising=False)
    assert sorted(map(str, C.variant_children(blocks, C.VARIANTS, text=True, parents=True).collect())) == whole
    assert len(whole) > 600 and longest.value == 0


def test_tree_scores_chunks_without_listing_pairs(spark, monkeypatch):
    """Of each chosen group a query gets its best chunks and the baseline's, from tasks that hold a bounded range of chunks."""
    from marlquarry.operators import graph as G

    rng = random.Random(6)
    words = [f"t{i}" for i in range(40)]
    docs = [(i, rng.randrange(4), rng.sample(words, rng.randrange(0, 20)), rng.randrange(7)) for i in range(300)]
    texts = spark.createDataFrame([(i, 0, f"g{g}", t, h) for i, g, t, h in docs], "doc_id long, kind int, group_id string, tokens array<string>, hints int")
    every = {(q, t): w for q in range(12) for k, t in enumerate(rng.sample(words, 12)) for w in [3 if k < 5 else 1]}
    chosen = [(q, g, r + 1) for q in range(12) for r, g in enumerate(rng.sample(range(4), 2))]
    sizes = {g: sum(d[1] == g for d in docs) for g in range(4)}
    base = {(q, i): rng.random() for q in range(12) for i in rng.sample(range(300), 8)}
    weights = (0.5, 0.32, 0.13, 0.05)
    for block, chunks, cells in ((256, 2048, 1 << 21), (5, 30, 200)):
        for name, value in (("BLOCK", block), ("CHUNKS", chunks), ("CELLS", cells)):
            monkeypatch.setattr(G, name, value, raising=False)
        got = G.best_chunks(
            texts, spark.createDataFrame([(q, 0, f"g{g}", r, sizes[g]) for q, g, r in chosen], "query_id long, kind int, group_id string, gr int, size long"),
            spark.createDataFrame([(q, t, w) for (q, t), w in every.items()], "query_id long, token string, w int"), spark.createDataFrame([(q, i) for q, i in base], "query_id long, doc_id long"), weights, 5, 2,
        ).distinct().collect()
        assert len(got) < 12 * 2 * 300 / 2
        found = {(r.query_id, r.gr, r.doc_id): (r.direct, r.wide, r.hints) for r in got}
        for q, g, r in chosen:
            own, near = [{t for (x, t), w in every.items() if x == q and w == k} for k in (3, 1)]
            held = {i: (len(own & set(t)), len((own | near) & set(t)), h) for i, x, t, h in docs if x == g}
            value = lambda i: round(0.5 * base.get((q, i), 0.0) + 0.32 * held[i][0] / 5 + 0.13 * held[i][1] / 12 + 0.05 * min(held[i][2] / 5, 1), 9)  # noqa: E731, B023
            for i in sorted(held, key=lambda i: (-value(i), -i))[:2]:
                assert found[q, r, i] == held[i]
            assert all(held[i] == x for (a, b, i), x in found.items() if (a, b) == (q, r))


def test_lexical_ranking_shuffles_texts_in_bounded_shares(spark, monkeypatch):
    """Any size of blocks and ranges gives the plain ranking, by corpus, and a task meets no more than its share."""
    import math
    from collections import Counter

    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from marlquarry.operators import retrieval as R

    rng = random.Random(9)
    rows = [(f"c{i % 2}", i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(0, 40)))) for i in range(400)] + [("c0", 400, None), ("c1", 401, "!!")]
    docs = spark.createDataFrame(rows, "corpus string, doc_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(f"W{rng.randrange(1, 30)}" for _ in range(8))) for q in range(25)], "query_id long, query_text string")
    want = {}
    for c in ("c0", "c1"):
        own = {i: (t or "").replace("!", "").split() for x, i, t in rows if x == c}
        df = Counter(w for t in own.values() for w in set(t))
        raw = {w: math.log(len(own) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
        low, avg = 0.25 * sum(raw.values()) / len(raw), sum(map(len, own.values())) / len(own)
        for r in queries.collect():
            q = Counter(r.query_text.lower().split())
            s = {i: sum(n * (raw[w] if raw[w] >= 0 else low) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w, n in q.items() if w in t) for i, t in own.items() if set(t) & set(q)}
            want |= {(c, r.query_id, k + 1): (i, s[i]) for k, i in enumerate(sorted(s, key=lambda i: (-round(s[i], 8), -i))[:6])}
    most = spark.sparkContext.accumulator(0)
    grouped = PandasCogroupedOps.applyInArrow

    def counted(self, run, schema):
        def seen(key, left, right):
            most.add(int(left.num_rows > 12 or right.num_rows > 60))
            return run(key, left, right)

        return grouped(self, seen, schema)

    for block, size in ((1024, 500_000), (5, 200)):
        monkeypatch.setattr(R, "BLOCK", block, raising=False)
        monkeypatch.setattr(R, "TOKENS", size, raising=False)
        if block == 5:
            monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", counted)
        got = {(r.corpus, r.query_id, r["rank"]): (r.doc_id, r.score) for r in R.bm25_best(docs, queries, 6, ("corpus",)).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-7 for k in want)
    assert most.value == 0
    assert R.bm25_best(docs.limit(0), queries, 3).collect() == [] and R.bm25_best(docs, queries.limit(0), 3).collect() == []


def test_frequencies_are_counts_of_rows(spark, monkeypatch):
    from marlquarry.functions import terms

    df = spark.createDataFrame([("a", "x y X"), ("a", None), ("b", "x z"), (None, ""), ("b", "z z")], "c string, text string")
    for held in (1 << 17, 1):
        monkeypatch.setattr(terms, "HELD", held, raising=False)
        got = {(r.c, r.token): (r.df, r.length) for r in terms.frequencies(df, ("c",)).collect()}
        assert got == {("a", "x"): (1, 0), ("a", "y"): (1, 0), ("a", ""): (2, 3), ("b", "x"): (1, 0), ("b", "z"): (2, 0), ("b", ""): (2, 4), (None, ""): (1, 0)}


def test_filled_lists_rank_once(spark, monkeypatch):
    from marlquarry.operators import retrieval as R

    docs = spark.createDataFrame([(i, f"w{i % 3}") for i in range(9)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "w1"), (2, "none")], "query_id long, query_text string")
    made = R.bm25_topk(docs, queries, 4, True)
    assert "FlatMapCoGroupsInArrow" not in made._jdf.queryExecution().toString()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in made.collect()) == [(1, 1, 7), (1, 2, 4), (1, 3, 1), (1, 4, 8), (2, 1, 8), (2, 2, 7), (2, 3, 6), (2, 4, 5)]


def test_refreshed_chunks_are_assembled_from_their_own_row(spark):
    """The job's chunks are those of the joins with all blocks, by one shuffle of the texts."""
    from jobs import chunk_refresh as J
    from marlquarry.operators import chunking as C
    from marlquarry.operators import normalize as N

    text = "\n".join(["Short head", "a | b | table of many words that is long enough", "long � words " * 30, "other words " * 40] * 4)
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, None, "en", None), (3, "", None, "s"), (4, "one", None, None), (5, text[:700], "ko", "t")], "doc_id long, text string, lang string, source string")
    got = J.cut(docs, C.ChunkPolicy())
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    blocks = N.line_blocks(docs)
    rows = C.children(blocks, C.ChunkPolicy()).withColumn("parent_id", F.format_string("doc-%d-p%06d-%02d", "doc_id", "parent_no", "part_no"))
    rows = rows.withColumn("child_id", F.format_string("%s-c%04d", "parent_id", "child_no"))
    want = C.assemble(rows, blocks).join(rows.select("child_id", "n_blocks", "text_length"), "child_id").join(docs.select("doc_id", "lang", "source"), "doc_id")
    columns = ["doc_id", "parent_id", "source", "n_blocks", "text_length", "quality_flags", "text", "text_hash", "lang"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect())) and want.count() >= 5


def _groups_against_sql(spark, folder, rows, query, name):
    """Rows of a tree query over documents of many sources, and those of its SQL."""
    import duckdb

    from marlquarry.plans import doc_queries as D

    spark.createDataFrame([(i, t, "en", s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(q, t) for q, t in enumerate(query)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in D.QUERIES[name](spark, folder).collect())
    want = sorted((q, r, d, round(s, 5)) for q, d, s, r in con.execute(f"select query_id, doc_id, score, rank from ({D.ORACLES[name]})").fetchall())
    return got, want


def _many_groups(n):
    """Twenty-five short texts of one source, then a longer one of each of n sources, of which only the last holds words of narration."""
    filler = " ".join(f"w{i}" for i in range(20))
    return [("a", "alpha beta")] * 25 + [(f"s{i:03}", f"alpha beta {filler}") for i in range(n - 1)] + [("z", f"alpha beta the and of tion {filler}")]


def test_tree_looks_at_every_group_that_shares_a_token(spark, tmp_path, monkeypatch):
    """Of 200 groups with the same tokens the last by name is the best; it must not be dropped before it is scored, at any size of blocks."""
    from marlquarry.operators import graph as G

    rows = _many_groups(200)
    for query, block, size, cells in (("tree_parent", 256, 250_000, 1 << 21), ("tree_summary", 1, 60, 200)):
        for name, value in (("BLOCK", block), ("RANGE", size), ("CELLS", cells)):
            monkeypatch.setattr(G, name, value)
        got, want = _groups_against_sql(spark, f"{tmp_path}/{query}", rows, ["alpha beta", "beta w1 gamma"], query)
        assert got == want and len(rows) - 1 in [d for q, r, d, _ in got if q == 0], query


def test_tree_neighbours_come_from_all_groups_of_a_token(spark, tmp_path, monkeypatch):
    """Of 300 groups that hold the query's token only the last ones share a word; a group that holds this word alone is found by it."""
    from marlquarry.operators import graph as G

    rows = [("a", "alpha")] * 25 + [(f"s{i:03}", "alpha " + ("kin" if i >= 260 else f"w{i} v{i}")) for i in range(300)] + [("z", "kin the and of tion")]
    docs = spark.createDataFrame([(i, t, s, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, parent_id string, root_id string")
    queries = spark.createDataFrame([(0, "alpha")], "query_id long, query_text string")
    ranked = spark.createDataFrame([(0, i, 1.0, i + 1) for i in range(5)], "query_id long, doc_id long, score double, rank int")
    for most in (1 << 21, 50):
        monkeypatch.setattr(G, "MET", most, raising=False)
        found = [r.doc_id for r in G.tree_rank(docs, queries, ranked, k=400, hints=("the", "and", "of", "tion")).collect()]
        assert len(rows) - 1 in found and len(found) == len(rows) - 20
    got, want = _groups_against_sql(spark, str(tmp_path), rows, ["alpha", "kin w1", ""], "tree_summary")
    assert got == want


def test_parts_of_documents_rank_as_their_texts_do(spark, monkeypatch):
    """Chunks under several policies rank as corpora of texts; a task cuts a document's line once, not once for each chunk that holds it."""
    from marlquarry.functions import terms
    from marlquarry.operators import retrieval as R

    rng = random.Random(4)
    lines = [[" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 7))] for _ in range(60)]
    lines[3], lines[4] = ["!!", "--"], ["W2 w2", "w2"]
    parts = [[(f"c{v}", f"{d:02}-{at:02}", list(range(at, min(len(x), at + v + 1)))) for v in range(3) for at in range(len(x)) if (v, d) != (2, 7)] for d, x in enumerate(lines)]
    docs = spark.createDataFrame(list(zip(range(60), lines, parts, strict=True)), "doc_id long, texts array<string>, parts array<struct<variant:string,key:string,spots:array<int>>>").repartition(3)
    texts = spark.createDataFrame([(v, key, "\n".join(lines[d][i] for i in spots)) for d, x in enumerate(parts) for v, key, spots in x], "variant string, doc_id string, text string")
    queries = spark.createDataFrame([(q, " ".join(f"W{rng.randrange(1, 30)}" for _ in range(8))) for q in range(12)] + [(12, "none"), (13, "")], "query_id long, query_text string")
    corpora = ["c0", "c1", "c2"]
    counts = lambda df: {(r.variant, r.token): (r.df, r.length) for r in df.collect()}
    want = {(r.variant, r.query_id, r["rank"]): (r.doc_id, round(r.score, 8)) for r in R.bm25_best(texts, queries, 4, ("variant",)).collect()}
    for block, size, held in ((1024, 500_000, 4 << 20), (5, 60, 40)):
        for name, value in (("BLOCK", block), ("TOKENS", size), ("SLICE", held)):
            monkeypatch.setattr(R, name, value)
        assert counts(R._part_frequencies(docs, corpora)) == counts(terms.frequencies(texts, ("variant",)))
        got = {(r.variant, r.query_id, r["rank"]): (r.key, round(r.score, 8)) for r in R.bm25_parts(docs, corpora, queries, 4).collect()}
        assert got == want and len(want) > 100
    seen, cut = [], R.cutter
    monkeypatch.setattr(R, "cutter", lambda pattern: lambda text: (seen.append(text), cut(pattern)(text))[1])
    R._Parts(docs.toArrow())
    assert sorted(seen) == sorted(t for x in lines for t in x)
    assert R.bm25_parts(docs.limit(0), corpora, queries, 4).count() == 0
