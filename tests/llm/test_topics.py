"""Topics are a model of all documents, not of the few that its rounds begin with."""

from __future__ import annotations

import random

import numpy as np

from marlquarry.llm.mixing import MixConfig, topics_of, train_topics


def test_topics_are_those_of_all_documents(spark):
    import pyarrow as pa

    rng = random.Random(2)
    words = [[f"theme{t}word{i}" for i in range(30)] for t in range(3)]
    rows = [(i, " ".join(rng.choices(words[i % 3], k=25)) + " common") for i in range(300)] + [(1000, None), (1001, "a b"), (None, "never counted")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cfg = MixConfig(topics=3, sample=4)
    model = train_topics(df, cfg)
    # A feature's weight counts all 300 documents, although the rounds begin with four.
    assert np.isclose(model.idf.min(), 1e-3, atol=1e-6) and np.isclose(model.idf.max(), np.log(301) + 1e-3)
    found, _ = topics_of(pa.array([t for i, t in rows[:300]]), model, cfg)
    whole = train_topics(df, MixConfig(topics=3, sample=2048))
    shares = lambda m: sorted(np.bincount([int(x[1:]) for x in topics_of(pa.array([t for _, t in rows[:300]]), m, cfg)[0]], minlength=3))
    assert shares(whole) == [100, 100, 100] and len(set(found)) >= 2
    split = train_topics(df.repartition(7), cfg)
    assert (split.idf == model.idf).all() and (split.centres == model.centres).all()
    assert train_topics(df.filter("doc_id >= 1000"), cfg) is None


def test_entries_pass_as_bytes_and_are_weighed_once(spark, monkeypatch):
    import pyarrow as pa

    from marlquarry.llm import mixing as X

    values, cut = np.arange(9, dtype=np.int32), np.array([0, 2, 2, 5, 9])
    made = X._binary(values, cut)
    for start, size in ((0, 4), (1, 3), (2, 1), (1, 1), (4, 0)):
        own, at = X._numbers(made.slice(start, size), np.int32)
        assert own.tolist() == values[cut[start] : cut[start + size]].tolist() and at.tolist() == (cut[start : start + size + 1] - cut[start]).tolist()
    rng = np.random.default_rng(4)
    feature, x, centres, row = rng.integers(0, 20, 50), rng.random(50), rng.random((3, 20)), np.repeat(np.arange(5), 10)
    assert np.allclose(X._nearness(feature, x, np.arange(0, 50, 10), centres), [np.bincount(row, x * c[feature], 5) for c in centres])
    assert X._nearness(feature[:0], x[:0], feature[:0], centres).shape == (3, 0)
    # Texts without a longer word lie between others, at the ends and alone.
    model = X.Topics(np.ones(4096, np.float32), rng.random((4096, 3)).astype(np.float32))
    texts = pa.array([None, "alpha words", "a b", "", "gamma gamma delta", "x"])
    found, n = topics_of(texts, model, MixConfig())
    assert [f is None for f in found] == [True, False, True, True, False, True] and n.tolist() == [0, 2, 2, 0, 3, 1]
    assert found[4] == topics_of(texts.slice(4, 1), model, MixConfig())[0][0] and topics_of(texts.slice(2, 2), model, MixConfig())[0] == [None, None]
    # The rounds read a table of shares; only what makes it looks at the counts.
    read = []
    monkeypatch.setattr(X, "_summed", lambda bags, step, size, own=X._summed: (read.append(tuple(bags.columns)), own(bags, step, size))[1])
    df = spark.createDataFrame([(i, f"theme{i % 2}word{i % 7} theme{i % 2}word common") for i in range(50)], "doc_id long, text string")
    train_topics(df, MixConfig(topics=2, sample=4))
    assert read[0] == ("hash", "feature", "times") and set(read[1:]) == {("feature", "x")}


def test_rounds_move_six_bytes_for_an_entry(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from marlquarry.llm import mixing as X

    seen = []

    def sizes(bags, step, size, own=X._summed):
        seen.append(bags.agg(*(F.sum(F.octet_length(c)) for c in bags.columns if c != "hash")).first())
        return own(bags, step, size)

    monkeypatch.setattr(X, "_summed", sizes)
    # Two counts of a row are over 255, which takes four bytes for each count of that row.
    texts = ["alpha beta beta gamma", "alpha " * 300 + "delta " * 70_000 + "beta", "beta gamma delta", None, "a b"]
    model = train_topics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MixConfig(topics=2))
    assert seen[0] == (9 * 2, 3 + 3 * 4 + 3) and set(seen[1:]) == {(9 * 2, 9 * 4)}
    _, at, times, _ = X._bags(pa.array(texts), MixConfig())
    cut = np.array([0, 3, 6, 9])
    assert X._all_counts(X._counts(times, cut), cut).tolist() == times.tolist() and times.max() == 70_000
    idf = np.log(4 / (np.bincount(at, minlength=4096) + 1)) + 1e-3
    assert np.allclose(model.idf, idf) and np.allclose(np.linalg.norm(model.centres, axis=0), 1)
