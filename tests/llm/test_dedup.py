from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from marlquarry.llm import hyperminhash as H
from marlquarry.llm.components import connected_components
from marlquarry.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute(rows, k, percent):
    """Sizes and components by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in held[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def found(spark, rows, cfg):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(docs, cfg).collect()]


def family(rng, n, base_words, edits):
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    base = [rng.choice(vocab) for _ in range(base_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "percent", "rows", "bands"), [(3, 85, 6, 40), (5, 80, 5, 40)])
def test_agrees_with_brute_force(spark, sf, k, percent, rows, bands):
    cfg = H.DedupConfig(shingle=k, percent=percent, rows=rows, bands=bands)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in H.near_duplicates(docs, cfg).collect()}
    assert got == want


def test_families_near_the_threshold(spark):
    """Copies with many edits: members that link only to some of the others, which buckets of mixed components must find."""
    rng = random.Random(5)
    texts = family(rng, 60, 120, 8) + family(rng, 40, 40, 3) + family(rng, 40, 12, 1)
    passage = " ".join("".join(rng.choice("ijkl") for _ in range(4)) for _ in range(60))
    texts += [passage + " " + t for t in family(rng, 1, 40, 0) + [" ".join("".join(rng.choice("mnop") for _ in range(5)) for _ in range(30)) for _ in range(40)]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    cfg = H.DedupConfig(shingle=3, percent=85, rows=6, bands=40)
    assert {i: (n, c) for i, n, c, _ in found(spark, rows, cfg)} == brute(rows, 3, 85)


def test_crowds_and_places(spark, monkeypatch):
    """Families of which parts share further passages, compared in many places and through crowds of few members."""
    monkeypatch.setattr(H, "CROWD", 24)
    monkeypatch.setattr(H, "PLACE", 16)
    rng = random.Random(11)
    passage = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))
    first, second, third = passage("ijkl", 70), passage("mnop", 25), passage("qrst", 12)
    texts = family(rng, 40, 60, 5) + family(rng, 30, 90, 9)
    for i in range(60):
        texts.append(" ".join([first, second if i % 2 else "", third if i % 3 == 0 else "", passage("uvwx", 6 + i % 9)]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    for cfg in [H.DedupConfig(shingle=3, percent=85, rows=6, bands=40)]:
        assert {i: (n, c) for i, n, c, _ in found(spark, rows, cfg)} == brute(rows, cfg.shingle, cfg.percent)


def test_truncated_copies(spark):
    """Prefixes of one text link in a chain of which the ends don't."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 200 - 8 * i])) for i in range(12)]
    cfg = H.DedupConfig(shingle=3, percent=85, rows=6, bands=40)
    assert {i: (n, c) for i, n, c, _ in found(spark, rows, cfg)} == brute(rows, 3, 85)


def test_edge_rows(spark):
    long = " ".join(f"x{i % 7919}" for i in range(30_000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "One two"), (2, "one TWO"), (7, "one"), (8, "one two three"), (11, long), (12, long + " end"), (None, "one two"), (8, "one two three")]
    got = sorted(found(spark, rows, H.DedupConfig()), key=repr)
    by = {i: (n, c, k) for i, n, c, k in got}
    assert len(got) == len(rows)
    assert by[5] == (0, 5, True) and by[3] == (0, 3, True) and by[9] == (0, 9, True)
    assert by[1] == (1, 1, True) and by[2] == (1, 1, False) and by[7] == (1, 7, True)
    assert by[11][1:] == (11, True) and by[12][1:] == (11, False)
    assert by[None] == (1, None, True)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.near_duplicates(empty).collect() == [] and H.drop_near_duplicates(empty).columns == empty.columns
    docs = spark.createDataFrame([(1, "a b c d e f", "key", 1.0, "rep"), (2, "a b c d e f", "n", 2.0, "regs")], "doc_id long, text string, digest string, n double, rep string")
    kept = H.drop_near_duplicates(docs).collect()
    assert [(r.doc_id, r.digest, r.rep) for r in kept] == [(1, "key", "rep")]


def test_repeated_rows_count_once_when_dropped(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q"), (None, "q")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in H.drop_near_duplicates(docs).collect()) == [0, 0, 1]


def test_estimates_are_close():
    cfg = H.DedupConfig(rows=6, bands=40)
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            a = rng.integers(0, 2**63, 600, dtype=np.uint64)
            n = int(600 * 2 * share / (1 + share))
            b = np.concatenate((a[:n], rng.integers(0, 2**63, 600 - n, dtype=np.uint64)))
            ra, rb = H.registers(a, cfg)[None], H.registers(b, cfg)[None]
            errors.append(H.estimate(ra, rb, np.array([600]), np.array([600]), cfg)[0] - n / (1200 - n))
        assert abs(np.mean(errors)) < 0.02


def test_registers_hold_zeros_and_mantissa():
    cfg = H.DedupConfig(rows=1, bands=1)
    h = np.array([123456789], dtype=np.uint64)
    value = int(H.mix(h ^ np.uint64(0x5851F42D4C957F2D))[0])
    zeros = 64 - value.bit_length()
    mantissa = (value >> (value.bit_length() - 1 - 10)) & 1023
    assert H.registers(h, cfg)[0] == zeros << 10 | mantissa


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).collect() == []
