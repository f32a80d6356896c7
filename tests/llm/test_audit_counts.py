"""The filter audit and token counts."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marlquarry.llm import audit as A
from marlquarry.llm import token_counts as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def brute_audit(rows, labels):
    """Every order applied to the documents one by one."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = []
    for i, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        seen.append((source or "", {k for k, f in fails.items() if f}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {s[0] for s in seen}:
        for order in map("".join, permutations("ABCDE")):
            left = own = [s for s in seen if s[0] == part]
            for step, f in enumerate(order, 1):
                gone = [s for s in left if f in s[1]]
                left = [s for s in left if f not in s[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = (len(left), len(gone), sum(f in s[1] for s in own) - len(gone), sum(s[1] == {f} for s in own), sum(s[2] for s in gone), sum(s[3] for s in gone))
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def many_texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "x#y", "été", "\U0001f600", "LOUD", "z", "a\x85b", "50%"]
    texts = [None, "", " \t\n", "one", "é" * 100, " ".join(["same"] * 60), "A" * 6 + "b" * 94, "word " * 20_000, " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))]
    texts += [rng.choice([" ", "\n", "\x0b"]).join(rng.choice(words) + (str(rng.randrange(90)) if rng.random() < 0.7 else "") for _ in range(rng.randrange(90))) for _ in range(120)]
    return [(rng.choice([None, *range(300)]), rng.choice(texts), rng.choice([None, "", "a", "b'c"])) for _ in range(400)]


def test_audit_is_every_order_applied(spark):
    rows = many_texts()
    labels = [(i, i % 3 % 2, None if i % 7 == 0 else int(i % 5 == 0)) for i in range(0, 400, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).repartition(7)
    got = A.filter_audit(docs.selectExpr("*", "'x' as mask", "1 as n", "'y' as part", "2 as step"), spark.createDataFrame(labels, LABELS).selectExpr("*", "'z' as source", "1 as n"))
    assert got.columns == COLUMNS
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes if c not in COLUMNS[:3]} == {"bigint"}
    want = brute_audit(rows, labels)
    assert sorted(tuple(r) for r in got.collect()) == want
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", spark.createDataFrame(labels, LABELS).toArrow())
    assert sorted(con.execute(f"select {', '.join(COLUMNS)} from ({A.oracle()})").fetchall()) == want


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert A.filter_audit(docs, labels).collect() == []
    one = A.filter_audit(spark.createDataFrame([(1, "a b", "en", None, 3)], DOCS), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and {r.shapley for r in one} == {0, 120}


def test_sums_invert_to_cells_and_merge(spark):
    rng = random.Random(3)
    rows = [(rng.choice("pq"), rng.randrange(32), rng.random() < 0.4, rng.random() < 0.2, rng.randrange(1, 10**12)) for _ in range(300)]
    schema = "part string, mask int, good boolean, toxic boolean, n long"
    whole = A.mask_cells(A.parity_sums(spark.createDataFrame(rows, schema)))
    got = {(r.part, r.label): r.cells for r in whole.collect()}
    for part in "pq":
        for label, keep in (("all", lambda r: True), ("good", lambda r: r[2]), ("toxic", lambda r: r[3])):
            assert got[part, label] == [sum(r[4] for r in rows if r[0] == part and r[1] == m and keep(r)) for m in range(32)]
    halves = [A.parity_sums(spark.createDataFrame(h, schema)) for h in (rows[:150], rows[150:])]
    merged = halves[0].unionByName(halves[1]).selectExpr("part", "label", "posexplode(sums) as (s, v)").groupBy("part", "label", "s").sum("v").groupBy("part", "label")
    merged = merged.agg(*(A.F.sum(A.F.when(A.F.col("s") == s, A.F.col("sum(v)"))).alias(f"s{s}") for s in range(32))).select("part", "label", A.F.array(*(f"s{s}" for s in range(32))).alias("sums"))
    assert {(r.part, r.label): r.cells for r in A.mask_cells(merged).collect()} == got


# Token counts


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path(C.JSON))


END = "<|endoftext|>"


def odd_text(rng, n):
    bits = [" ", "  ", "\n", " \n\n ", " ", "　", "a", "the", "'s", "'ll", "'", "é", "경복궁", "\U0001f600", "é", "12", "٣", "!?", "<|", "|>", END, END[:5], END[5:], "<" + END, "aaaa" * 9, "x" * 70, " " * 40, "_", "\x00", "\x85", "ß"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_spliced_ids_are_those_of_the_whole(whole):
    rng = random.Random(11)
    for k in range(3000):
        text = odd_text(rng, rng.randrange(120))
        chunk = rng.choice([4, 17, 33, 64, 128])
        cfg = C.CountConfig(chunk=chunk, overlap=rng.randrange(1, chunk))
        assert [*C.token_ids(text, cfg)] == whole.encode(text, add_special_tokens=False).ids, (k, text, cfg)


def test_counts_of_long_texts(spark, sf, whole):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = ["\n".join(texts[:60]), "a" * 50_000 + " b", " " * 40_000 + "x", "ab " * 30_000 + END + "c" * 300, END * 3_000, "가" * 20_000, *texts[:20], ""]
    want = [len(e) for e in whole.encode_batch(texts, add_special_tokens=False)]
    for cfg in (C.CountConfig(), C.CountConfig(chunk=1000, overlap=20)):
        assert C.counts(texts, cfg) == want


def test_a_chunk_is_never_much_longer_than_asked(monkeypatch):
    tokenizer, margin = C.load()
    longest = []

    class Watched:
        def encode(self, text, **options):
            longest.append(len(text))
            return tokenizer.encode(text, **options)

    monkeypatch.setattr(C, "load", lambda path=None: (Watched(), margin))
    text = "some words, and more of them. " * 4_000
    assert sum(b - a for _, a, b in C.spliced(text, C.CountConfig(chunk=2_000, overlap=100))) == len(tokenizer.encode(text, add_special_tokens=False))
    assert max(longest) <= 2_000 and len(longest) < 70


def test_token_counts_of_a_table(spark, whole):
    texts = [None, "", " \n", "word " * 1024, "word " * 1023 + "word", "é\U0001f600" + END, "twin", "twin", "x " * 600_000, "y" * 5_000]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (3, "again", None, None, 1)], DOCS)
    got = sorted((tuple(r) for r in C.count_tokens(docs.selectExpr("*", "1 as n_tokens", "2 as n_bytes", "true as over_limit")).collect()), key=repr)
    n = lambda t: len(whole.encode(t or "", add_special_tokens=False))
    rows = [*enumerate(texts), (None, "no id"), (3, "again")]
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 1024) for i, t in rows), key=repr)
    assert C.count_tokens(docs.limit(0)).collect() == []
    assert C.count_tokens(docs).schema.simpleString() == "struct<doc_id:bigint,n_bytes:bigint,n_tokens:bigint,over_limit:boolean>"


def test_splices_need_a_proof(tmp_path):
    with pytest.raises(ValueError):
        C.load(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        C.CountConfig(chunk=10, overlap=10)
    assert pa.array(C.counts([], C.CountConfig())).to_pylist() == []
