"""Leaks in nested artifacts."""

from __future__ import annotations

import json
import random

import pytest

from marlquarry.operators import artifacts as A


def walked(value, depth=0, path="$"):
    """The same by plain recursion over parsed JSON."""
    if isinstance(value, str):
        return [("value", depth, path, value)]
    if isinstance(value, dict):
        return [row for k, v in value.items() for row in [("key", depth + 1, f"{path}.{k}", k), *walked(v, depth + 1, f"{path}.{k}")]]
    if isinstance(value, list):
        return [row for i, v in enumerate(value) for row in walked(v, depth + 1, f"{path}[{i}]")]
    return []


def made(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind < 3:
        return rng.choice(["", "x", "a\nb", 'q"\\u', "é\U0001f600", "C:\\x", "{[,:]}"])
    if kind < 5:
        return rng.choice([None, True, False, 0, -1.5e-7, 12])
    if kind == 5:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcd") * rng.randrange(1, 3): made(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_strings_are_those_of_the_parsed_text():
    rng = random.Random(2)
    for _ in range(500):
        value = made(rng, 6)
        for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1)):
            assert [*A.strings(text)] == walked(value)


@pytest.mark.parametrize("text", ["", " ", "{", '{"a"}', '{"a":}', '{"a":1,}', "[1,]", "[1 2]", "]", "{]", '["a"', '"a" "b"', "nul", '{1:2}', "[,1]", '{"a":1 "b":2}', "'a'"])
def test_what_is_no_json(text):
    with pytest.raises(ValueError):
        list(A.strings(text))


def test_any_depth():
    for depth in (40, 30_000):
        rows = [*A.strings('{"a":[' * depth + '"x"' + "]}" * depth)] if depth == 40 else None
        if rows:
            assert rows[-1] == ("value", 80, "$" + ".a[0]" * 40, "x") and len(rows) == 41
    deep = "[" * 30_000 + '"x"' + "]" * 30_000
    assert [r[1] for r in A.strings(deep)] == [30_000]


def test_artifact_gates(spark):
    rows = [
        ("fine", json.dumps({"results": [{"rank": 1, "doc_id": "d"}], "k": "v"})),
        ("field", json.dumps({"results": [{"rank": 1, "answer": "no"}, {"sub": {"text": "x"}}]})),
        ("deep", json.dumps({"a": [[[{"b": {"html": ["C:\\x", "token=abc", "two\nlines"]}}]]]})),
        ("key", json.dumps({"/home/me": 1})),
        ("long", json.dumps(["x" * 601])),
        ("broken", '{"a": '),
        ("none", None),
        ("prose", "{}"),
    ]
    blocks = spark.createDataFrame([("prose", 2)], "artifact_id string, n_blocks long")
    given = spark.createDataFrame(rows, "artifact_id string, payload string").selectExpr("*", "1 as depth", "'x' as value", "2 as n_blocks").drop("n_blocks")
    got = {r.artifact_id: r for r in A.artifact_quality(given, blocks).collect()}
    assert {k: r.failures for k, r in got.items()} == {
        "fine": "", "field": "public_raw_text_leakage,forbidden_result_fields", "deep": "public_raw_text_leakage,private_path_leakage,secret_like_leakage", "key": "private_path_leakage",
        "long": "public_raw_text_leakage", "broken": "unreadable_payload", "none": "", "prose": "public_raw_text_leakage",
    }
    assert (got["field"].public_raw_text_leakage_count, got["field"].forbidden_result_field_count) == (2, 1)
    assert (got["deep"].public_raw_text_leakage_count, got["deep"].depth, got["none"].n_strings) == (2, 7, 0)
    short = A.artifact_quality(given, blocks, longest=A.CATALOG_LONGEST).filter("artifact_id = 'long'").first()
    assert short.public_raw_text_leakage_count == 1
    assert A.artifact_quality(given.limit(0), blocks).collect() == []
