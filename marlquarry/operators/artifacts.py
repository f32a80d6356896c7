"""Whether nested artifacts may be public: every string in them, keys included, is held against the leak rules."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlquarry.functions.scalars import flags
from marlquarry.operators.normalize import LONGEST, has_private_path, has_secret_marker, is_source_like

#: Fields that no public row may have, and the longest string of a public catalog.
FORBIDDEN_FIELDS = ("answer", "answer_text", "context_text", "content", "html", "markdown", "raw_text", "search_text", "source_text", "text")
CATALOG_LONGEST = 120

#: Strings, about, that a task holds before it hands them on.
ROWS = 20_000

_TOKENS = re.compile(r'\s*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|([{}\[\],:])|(true|false|null|-?[0-9][0-9.eE+-]*)|$)')


def strings(payload: str) -> Iterator[tuple[str, int, str, str]]:
    """(kind, depth, path, text) of each string value and key of a JSON text, in order; kind is 'value' or 'key'.

    A walk along the tokens with a stack of its own, so any depth will do. A text that isn't JSON raises ValueError.
    """
    stack: list[list] = []  # of an object: the open key, or None; of a list: the next place
    at, wants = 0, "value"  # wants: value, key, colon or end (a comma or a close)
    just_opened = False
    while True:
        found = _TOKENS.match(payload, at)
        if not found:
            raise ValueError(f"no JSON at {at}")
        at = found.end()
        text, mark, plain = found.groups()
        opened, just_opened = just_opened, False
        if text is None and mark is None and plain is None:
            if stack or wants != "end":
                raise ValueError("JSON ends early")
            return
        if text is not None and wants == "key":
            stack[-1] = [json.loads(text)]
            yield "key", len(stack), _path(stack), stack[-1][0]
            wants = "colon"
        elif mark == ":" and wants == "colon":
            wants = "value"
        elif wants == "value" and mark in ("{", "["):
            stack.append([None] if mark == "{" else [0, ""])
            wants, just_opened = ("key" if mark == "{" else "value"), True
        elif wants == "value" and (text is not None or plain is not None):
            if text is not None:
                yield "value", len(stack), _path(stack), json.loads(text)
            wants = "end"
        elif mark == "," and wants == "end" and stack:
            if len(stack[-1]) == 2:
                stack[-1][0] += 1
            wants = "value" if len(stack[-1]) == 2 else "key"
        elif mark in ("}", "]") and stack and (len(stack[-1]) == 2) == (mark == "]") and (wants == "end" or opened):
            stack.pop()
            wants = "end"
        else:
            raise ValueError(f"no JSON at {at}")


def _path(stack: list[list]) -> str:
    return "$" + "".join(f"[{s[0]}]" if len(s) == 2 else f".{s[0]}" for s in stack)


def string_rows(artifacts: DataFrame, key: str = "artifact_id", payload: str = "payload") -> DataFrame:
    """key, kind, depth, path, value: a row for each string and key in the JSON column, at any depth.

    A payload that isn't JSON has one row of kind 'unreadable'; a null one has none. Paths are '$.field[place].field'. The walk is
    narrow: no row is shuffled, and the number of jobs doesn't follow the depth.
    """

    def made(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = (kind, pa.string(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "kind", "depth", "path", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                if text.as_py() is None:
                    continue
                done = len(out)
                try:
                    out.extend((k.as_py(), *row) for row in strings(text.as_py()))
                except ValueError:
                    del out[done:]
                    out.append((k.as_py(), "unreadable", 0, "$", None))
                if len(out) >= ROWS:
                    yield made(out, batch.schema.field(0).type)
                    out = []
            yield made(out, batch.schema.field(0).type)

    kind = artifacts.schema[key].dataType.simpleString()
    return artifacts.select(key, F.col(payload).cast("string")).mapInArrow(run, f"{key} {kind}, kind string, depth int, path string, value string")


def artifact_quality(artifacts: DataFrame, blocks: DataFrame, key: str = "artifact_id", longest: int = LONGEST) -> DataFrame:
    """One row per artifact: counters of leaks, and the names of the gates that fail.

    artifacts: key, payload (JSON); blocks: key, n_blocks, runs of prose lines in the artifact's own text. Keys count as strings too.
    A forbidden field counts as raw text wherever it stands, and once more if it is a field of a row of $.results. longest: the most
    characters of a public string; CATALOG_LONGEST for catalogs. An artifact that can't be read fails.
    """
    rows = string_rows(artifacts, key)
    v = F.coalesce("value", F.lit(""))
    field = (F.col("kind") == "key") & F.col("value").isin(*FORBIDDEN_FIELDS)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    own = rows.groupBy(key).agg(
        F.count("value").alias("n_strings"),
        F.max("depth").alias("depth"),
        n(field).alias("forbidden"),
        n(is_source_like(v, longest)).alias("source_like"),
        n(has_private_path(v)).alias("private_path_leakage_count"),
        n(has_secret_marker(v)).alias("secret_like_leakage_count"),
        n(field & F.col("path").rlike(r"^\$\.results\[[0-9]+\]\.[^.\[]*$")).alias("forbidden_result_field_count"),
        n(F.col("kind") == "unreadable").alias("unreadable"),
    )
    made = artifacts.select(key).join(own, key, "left").join(blocks, key, "left").fillna(0)
    made = made.withColumn("public_raw_text_leakage_count", F.col("forbidden") + F.col("source_like") + F.col("n_blocks"))
    failed = flags(
        public_raw_text_leakage=F.col("public_raw_text_leakage_count") > 0,
        private_path_leakage=F.col("private_path_leakage_count") > 0,
        secret_like_leakage=F.col("secret_like_leakage_count") > 0,
        forbidden_result_fields=F.col("forbidden_result_field_count") > 0,
        unreadable_payload=F.col("unreadable") > 0,
    )
    return made.select(
        key, "n_strings", "depth", "public_raw_text_leakage_count", "private_path_leakage_count", "secret_like_leakage_count", "forbidden_result_field_count", F.array_join(failed, ",").alias("failures")
    )
