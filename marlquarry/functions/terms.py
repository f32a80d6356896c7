"""Terms of texts and how often each stands in its text, counted within the batch that holds the text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlquarry.functions.scalars import TOKEN

#: Bytes of text, about, whose terms make one batch of rows.
SLICE = 1 << 20
#: The only characters outside A-Z whose lower case holds a token's character; texts with them are lower-cased token by token.
_ODD = re.compile("[\u0130\u212a]")


def slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE bytes, of one row at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield start, stop
        start = stop


def cutter(pattern: str):
    """A function from a text, or null, to its tokens, lower-cased after they are cut out."""
    cut = re.compile(pattern).findall
    return lambda text: [] if not text else [x.lower() for x in cut(text)] if _ODD.search(text) else cut(text.lower())


def term_counts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), pattern: str = TOKEN, n: int = 1) -> DataFrame:
    """keys, dl, token, tf: how often each row of docs (keys, text) holds each token, lower-cased after it is cut out; dl: tokens of the row.

    Each row also gives the token '' with tf 0, so that one without tokens is seen. n: rows of n tokens or more give their runs of 2 .. n tokens
    too, joined by blanks. Null text has none. A text is cut and counted where it lies, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tokens = cutter(pattern)
        for batch in batches:
            for start, stop in slices(batch.column("text")):
                token, tf, size, length = [], [], [], []
                for text in batch.column("text").slice(start, stop - start).to_pylist():
                    found = own_tokens(text)
                    counts = Counter(found)
                    if n > 1 and len(found) >= n:
                        for k in range(2, n + 1):
                            counts.update(map(" ".join, zip(*(found[i:] for i in range(k)))))
                    token.append("")
                    token.extend(counts)
                    tf.append(0)
                    tf.extend(counts.values())
                    size.append(len(counts) + 1)
                    length.append(len(found))
                at = pa.array(np.repeat(np.arange(start, stop), size))
                for part in range(0, len(token), 1 << 18):
                    own = slice(part, part + (1 << 18))
                    rows = at[own]
                    columns = [*(batch.column(c).take(rows) for c in keys), pa.array(np.repeat(np.array(length, dtype=np.int32), size)[own]), pa.array(token[own], pa.string()), pa.array(tf[own], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "dl", "token", "tf"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, f"{kinds}, dl int, token string, tf int")


#: Tokens, about, whose counts a task holds before it hands them on.
HELD = 1 << 17


def frequencies(docs: DataFrame, keys: tuple[str, ...] = (), pattern: str = TOKEN) -> DataFrame:
    """keys, token, df, length: in how many rows of docs (keys, text) each token stands. The token '' has the number of rows as df and, as length, how
    many tokens they hold. Rows are counted where they lie, so what is shuffled is a task's tokens, not its texts'."""
    kinds = [docs.schema[c].dataType for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tokens = cutter(pattern)
        types: list[pa.DataType] = []
        counts: dict[tuple, Counter] = {}
        lengths: Counter = Counter()

        def made() -> pa.RecordBatch:
            size = [len(c) for c in counts.values()]
            told = [pa.array([k[i] for k in counts], t).take(pa.array(np.repeat(np.arange(len(counts)), size))) for i, t in enumerate(types)]
            token = pa.array([x for c in counts.values() for x in c], pa.string())
            df = pa.array([n for c in counts.values() for n in c.values()], pa.int64())
            length = pa.array([lengths[k] if not x else 0 for k, c in counts.items() for x in c], pa.int64())
            counts.clear()
            lengths.clear()
            return pa.RecordBatch.from_arrays([*told, token, df, length], names=[*keys, "token", "df", "length"])

        for batch in batches:
            types = [batch.column(c).type for c in keys]
            for start, stop in slices(batch.column("text")):
                part = batch.slice(start, stop - start)
                for *key, text in zip(*(part.column(c).to_pylist() for c in (*keys, "text")), strict=True):
                    found, key = own_tokens(text), tuple(key)
                    own = counts.get(key)
                    if own is None:
                        own = counts[key] = Counter()
                    own.update(set(found))
                    own[""] += 1
                    lengths[key] += len(found)
                if sum(map(len, counts.values())) > HELD:
                    yield made()
        if counts:
            yield made()

    schema = ", ".join([*(f"`{c}` {t.simpleString()}" for c, t in zip(keys, kinds, strict=True)), "token string, df long, length long"])
    rows = docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return rows.groupBy(*keys, "token").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
