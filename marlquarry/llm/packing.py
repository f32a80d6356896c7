"""Best-fit packing of token sequences, improved by swap-based local search.

Documents longer than a sequence are cut; full pieces are sequences of their own. The short ones are dealt at random
into groups of a bounded size. In a group best fit, longest first, gives a packing; where it has more bins than the ids need,
local search moves and exchanges pieces between underfull bins so that the sum of squared fills grows, and bins that have
run empty go. The search looks at windows of bins of like fill and makes a fixed number of passes, see PackConfig: no
piece is left out, but a few more bins than an endless search would need may remain.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlquarry.llm.tokens import document_ids
from marlquarry.llm.workspace import Workspace


@dataclass(frozen=True)
class PackConfig:
    """group: short pieces per group that is packed as a whole. window: underfull bins that the local search weighs
    against each other at once. rounds: most passes over the bins of a window."""

    length: int = 2048
    group: int = 40_000
    window: int = 400
    rounds: int = 6
    tokenizer: str | None = None


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all are full but the first, which may be shorter."""
    head = n % length
    first = [(0, head)] if head else []
    return first + [(start, length) for start in range(head, n, length)]


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that holds it. Bins by free room, rooms as bits."""
    rooms: dict[int, list[int]] = defaultdict(list)
    mask = 0
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, k = length, len(bins)
            bins.append([])
        bins[k].append(i)
        left = room - size
        if left:
            rooms[left].append(k)
            mask |= 1 << left
    return bins


def _improve(a: list[int], b: list[int], sizes: list[int], length: int) -> bool:
    """The best move, one-for-one or two-for-one exchange between two bins that makes their fills more unequal."""
    fill_a, fill_b = sum(sizes[i] for i in a), sum(sizes[i] for i in b)
    if fill_a < fill_b:
        a, b, fill_a, fill_b = b, a, fill_b, fill_a
    room = length - fill_a
    best, choice = 0, None
    for y in b:
        if best < sizes[y] <= room:
            best, choice = sizes[y], ((), (y,))
    for x in a:
        for y in b:
            gain = sizes[y] - sizes[x]
            if best < gain <= room:
                best, choice = gain, ((x,), (y,))
    if best < room:
        two_b = [(sizes[p] + sizes[q], (p, q)) for k, p in enumerate(b) for q in b[:k]]
        for x in a:
            for size, pair in two_b:
                if best < size - sizes[x] <= room:
                    best, choice = size - sizes[x], ((x,), pair)
        two_a = [(sizes[p] + sizes[q], (p, q)) for k, p in enumerate(a) for q in a[:k]]
        for size, pair in two_a:
            for y in b:
                if best < sizes[y] - size <= room:
                    best, choice = sizes[y] - size, (pair, (y,))
    if choice is None:
        return False
    out, into = choice
    for x in out:
        a.remove(x)
    for y in into:
        b.remove(y)
    a.extend(into)
    b.extend(out)
    return True


def local_search(bins: list[list[int]], sizes: list[int], cfg: PackConfig) -> list[list[int]]:
    """Increase the squared fill of underfull bins; a bin is underfull while it has room. Full bins are left alone."""
    fill = lambda b: sum(sizes[i] for i in b)
    full = [b for b in bins if fill(b) == cfg.length]
    open_bins = sorted((b for b in bins if fill(b) < cfg.length), key=fill, reverse=True)
    # The emptiest bins are where a bin can be saved; they are weighed against each other, window by window.
    least = -(-sum(sizes) // cfg.length)
    if len(bins) > least:
        for start in range(0, len(open_bins), cfg.window):
            part = open_bins[start : start + cfg.window]
            for _ in range(cfg.rounds):
                if sum(cfg.length - fill(b) for b in part) < cfg.length:
                    break  # not one bin can be emptied into the others
                part.sort(key=fill, reverse=True)
                changed = False
                for source in reversed(part):
                    for target in part:
                        if target is source or not source:
                            continue
                        if fill(source) <= fill(target) < cfg.length:
                            changed |= _improve(target, source, sizes, cfg.length)
                part = [b for b in part if b]
                if not changed:
                    break
            full += part
        return full
    return full + open_bins


def pack_sizes(sizes: list[int], cfg: PackConfig) -> list[list[int]]:
    return [b for b in local_search(best_fit(sizes, cfg.length), sizes, cfg) if b]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, cfg: PackConfig, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document (doc_id, text): where it starts in the ids, its length and checksum."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = document_ids(text.as_py(), cfg.tokenizer)
                for k, (start, n) in enumerate(cut(len(ids), cfg.length)):
                    part = ids[start : start + n]
                    rows.append((doc_id, k, start, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, schema)


def _pack_group(cfg: PackConfig):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32", "tag")])
        sizes = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, items in enumerate(pack_sizes(sizes, cfg)):
            at = 0
            for i in items:
                sequence[i], offset[i] = k, at
                at += sizes[i]
        # Sequences of a group are numbered from the group's number in the upper bits.
        sequence += (key[0].as_py() + 1) << 32
        return table.drop_columns(["tag", "bucket"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(documents: DataFrame, cfg: PackConfig | None = None) -> DataFrame:
    """One row per piece of documents (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text has the one id that ends it. Repeated rows are packed each. No row is left out: every id is in one
    piece and every piece in one sequence. An empty table gives no rows. Texts are read once; what is shuffled is
    one small row per short piece. Groups hold about cfg.group pieces whatever the input's size.
    """
    cfg = cfg or PackConfig()
    ws = Workspace(documents.sparkSession, "packing")
    found = ws.table(pieces(documents, cfg).withColumn("tag", F.monotonically_increasing_id()), "pieces")
    short = found.filter(F.col("length") < cfg.length)
    groups = max(1, -(-short.count() // cfg.group))
    bucket = F.pmod(F.xxhash64("tag", "doc_id", "ids_crc32"), F.lit(groups))
    schema = PIECES + ", sequence_id long, offset long"
    packed = short.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_pack_group(cfg), schema)
    # Full pieces are numbered from below zero, by their row tag.
    whole = found.filter(F.col("length") == cfg.length).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("tag")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole)
