"""Training-order materialisation: a keyed Feistel permutation deals sequences to slots of fixed-stride shards.

Sequences get dense numbers; the permutation of 0 .. n - 1 (a Feistel network over the next even power of two, walked until it
falls below n) gives each a slot. Slots are dealt by range to shards, files of records of one stride, so a reader
seeks to any slot, reads on in training order, and resumes from a slot number alone.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlquarry.llm.textvec import U64, mix
from marlquarry.llm.tokens import document_ids
from marlquarry.llm.workspace import Workspace, with_temp_dir


@dataclass(frozen=True)
class OrderConfig:
    """length: ids of a sequence. shard: slots of a shard. dtype: '<u2' holds vocabularies of up to 65,536 ids.

    Sequences travel to their shards compressed, with a dictionary from up to `sample` of them (its documented bound).
    """

    length: int = 1024
    shard: int = 8192
    sample: int = 256
    level: int = 6
    key: int = 0x5EED
    rounds: int = 6
    dtype: str = "<u2"
    tokenizer: str | None = None

    @property
    def stride(self) -> int:
        """Bytes of a record: a length, then the ids, padded with zeros."""
        return 4 + self.length * np.dtype(self.dtype).itemsize


def _feistel(x: np.ndarray, half: int, key: int, rounds: int, back: bool) -> np.ndarray:
    mask = U64((1 << half) - 1)
    left, right = x >> U64(half), x & mask
    for r in range(rounds)[:: -1 if back else 1]:
        salt = U64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)
        if back:
            left, right = right ^ (mix(left ^ salt) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ salt) & mask)
    return left << U64(half) | right


def permute(x: np.ndarray, n: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """The slots of numbers below n, or with back the numbers of slots. Cycle-walking keeps both below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    out = _feistel(np.asarray(x, dtype=U64), half, key, rounds, back)
    while (late := out >= U64(n)).any():
        out[late] = _feistel(out[late], half, key, rounds, back)
    return out.astype(np.int64)


SEQUENCE = "part int, local long, doc_ids array<long>, lengths array<int>, start long, length long, ids_crc32 long, ids binary"


def sequences(documents: DataFrame, cfg: OrderConfig) -> DataFrame:
    """The ids of all documents, each closed by the end id, one after another in sequences of cfg.length.

    Only the last sequence of a task may be shorter. doc_ids and lengths say whose ids follow each other in a sequence, and how
    many; start is how many ids of the first document came in sequences before.
    """
    top = np.iinfo(np.dtype(cfg.dtype)).max
    types = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in SEQUENCE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, local, filled = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        rows: list[tuple] = []

        def close() -> None:
            nonlocal held, filled, local
            ids = np.concatenate([x for _, _, x in held])
            rows.append((part, local, [d for d, _, _ in held], [len(x) for _, _, x in held], held[0][1], len(ids), zlib.crc32(ids.tobytes()), ids.astype(cfg.dtype).tobytes()))
            held, filled, local = [], 0, local + 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = document_ids(text.as_py(), cfg.tokenizer)
                if ids.max() > top:
                    raise ValueError(f"ids up to {ids.max()} don't fit in {cfg.dtype}")
                at = 0
                while at < len(ids):
                    own = ids[at : at + cfg.length - filled]
                    held.append((doc_id, at, own))
                    at, filled = at + len(own), filled + len(own)
                    if filled == cfg.length:
                        close()
                if len(rows) >= 2048:
                    yield batch_of()
        if held:
            close()
        yield batch_of()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, SEQUENCE)


def _dictionary(found: DataFrame, cfg: OrderConfig) -> bytes:
    """A zstandard dictionary of a bounded sample of sequences; empty where there are too few."""
    rows = found.select("ids").limit(cfg.sample).collect()
    if len(rows) < 64:
        return b""
    return zstandard.train_dictionary(1 << 16, [bytes(r["ids"]) for r in rows]).as_bytes()


def _with_dictionary(words: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}


def _slots(n: int, cfg: OrderConfig, words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=cfg.level, **_with_dictionary(words))
        for batch in batches:
            slot = permute(batch.column("number").to_numpy(), n, cfg.key, cfg.rounds)
            ids = pa.array([press.compress(x.as_buffer()) for x in batch.column("ids")], pa.binary())
            batch = batch.set_column(batch.schema.get_field_index("ids"), "ids", ids)
            yield batch.append_column("slot", pa.array(slot)).append_column("shard", pa.array(slot // cfg.shard))

    return run


def _shard_writer(folder: str, cfg: OrderConfig, words: bytes):
    """Writes the sorted slots of whole shards. A shard's file gets its name when it is complete; a task that runs again
    writes the same bytes. Rows of the written records follow."""
    width = np.dtype(cfg.dtype).itemsize * cfg.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        shard, sink, temp = None, None, ""
        unpack = zstandard.ZstdDecompressor(**_with_dictionary(words))

        def close() -> None:
            if sink is not None:
                sink.close()
                files.move(f"{root}/{temp}", f"{root}/shard-{shard:08d}.bin")

        for batch in batches:
            for own, lengths, ids in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist(), batch.column("ids"), strict=True):
                if own != shard:
                    close()
                    shard, temp = own, f"_tmp-{uuid.uuid4().hex}"
                    sink = files.open_output_stream(f"{root}/{temp}", compression=None)
                sink.write(int(lengths).to_bytes(4, "little") + unpack.decompress(ids.as_buffer()).ljust(width, b"\0"))
            offset = pc.multiply(pc.subtract(batch.column("slot"), pc.multiply(batch.column("shard"), cfg.shard)), cfg.stride)
            keep = ("doc_ids", "lengths", "start", "length", "ids_crc32", "number", "slot", "shard")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), offset], names=[*keep, "offset"])
        close()

    return run


ORDER = "doc_ids array<long>, lengths array<int>, start long, length long, ids_crc32 long, number long, slot long, shard long, offset long"


def materialise(documents: DataFrame, folder: str | None = None, cfg: OrderConfig | None = None) -> tuple[DataFrame, str]:
    """Write shards of all sequences of documents (doc_id, text) in training order; gives a row per sequence and the folder.

    A null text has the one id that ends it; repeated rows have sequences each; an empty table writes no shard. Numbers
    follow the order in which the first pass wrote the sequences. folder is a URI that all executors share.
    """
    cfg = cfg or OrderConfig()
    spark = documents.sparkSession
    folder = folder or with_temp_dir(spark, "shards")
    ws = Workspace(spark, "training-order")
    found = ws.table(sequences(documents, cfg), "sequences")
    # One row for each task of the first pass: its first number.
    parts = found.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    first, total = [], 0
    for row in parts:
        first.append((row["part"], total))
        total += row["n"]
    starts = F.broadcast(spark.createDataFrame(first, "part int, first long"))
    numbered = found.join(starts, "part").withColumn("number", F.col("first") + F.col("local")).drop("part", "local", "first")
    words = _dictionary(found, cfg)
    slotted = numbered.mapInArrow(_slots(total, cfg, words), "doc_ids array<long>, lengths array<int>, start long, length long, ids_crc32 long, ids binary, number long, slot long, shard long")
    # Shard k is the range of slots from k * cfg.shard on; each range is a partition of its own, and all are equally large.
    shards = max(1, -(-total // cfg.shard))
    dealt = slotted.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    rows = ws.table(dealt.mapInArrow(_shard_writer(folder, cfg, words), ORDER), "order")
    ws.drop("sequences")
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/index.json", compression=None) as sink:
        sink.write(json.dumps({"sequences": total, "length": cfg.length, "shard": cfg.shard, "stride": cfg.stride, "dtype": cfg.dtype, "key": cfg.key}).encode())
    return rows, folder


def read_from(folder: str, slot: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Sequences in training order from a slot on: (slot, ids). Reads one record at a time."""
    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/index.json", compression=None) as source:
        about = json.loads(source.read())
    end = about["sequences"] if count is None else min(about["sequences"], slot + count)
    while slot < end:
        shard = slot // about["shard"]
        with files.open_input_file(f"{root}/shard-{shard:08d}.bin") as source:
            source.seek((slot - shard * about["shard"]) * about["stride"])
            while slot < min(end, (shard + 1) * about["shard"]):
                record = source.read(about["stride"])
                n = int.from_bytes(record[:4], "little")
                yield slot, np.frombuffer(record, dtype=about["dtype"], offset=4)[:n].astype(np.int64)
                slot += 1


def training_order(documents: DataFrame, cfg: OrderConfig | None = None) -> DataFrame:
    """The rows of materialise(), of shards in a new folder below spark.checkpoint.dir."""
    return materialise(documents, cfg=cfg)[0]
