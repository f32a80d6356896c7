"""Texts to vectors by a model on the workers, and a vector table that encodes only what it doesn't hold."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlquarry.functions.scalars import TOKEN


class Model(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """A row of numbers for each text."""


@dataclass(frozen=True)
class EncoderConfig:
    """model and dim name what made a vector; with the prefix and the text they are its content key. batch: texts in a call."""

    model: str = "hashing"
    dim: int = 64
    query_prefix: str = "query: "
    document_prefix: str = "passage: "
    batch: int = 256

    def prefix(self, kind: str) -> str:
        return {"query": self.query_prefix, "document": self.document_prefix}[kind]

    def identity(self) -> str:
        """What vectors depend on; the size of a call isn't part of it."""
        return json.dumps({k: v for k, v in asdict(self).items() if k in ("model", "dim")}, sort_keys=True)


class HashingModel:
    """Signed counts of words in hashed places, of unit length: a model that needs no training and no file."""

    def __init__(self, dim: int):
        self.dim = dim
        self.place = lru_cache(1 << 16)(self._place)

    def _place(self, word: str) -> tuple[int, int]:
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return h % self.dim, 1 - 2 * (h // self.dim % 2)

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(TOKEN, text):
                at, sign = self.place(word.lower())
                row[at] += sign
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def hashing(cfg: EncoderConfig) -> Callable[[], Model]:
    return lambda: HashingModel(cfg.dim)


def vectors(text: Column, cfg: EncoderConfig, kind: str = "document", load: Callable[[], Model] | None = None) -> Column:
    """The vectors of texts behind their kind's prefix; null texts are empty. load makes the model, once for each task."""
    make, prefix, size = load or hashing(cfg), cfg.prefix(kind), cfg.batch

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for batch in batches:
            # Texts of one call at a time become Python's; what is kept of a batch is its vectors.
            rows = [np.zeros((0, cfg.dim), dtype=np.float32)]
            for at in range(0, len(batch), size):
                rows.append(np.asarray(model.encode([prefix + (t or "") for t in batch.slice(at, size).to_pylist()]), dtype=np.float32))
            made = np.concatenate(rows[1:] or rows)
            offsets = np.arange(0, made.size + 1, made.shape[1], dtype=np.int32) if made.shape[1] else np.zeros(len(made) + 1, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(made.reshape(-1)))

    return run(text)


def content_key(text: Column, cfg: EncoderConfig, kind: str = "document") -> Column:
    """A hash of the model's identity, the prefix and the text."""
    return F.sha2(F.concat(F.lit(f"{cfg.identity()}\n{cfg.prefix(kind)}\n"), F.coalesce(text, F.lit(""))), 256)


TABLE = "content_key string, embedding array<float>, batch string"


def _table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(folder)


def refresh_vectors(docs: DataFrame, folder: str, batch: str, cfg: EncoderConfig | None = None, load: Callable[[], Model] | None = None) -> DataFrame:
    """doc_id, content_key, embedding, fresh of docs (doc_id, text), from the vector table in folder.

    Texts whose key the table lacks are encoded, each once however many documents have it, and added as the partition `batch`; fresh
    marks their documents. A batch that is run again writes the same partition. One writer at a time. Keys alone are shuffled to find
    what is missing; texts only of what is. Edited texts have other keys; what no document has any more stays until compact().
    """
    cfg = cfg or EncoderConfig()
    spark = docs.sparkSession
    spark.createDataFrame([], TABLE).write.mode("ignore").partitionBy("batch").parquet(folder)
    wanted = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("content_key", content_key(F.col("text"), cfg))
    known = _table(spark, folder).filter(F.col("batch") != batch).select("content_key")
    lacking = wanted.select("content_key").distinct().join(known, "content_key", "left_anti")
    texts = wanted.join(lacking, "content_key", "left_semi").select("content_key", "text").dropDuplicates(["content_key"])
    made = texts.select("content_key", vectors(F.col("text"), cfg, "document", load).alias("embedding"), F.lit(batch).alias("batch"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)
    return wanted.select("doc_id", "content_key").join(_table(spark, folder), "content_key").select("doc_id", "content_key", "embedding", (F.col("batch") == batch).alias("fresh"))


def compact(docs: DataFrame, folder: str, target: str, cfg: EncoderConfig | None = None) -> DataFrame:
    """Copy the vectors that docs still need into one partition of another folder, which takes the table's place from then on."""
    cfg = cfg or EncoderConfig()
    spark = docs.sparkSession
    keys = docs.select(content_key(F.col("text").cast("string"), cfg).alias("content_key")).distinct()
    kept = _table(spark, folder).join(keys, "content_key", "left_semi").withColumn("batch", F.lit("compacted"))
    kept.write.mode("overwrite").partitionBy("batch").parquet(target)
    return _table(spark, target)
