"""The corpus pipeline over documents: toxic texts go, one of each near-duplicate group stays, secrets are masked, sources are
mixed to target weights and what is left is packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlquarry.llm.hyperminhash import drop_near_duplicates
from marlquarry.llm.mixing import MixConfig, sample
from marlquarry.llm.packing import pack
from marlquarry.llm.secrets import redact_secrets
from marlquarry.llm.toxicity import drop_toxic, train
from marlquarry.llm.workspace import Workspace


#: The pipeline keeps its share of all tokens, also where a scarce value then falls short of its target.
MIXING = MixConfig(floor=0.7)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, with a model that learns from the labels table and docs."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group at five words and a similarity of 0.8."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with raked probabilities."""
    return sample(docs, MIXING)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: A trained classifier, hashing and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again by the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(STAGES[k - 1][0])
    return docs
