"""Keep the retrieval chunks of a growing folder of documents up to date.

    python jobs/chunk_refresh.py --documents IN --output OUT --checkpoint MARK [--config jobs/chunk_refresh.json]

Each run takes the files that have come since the last one, drops the documents that are known with the same text, cuts the rest
into chunks and marks those that may not be public. A document that comes again with another text replaces its chunks.

OUT/chunks, by batch and lang, holds the chunks of every version of a document, OUT/versions, by batch, which version each batch took; current()
gives the chunks of each document's last one. A micro-batch writes only partitions of its own number, the versions last: one
that was cut off is run again by the stream with the same files and number, and overwrites what it had written. The mark and the
output belong together; one run at a time may use them.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from dataclasses import dataclass, field

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from marlquarry.functions.lineage import written  # noqa: E402
from marlquarry.operators import chunking as C  # noqa: E402
from marlquarry.operators import normalize as N  # noqa: E402

log = logging.getLogger("chunk_refresh")

CHUNKS = (
    "doc_id long, chunk_id string, parent_id string, source string, n_blocks int, text_length long, quality_flags array<string>, "
    "public_allowed boolean, text string, text_hash string, batch long, lang string"
)
VERSIONS = "doc_id long, version string, n_chunks long, batch long"


@dataclass(frozen=True)
class RefreshConfig:
    """max_files: most new files in a micro-batch. policy: sizes and kinds of blocks, see ChunkPolicy."""

    max_files: int = 1000
    policy: C.ChunkPolicy = field(default_factory=C.ChunkPolicy)

    @classmethod
    def read(cls, path: str) -> RefreshConfig:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        policy = {k: tuple(v) if isinstance(v, list) else v for k, v in told.pop("policy", {}).items()}
        return cls(policy=C.ChunkPolicy(**policy), **told)


def versions_of(batch: DataFrame) -> DataFrame:
    """One row a document: doc_id, version (a hash of the text), text, lang, source. Rows without a doc_id are no documents.

    Repeated rows are one. Of several texts that one batch holds of a document, the one of the greatest hash counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = batch.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(F.sha2(text, 256).alias("version"), text.alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")).alias("v"),
    )
    return rows.groupBy("doc_id").agg(F.max("v").alias("v")).select("doc_id", "v.*")


def cut(docs: DataFrame, policy: C.ChunkPolicy) -> DataFrame:
    """Chunks of docs (doc_id, text, lang, source), one row a document; their ids depend on their document alone."""
    # A document's blocks meet once, with their texts; its chunks need no join with them.
    rows = C.children(N.line_blocks(docs, "lang", "source"), policy, True, ("lang", "source")).withColumn("parent_id", F.format_string("doc-%d-p%06d-%02d", "doc_id", "parent_no", "part_no"))
    rows = rows.withColumn("child_id", F.format_string("%s-c%04d", "parent_id", "child_no"))
    made = C.assembled(rows)
    text = F.coalesce("text", F.lit(""))
    public = ~N.has_private_path(text) & ~N.has_secret_marker(text)
    return made.select(
        "doc_id", F.col("child_id").alias("chunk_id"), "parent_id", "source", "n_blocks", "text_length", "quality_flags", public.alias("public_allowed"), "text", "text_hash", "lang"
    )


def _known(spark: SparkSession, output: str) -> DataFrame:
    """doc_id, version, batch of the versions in the output."""
    return spark.read.schema(VERSIONS).parquet(f"{output}/versions")


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(batch: DataFrame, number: int, output: str, cfg: RefreshConfig) -> None:
    """Write the chunks and the versions of a micro-batch, as partitions of its number."""
    spark = batch.sparkSession
    known = _known(spark, output).filter(F.col("batch") != number).groupBy("doc_id").agg(F.max_by("version", "batch").alias("version"))
    # Read by several steps below; without a table each would read the batch's texts anew.
    changed = written(versions_of(batch).join(known, ["doc_id", "version"], "left_anti"), "refresh")
    _write(cut(changed, cfg.policy).withColumn("batch", F.lit(number).cast("long")), f"{output}/chunks", "batch", "lang")
    made = spark.read.schema(CHUNKS).parquet(f"{output}/chunks").filter(F.col("batch") == number)
    counts = made.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    taken = changed.select("doc_id", "version").join(counts, "doc_id", "left").fillna(0, ["n_chunks"])
    _write(taken.withColumn("batch", F.lit(number).cast("long")), f"{output}/versions", "batch")
    new = _known(spark, output).filter(F.col("batch") == number).agg(F.count("*"), F.sum("n_chunks")).first()
    log.info("batch %d: read %d rows, wrote %d new or changed documents and %d chunks", number, batch.count(), new[0], new[1] or 0)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of each document's last version."""
    last = _known(spark, output).groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.schema(CHUNKS).parquet(f"{output}/chunks").join(last, ["doc_id", "batch"], "left_semi").drop("batch")


def refresh(spark: SparkSession, documents: str, output: str, checkpoint: str, cfg: RefreshConfig | None = None) -> DataFrame:
    """Take what is new in documents (a folder or pattern of Parquet files: doc_id, text, lang, source) and return current(). Waits
    for the stream's end.
    """
    cfg = cfg or RefreshConfig()
    for name, schema, by in (("versions", VERSIONS, ["batch"]), ("chunks", CHUNKS, ["batch", "lang"])):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).parquet(f"{output}/{name}")
    files = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", cfg.max_files).parquet(documents)
    stream = files.select("doc_id", "text", "lang", "source").writeStream.foreachBatch(lambda batch, number: take(batch, number, output, cfg))
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = current(spark, output)
    log.info("took %d micro-batches from %s; %s holds %d current chunks", sum(p.numInputRows > 0 for p in query.recentProgress), documents, output, found.count())
    return found


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "output", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", default=os.path.join(ROOT, "jobs", "chunk_refresh.json"))
    told = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    spark = SparkSession.builder.appName("chunk_refresh").getOrCreate()
    try:
        refresh(spark, told.documents, told.output, told.checkpoint, RefreshConfig.read(told.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
