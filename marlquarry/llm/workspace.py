"""Lineage cuts: tables written to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs in one process (tests), a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="marlquarry-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Parquet tables of one operator run below spark.checkpoint.dir.

    A table survives the loss of executors, is read with its columns pruned, and ends the lineage
    of what is built on it. drop() deletes a table that nothing lazy reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.files: int | None = None

    def expect(self, rows: int, per_file: int = 10_000) -> None:
        """From now on a table has at most a file for each per_file of so many rows, but one for each core at least."""
        self.files = max(self.spark.sparkContext.defaultParallelism, rows // per_file)

    def table(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        path = f"{self.path}/{name}"
        files = files or self.files
        (df.coalesce(files) if files else df).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose large partitions adaptive execution can split, also where one side comes grouped by the key.

    The further key column is not what the grouping is dealt by, so both sides are dealt anew for the join.
    """
    half = F.pmod(F.xxhash64(on[0]), F.lit(2))
    return left.withColumn("_half", half).join(right.withColumn("_half", half), [*on, "_half"], how).drop("_half")


def with_temp_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for files that are no tables."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
