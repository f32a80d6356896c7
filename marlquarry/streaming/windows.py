"""Time windows over events, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts and sums of value by window and event_type."""
    made = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, width: str = "1 day", step: str = "6 hours") -> DataFrame:
    made = events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return made.select(F.col("w.start").alias("window_start"), "n", "users")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of a user's events that lie less than gap apart."""
    made = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("session_end"))
    return made.select("user_id", F.col("w.start").alias("session_start"), "session_end", "n")


def as_of(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left (key, ts, ..) with the value of right (key, ts, value) at or before its time: one sort of both by key and time."""
    from pyspark.sql import Window

    own = left.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    other = right.select(key, "ts", value).withColumn("_side", F.lit(0))
    both = own.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(F.when(F.col("_side") == 0, F.col(value)), ignorenulls=True).over(w)).filter("_side = 1").drop("_side")


def stream_tumbling(spark: SparkSession, path: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The same counts of a stream of Parquet files with a watermark; append mode gives closed windows."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    made = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("window_start"), "event_type", "n")


def stream_sessions(spark: SparkSession, events: str, ticks: str, output: str, checkpoint: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Run the sessions of a stream of Parquet files as far as they have come, and return what is closed: user_id, session_start, session_end, n.

    events and ticks: folders or patterns of files with user_id and ts. A session is closed, and written once, when the watermark, `late` behind the
    greatest time seen, has passed its end by gap; until then it is state, kept with the checkpoint, and the next run goes on with it. Rows
    that come later than the watermark are dropped. Rows of ticks count as no events but move the watermark, see close_sessions().
    """
    spark.createDataFrame([], "user_id long, ts timestamp").write.mode("ignore").parquet(ticks)

    def side(path: str, tick: bool) -> DataFrame:
        rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        return rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(tick).alias("tick"))

    rows = side(events, False).unionByName(side(ticks, True)).withWatermark("ts", late)
    # Ticks go by what was counted: a filter on a key would be pushed below the watermark, which then would not see them.
    made = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count_if(~F.col("tick")).alias("n"), F.max("ts").alias("session_end"))
    made = made.filter("n > 0").select("user_id", F.col("w.start").alias("session_start"), "session_end", "n")
    query = made.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(output)


def close_sessions(spark: SparkSession, events: str, ticks: str, gap: str = "6 hours", late: str = "1 hour") -> None:
    """Write a tick so late that the next run of stream_sessions() closes all sessions of the events that are there now."""
    after = F.max(F.col("ts").cast("timestamp")) + F.expr(f"interval {gap}") + F.expr(f"interval {late}") + F.expr("interval 1 day")
    spark.read.parquet(events).agg(F.lit(None).cast("long").alias("user_id"), after.alias("ts")).filter("ts is not null").write.mode("append").parquet(ticks)
