"""Streaming forms: a report that grows as files finish, and a watchdog for stalled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def drained(stream: DataFrame, name: str, mode: str = "append", handle=None) -> DataFrame:
    """Run a stream over all that is there, exactly once, into Parquet, and read it back.

    ``handle`` (batch, path) writes a micro-batch where the plain sink can't.
    """
    spark = stream.sparkSession
    home = shared_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
    if handle is None:
        run = writer.format("parquet").start(f"{home}/rows")
        run.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{home}/rows")

    def each(batch: DataFrame, number: int) -> None:
        handle(batch, f"{home}/rows/batch={number}")

    writer.foreachBatch(each).start().awaitTermination()
    return spark.read.parquet(f"{home}/rows").drop("batch")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def live_report(finished: DataFrame) -> DataFrame:
    """Rows of finished files as they come: (seq, file, action, error), read back from the CSV report that grows by a part a batch.

    A batch that is done again replaces its own part, so no row comes twice.
    """
    home = shared_folder(finished.sparkSession, "live-report")

    def grow(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").csv(f"{home}/report/batch={number}", header=True, escape='"', emptyValue="")

    finished.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(grow).start().awaitTermination()
    return finished.sparkSession.read.schema(finished.schema).csv(f"{home}/report", header=True, escape='"', recursiveFileLookup=True).na.fill("")


def stalled(progress: DataFrame, limit: str = "1 hour") -> DataFrame:
    """Files whose progress (file, ts, value) stood still: sessions of reports that came within ``limit``.

    A file that reports again after a longer gap opens a new session, so every
    session but a file's last ended in a stall.
    """
    return progress.groupBy("file", F.session_window("ts", limit).alias("w")).agg(F.count("*").alias("reports"), F.max("value").alias("furthest")).select(
        "file", F.col("w.start").alias("began"), F.col("w.end").alias("stalled_at"), "reports", "furthest")


def watched(stream: DataFrame, limit: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """The stalls that a stream shows: stalled() in append mode, a session once the watermark has passed its end.

    Sessions that are open when the stream is drained are no stalls yet.
    """
    return drained(stalled(stream.withWatermark("ts", late), limit), "watchdog")
