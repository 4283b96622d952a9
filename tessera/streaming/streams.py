"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.staging import shared_folder


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream, with its times as instants. The path is given as a pattern: only so may it be a single file too."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def handed(stream: DataFrame, hook, mode: str = "append") -> None:
    """Run the stream over what is there and hand each micro-batch with its number to a hook; a batch may come again after a failure."""
    root = shared_folder(stream.sparkSession)
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(hook).start().awaitTermination()


def finished(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run the stream over what is there and return its table.

    Each micro-batch is written by the executors to the shared folder: in complete mode it replaces the table, else it is
    added under its own number, so a batch that is run again writes the same files. In update mode a batch has only what has changed, state that the
    watermark has passed is forgotten, and the table is the last row of each of the keys.
    """
    spark, root = stream.sparkSession, shared_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table/batch={0 if mode == 'complete' else number}")

    handed(stream, write, mode)
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{root}/table/batch=*")
    rows = spark.read.option("basePath", f"{root}/table").parquet(f"{root}/table/batch=*")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*(F.col(c) if c in keys else F.col(f"r.{c}") for c in stream.columns))


def latest(messages: DataFrame) -> DataFrame:
    """Latest value of each key as a stream: the greatest revision, then the smaller hash."""
    order = F.struct((-F.col("revision")).alias("r"), "hash")
    return messages.groupBy("stream_key").agg(F.max("revision").alias("revision"), F.min_by("hash", order).alias("hash"))


def tumbled(events: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Distinct paths of each source in windows of a few seconds: what a watcher flushes at once."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "source")
    return rows.agg(F.count("*").cast("long").alias("events"), F.size(F.collect_set("path")).cast("long").alias("paths")).select("source", F.unix_timestamp("w.start").alias("start_s"), "events", "paths")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Bursts of writes that are flushed after an idle gap."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "source")
    return rows.agg(F.count("*").cast("long").alias("events")).select("source", F.unix_timestamp("w.start").alias("start_s"), "events")


def first_seen(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
