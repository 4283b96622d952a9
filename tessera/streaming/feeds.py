"""Change feeds of a registry, resumed reads, publishing rounds and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import registry
from tessera.sources.staging import shared_folder, staged

from . import streams

_HELD = "stream_key long, revision long, hash string, seq long"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry messages as a stream: (stream_key, revision, hash, seq)."""
    e = streams.stream_of(spark, f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("long").alias("stream_key"), F.floor("value").cast("long").alias("revision"), F.sha2("props", 256).alias("hash"), F.col("event_id").cast("long").alias("seq"))


def _changes(batch: DataFrame, held: DataFrame) -> DataFrame:
    """Messages of a batch that raise the revision of their key above what is held and what came before them, in order of seq."""
    from pyspark.sql import Window

    before = F.max("revision").over(Window.partitionBy("stream_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    old = held.groupBy("stream_key").agg(F.max("revision").alias("held"))
    rows = batch.withColumn("before", before).join(old, "stream_key", "left")
    return rows.where(F.col("revision") > F.coalesce(F.greatest("before", "held"), F.col("revision") - 1)).select("stream_key", "revision", "hash", "seq")


def _numbered(spark: SparkSession, path: str, number: int) -> DataFrame:
    """What the batches before this one have written: a batch that is run again does not see its own rows."""
    empty = spark.createDataFrame([], _HELD)
    if not number:
        return empty
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return rows.where(F.col("batch") < number).select(*empty.columns)


def broadcast(stream: DataFrame) -> DataFrame:
    """The events of a registry that takes the stream's messages: one for each message that changed what is held."""
    spark, path = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/changes"

    def take(batch: DataFrame, number: int) -> None:
        _changes(batch, _numbered(batch.sparkSession, path, number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    streams.handed(stream, take)
    return spark.read.schema(_HELD).parquet(f"{path}/batch=*")


def set_in(stream: DataFrame, registries: int) -> list[DataFrame]:
    """(stream_key, revision, hash) that each of several registries holds after the stream's messages were set in all of them."""
    spark, root = stream.sparkSession, shared_folder(stream.sparkSession)

    def take(batch: DataFrame, number: int) -> None:
        for k in range(registries):
            path = f"{root}/registry{k}"
            _changes(batch, _numbered(batch.sparkSession, path, number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    streams.handed(stream, take)
    every = (spark.read.schema(_HELD).parquet(f"{root}/registry{k}/batch=*") for k in range(registries))
    return [registry.head_by_arrival(d).select("stream_key", "revision", "hash") for d in every]


def in_two_runs(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows that arrive in two parts, read by two runs of one query with one checkpoint."""
    root = shared_folder(spark)
    parts = [rows.where(F.pmod(F.xxhash64(rows.columns[0]), F.lit(2)) == k) for k in range(2)]
    for part in parts:
        part.write.mode("append").parquet(f"{root}/feed")
        feed = spark.readStream.schema(rows.schema).parquet(f"{root}/feed")
        query = feed.writeStream.format("parquet").option("path", f"{root}/index").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{root}/index")


def publish_rounds(attempts: DataFrame, most: int) -> DataFrame:
    """(stream_key, seq, attempt): optimistic publishers of a key that start together. In each round the first of those left wins by compare
    and swap; the others find the head changed and try again, `most` times."""
    left, out = attempts, None
    for attempt in range(1, most + 1):
        won = staged(left.groupBy("stream_key").agg(F.min("seq").alias("seq")).withColumn("attempt", F.lit(attempt).cast("long")), "round")
        out = won if out is None else out.unionByName(won)
        left = staged(left.join(won, ["stream_key", "seq"], "left_anti"), "left")
        if left.isEmpty():
            break
    return out


def backoff(failures: Column, most: int) -> Column:
    """Seconds before the next restart: doubled after each failure, `most` at most."""
    return F.least(F.lit(most), F.pow(F.lit(2.0), F.least(failures, F.lit(32)))).cast("long")


def scheduled(tasks: DataFrame, gap: int, runs: int) -> DataFrame:
    """(task, run, start, done) of tasks that take `took` seconds and begin again `gap` seconds after they were done."""
    rows = tasks.select("task", "took", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).withColumn("run", F.col("run").cast("long"))
    start = F.col("run") * (F.col("took") + gap)
    return rows.select("task", "run", start.alias("start"), (start + F.col("took")).alias("done"))
