"""Latest-value registry: which message of a key counts, under the read order and under the write rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def head_reconciled(log: DataFrame, key: str = "stream_key") -> DataFrame:
    """Read order over replicas: the greatest revision, then the smaller hash.

    One aggregate with map-side partial results: of the rows at the greatest revision the least (hash, seq) is taken, without sorting a key's rows.
    """
    top = log.groupBy(key).agg(F.max("revision").alias("revision"), F.min_by(F.struct("hash", "seq"), F.struct((-F.col("revision")).alias("r"), "hash", "seq")).alias("m"))
    return top.select(key, "revision", F.col("m.hash").alias("hash"), F.col("m.seq").alias("seq"))


def head_by_arrival(log: DataFrame, key: str = "stream_key") -> DataFrame:
    """Write rule folded in arrival order: the first arrival at the greatest revision stays."""
    top = log.groupBy(key).agg(F.max("revision").alias("revision"), F.min_by(F.struct("hash", "seq"), F.struct((-F.col("revision")).alias("r"), "seq")).alias("m"))
    return top.select(key, "revision", F.col("m.hash").alias("hash"), F.col("m.seq").alias("seq"))


def stream_log(log: DataFrame) -> DataFrame:
    """Messages of append streams: all of them stay."""
    return log.where(F.col("type") == "Stream")


def accepts(revision: Column, hash_: Column, held_revision: Column, held_hash: Column) -> Column:
    """Write admission: nothing is held, or the revision is greater, or it is the same message again."""
    return held_revision.isNull() | (revision > held_revision) | ((revision == held_revision) & (hash_ == held_hash))


def write_decisions(log: DataFrame, key: str = "stream_key") -> DataFrame:
    """Each message of a key in arrival order with the revision held before it and whether it is stored."""
    earlier = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # the holder of the greatest revision so far is its first arrival
    held = F.max_by(F.struct("revision", "hash"), F.struct("revision", (-F.col("seq")).alias("s"))).over(earlier)
    found = log.withColumn("held", held)
    accepted = accepts(F.col("revision"), F.col("hash"), F.col("held.revision"), F.col("held.hash"))
    return found.select(key, "seq", "revision", F.col("held.revision").alias("held_revision"), accepted.alias("accepted"))


def multi_registry_get(layers: list[DataFrame], key: str = "stream_key") -> DataFrame:
    """The first backend that holds a value for the key."""
    every = layers[0].withColumn("backend", F.lit(0).cast("long"))
    for k, layer in enumerate(layers[1:], 1):
        every = every.unionByName(layer.withColumn("backend", F.lit(k).cast("long")))
    return every.groupBy(key).agg(F.min_by(F.struct("backend", "revision", "hash"), "backend").alias("m")).select(key, "m.*")


def subscribe_replay(log: DataFrame, readers: DataFrame, key: str = "stream_key") -> DataFrame:
    """What a subscription replays first: the heads of the keys that each reader may read."""
    return readers.join(head_reconciled(log, key), key).select("reader", key, "revision", "hash")
