"""Vault members, access rules, peers, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve(members: DataFrame, friends: DataFrame, heads: DataFrame, bundles: DataFrame) -> DataFrame:
    """Members with their identity: name to DID, DID to head, head to bundle; what does not resolve keeps its name."""
    return (
        members.join(friends, "name", "left")
        .join(heads, "did", "left")
        .join(bundles, "bundle_hash", "left")
        .select("vault", "name", F.coalesce("did", F.concat(F.lit("unresolved:"), F.col("name"))).alias("did"), F.col("key").isNotNull().alias("resolved"), "key")
    )


def recipients(resolved: DataFrame) -> DataFrame:
    """(vault, keys, members): the distinct keys of each vault, in order."""
    return resolved.groupBy("vault").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"), F.count("*").cast("long").alias("members"))


def allowed(requests: DataFrame, acl: DataFrame, vault_blobs: DataFrame, public: DataFrame) -> DataFrame:
    """Each request (principal, hash) and why it may be read: the blob is public, or it lies in a vault that lists the principal."""
    open_ = public.select("hash").distinct().withColumn("public", F.lit(True))
    reach = vault_blobs.join(acl, "vault").select("principal", "hash")
    granted = requests.select("principal", "hash").distinct().join(reach, ["principal", "hash"], "left_semi").withColumn("granted", F.lit(True))
    reason = F.when(F.col("public"), "public").when(F.col("granted"), "member").otherwise("denied")
    return requests.join(open_, "hash", "left").join(granted, ["principal", "hash"], "left").select("request", "principal", "hash", reason.alias("reason"))


def wider_readers(source: DataFrame, target: DataFrame, pairs: DataFrame) -> DataFrame:
    """Readers of a target vault who may not read the source: what a copy would open to them."""
    to = pairs.join(target.select(F.col("vault").alias("target"), "principal"), "target")
    may = source.select(F.col("vault").alias("source"), "principal")
    return to.join(may, ["source", "principal"], "left_anti").select("source", "target", "principal")


def peer_stats(connections: DataFrame) -> DataFrame:
    """Per peer and protocol: number, first and last time, last direction (ties by id)."""
    last = F.max_by("direction", F.struct("ts", "id"))
    return connections.groupBy("peer", "alpn").agg(F.count("*").cast("long").alias("connections"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), last.alias("last_direction"))


def quorum(writes: DataFrame, need: int) -> DataFrame:
    """Outcome of replicated writes under the three policies."""
    got = writes.groupBy("write").agg(F.count_if("ok").cast("long").alias("oks"), F.count("*").cast("long").alias("replicas"))
    return got.select("write", "oks", "replicas", (F.col("oks") == F.col("replicas")).alias("all"), (F.col("oks") >= 1).alias("any"), (F.col("oks") >= need).alias("quorum"))


def counter_delta(samples: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Growth of a cumulative counter since the sample before it."""
    return samples.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order)))


def health(stores: DataFrame, probes: DataFrame) -> DataFrame:
    """Each store known or probed, with the result of its probe."""
    known = stores.select("name").withColumn("configured", F.lit(True))
    return known.join(probes, "name", "full_outer").select("name", F.coalesce("configured", F.lit(False)).alias("configured"), F.coalesce("state", F.lit("unknown")).alias("state"))


def first_wins(bundles: DataFrame) -> DataFrame:
    """Reverse map from key to identity: the first declaration of a key stays."""
    return bundles.groupBy("key").agg(F.min_by("did", "place").alias("did"))
