"""Published snapshots: chronological numbers, retention, selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(snapshots: DataFrame, vault: str = "vault") -> DataFrame:
    """Each vault's snapshots numbered from 1 in order of time; the current one is the last."""
    order = Window.partitionBy(vault).orderBy("ts", "hash")
    return snapshots.withColumn("revision", F.row_number().over(order).cast("long"))


def keep_last(snapshots: DataFrame, n: int, vault: str = "vault") -> DataFrame:
    """Retention: the newest n of each vault; the unnamed entry never counts and always stays."""
    newest = Window.partitionBy(vault).orderBy(F.desc("ts"), F.desc("hash"))
    named = snapshots.where("ts <> ''").withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n).drop("place")
    return named.unionByName(snapshots.where("ts = ''"))


def select(candidates: DataFrame, selectors: DataFrame, vault: str = "vault") -> DataFrame:
    """What each selector names: a number in range, else an exact time, else the only hash with that prefix.

    A number out of range may still be a prefix. outcome is revision, timestamp, hash, ambiguous or missing.
    """
    rows = ranked(candidates, vault)
    total = rows.groupBy(vault).agg(F.count("*").alias("total"))
    asked = selectors.withColumn("s", F.trim("selector")).join(total, vault, "left")
    number = F.when(F.col("s").rlike("^[0-9]{1,9}$"), F.col("s").cast("long"))
    in_range = F.coalesce(number.between(1, F.col("total")), F.lit(False))
    met = asked.withColumn("number", number).withColumn("in_range", in_range).join(rows, vault, "left")
    by_number = F.col("in_range") & (F.col("revision") == F.col("number"))
    by_time = F.col("ts") == F.col("s")
    by_hash = F.startswith("hash", F.lower("s"))
    kind = F.when(by_number, 1).when(by_time, 2).when(by_hash, 3)
    best = met.withColumn("kind", kind).groupBy(vault, "selector").agg(
        F.min("kind").alias("kind"),
        F.min_by("hash", F.when(F.col("kind").isNotNull(), F.struct("kind", "revision"))).alias("found"),
        F.sum(F.when(F.col("kind") == 3, 1).otherwise(0)).alias("prefixes"),
    )
    outcome = (
        F.when(F.col("kind") == 1, "revision").when(F.col("kind") == 2, "timestamp").when((F.col("kind") == 3) & (F.col("prefixes") == 1), "hash").when(F.col("kind") == 3, "ambiguous").otherwise("missing")
    )
    single = F.when(outcome.isin("revision", "timestamp", "hash"), F.col("found"))
    return best.select(vault, "selector", outcome.alias("outcome"), single.alias("hash"))


def version_chain(versions: DataFrame, key: str = "key") -> DataFrame:
    """Hashes that a key's version chain keeps alive: all of its versions, but not a tombstone's own."""
    return versions.where("not is_tombstone").select(key, "hash").distinct()
