"""Reachability, pins and garbage collection."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import staged


#: Rounds whose tables are read side by side before they are written as one.
ROUNDS_APART = 16


def closure(roots: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Distinct nodes that the roots reach over edges (parent, child), the roots included.

    The frontier grows round by round: each joins the edges once and drops what was seen before. A round's new nodes are written to the shared
    folder (spark.checkpoint.dir), so the plan stays short and a lost executor costs one round; what was seen is their union, which is written anew
    only every ROUNDS_APART rounds. They end when the frontier is empty; a graph deeper than `rounds`, if given, is an error.
    """
    frontier = staged(roots.select("node").distinct(), "round")
    seen, parts = frontier, 1
    for _ in itertools.count() if rounds is None else range(rounds):
        step = frontier.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        frontier = staged(step.join(seen, "node", "left_anti"), "round")
        if frontier.isEmpty():
            return seen
        seen, parts = seen.unionByName(frontier), parts + 1
        if parts == ROUNDS_APART:
            seen, parts = staged(seen, "seen"), 1
    raise ValueError(f"the graph is deeper than {rounds} rounds")


def classify(blobs: DataFrame, pins: DataFrame, reachable: DataFrame, now: int, min_age: int) -> DataFrame:
    """(hash, size, class): pinned, else reachable, else protected by age (unknown and future times too), else candidate."""
    pinned = pins.select("hash").distinct().withColumn("pinned", F.lit(True))
    live = reachable.select("hash").distinct().withColumn("live", F.lit(True))
    old = F.coalesce((F.col("mtime") <= now) & (F.lit(now) - F.col("mtime") >= min_age), F.lit(False))
    kind = F.when(F.col("pinned"), "pinned").when(F.col("live"), "reachable").when(~old, "too_young").otherwise("candidate")
    return blobs.join(pinned, "hash", "left").join(live, "hash", "left").select("hash", "size", kind.alias("class"))


def report(classified: DataFrame) -> DataFrame:
    """One row of totals; bytes_candidate includes what age then protects."""
    count = lambda k: F.count_if(F.col("class") == k).cast("long")
    return classified.agg(
        F.count("*").cast("long").alias("total"),
        count("pinned").alias("kept_by_pins"),
        count("reachable").alias("kept_by_reachability"),
        count("too_young").alias("aged_out_protected"),
        count("candidate").alias("candidates"),
        F.coalesce(F.sum(F.when(F.col("class").isin("too_young", "candidate"), F.col("size"))), F.lit(0)).cast("long").alias("bytes_candidate"),
        F.coalesce(F.sum(F.when(F.col("class") == "candidate", F.col("size"))), F.lit(0)).cast("long").alias("bytes_reclaimed"),
    )


def sweep(blobs: DataFrame, pins: DataFrame, reachable: DataFrame, now: int, min_age: int) -> DataFrame:
    """The blobs that remain. Nothing is swept while nothing is known to be reachable."""
    if reachable.isEmpty():
        raise ValueError("reachability is unknown or empty: nothing is swept")
    gone = classify(blobs, pins, reachable, now, min_age).where("class = 'candidate'")
    return blobs.join(gone, "hash", "left_anti")


def missing(reachable: DataFrame, stored: DataFrame) -> DataFrame:
    """Hashes that are referred to but not stored."""
    return reachable.select("hash").distinct().join(stored, "hash", "left_anti")


def retained(stored: DataFrame, reachable: DataFrame) -> DataFrame:
    return stored.join(reachable, "hash", "left_semi")


def pin_state(log: DataFrame) -> DataFrame:
    """(hash, contexts, revision) from a log of pin events: a context pins a hash if its last event adds it."""
    last = log.groupBy("hash", "context").agg(F.max_by("op", "seq").alias("op"), F.count("*").alias("events"))
    return last.groupBy("hash").agg(F.array_sort(F.collect_set(F.when(F.col("op") == "add", F.col("context")))).alias("contexts"), F.sum("events").cast("long").alias("revision"))


def orphaned(log: DataFrame) -> DataFrame:
    """Hashes whose last context has gone."""
    return pin_state(log).where(F.size("contexts") == 0).select("hash", "revision")
