"""Layered snapshots: priority merges with tombstones, last-writer-wins merges, convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import staged


def _sides(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Full outer join on key; presence is told by the flags in_base and in_change, since a live entry may be all null."""
    left = base.select("key", F.struct("hash", "size").alias("b")).withColumn("in_base", F.lit(True))
    right = changes.select("key", F.struct("hash", "size").alias("c"), "is_tombstone").withColumn("in_change", F.lit(True))
    return left.join(right, "key", "full_outer")


def overlay_scan(base: DataFrame, changes: DataFrame) -> DataFrame:
    """All keys of two layers, the change layer first; tombstones stay visible."""
    wins = F.col("in_change").isNotNull()
    entry = F.when(wins, F.col("c")).otherwise(F.col("b"))
    return _sides(base, changes).select("key", entry["hash"].alias("hash"), entry["size"].alias("size"), (wins & F.col("is_tombstone")).alias("is_tombstone"))


def merge(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The written snapshot: the overlay without the change layer's tombstones."""
    return overlay_scan(base, changes).where(~F.col("is_tombstone")).drop("is_tombstone")


def merge_stats(base: DataFrame, changes: DataFrame) -> DataFrame:
    """One row of counts. A replaced entry counts as changed even if it is the same; deletes of absent keys count too."""
    count = lambda c: F.count_if(c).cast("long")
    changed = F.col("in_change").isNotNull()
    live = changed & ~F.col("is_tombstone")
    return _sides(base, changes).agg(
        count(live | ~changed).alias("entries"),
        count(~changed).alias("reused"),
        count(live).alias("changed"),
        count(changed & F.col("is_tombstone")).alias("tombstones_filtered"),
        F.sum(F.when(live, F.col("c.size")).when(~changed, F.col("b.size"))).cast("long").alias("bytes"),
    )


def stacked(layers: list[DataFrame]) -> DataFrame:
    """Layers in one table with their priority; 0 is the highest."""
    out = layers[0].withColumn("priority", F.lit(0).cast("long"))
    for k, layer in enumerate(layers[1:], 1):
        out = out.unionByName(layer.withColumn("priority", F.lit(k).cast("long")))
    return out


def merged_view(layers: list[DataFrame]) -> DataFrame:
    """The entry of the highest layer that has the key, tombstones included: one aggregate over the union."""
    entry = F.struct("hash", "size", "is_tombstone", "priority")
    return stacked(layers).groupBy("key").agg(F.min_by(entry, "priority").alias("e")).select("key", "e.*")


def get_live(layers: list[DataFrame], keys: DataFrame) -> DataFrame:
    """Point reads: the winner is found first, then tombstones hide it. Each layer is reduced to the asked keys before the merge."""
    asked = [layer.join(keys, "key", "left_semi") for layer in layers]
    return merged_view(asked).where(~F.col("is_tombstone")).drop("is_tombstone")


def union_local_wins(local: DataFrame, published: DataFrame) -> DataFrame:
    """Convergence: all keys of both snapshots, the local entry where both have one. A key deleted locally comes back."""
    left = local.select("key", F.struct("hash", "size").alias("l")).withColumn("in_local", F.lit(True))
    right = published.select("key", F.struct("hash", "size").alias("p"))
    entry = F.when(F.col("in_local").isNotNull(), F.col("l")).otherwise(F.col("p"))
    return left.join(right, "key", "full_outer").select("key", entry["hash"].alias("hash"), entry["size"].alias("size"), F.when(F.col("in_local").isNotNull(), "local").otherwise("published").alias("side"))


def stamp(seconds: Column, nanos: Column) -> Column:
    """Clock of an entry in nanoseconds; a missing one counts as zero."""
    return F.coalesce(seconds, F.lit(0)).cast("long") * 1_000_000_000 + F.coalesce(nanos, F.lit(0)).cast("long")


def lww_merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Per name the newer side; ties stay local."""
    left = local.select("name", F.col("hash").alias("l_hash"), stamp(F.col("ts_s"), F.col("ts_ns")).alias("l_ts"), F.lit(True).alias("in_local"))
    right = remote.select("name", F.col("hash").alias("r_hash"), stamp(F.col("ts_s"), F.col("ts_ns")).alias("r_ts"), F.lit(True).alias("in_remote"))
    newer = F.col("in_local").isNull() | (F.col("in_remote").isNotNull() & (F.col("r_ts") > F.col("l_ts")))
    pick = lambda name: F.when(newer, F.col(f"r_{name}")).otherwise(F.col(f"l_{name}"))
    return left.join(right, "name", "full_outer").select("name", pick("hash").alias("hash"), pick("ts").alias("ts"), F.when(newer, "remote").otherwise("local").alias("side"))


def lww_kinds(local: DataFrame, remote: DataFrame) -> DataFrame:
    """As lww_merge where a name is a directory or a file: the remote directories are folded in first, then its files.

    A newer entry of the other kind evicts the one that is there.
    """
    here = local.select("name", F.struct("kind", "hash", stamp(F.col("ts_s"), F.col("ts_ns")).alias("ts")).alias("held"))
    for kind in ("dir", "file"):
        there = remote.where(F.col("kind") == kind).select("name", F.struct("kind", "hash", stamp(F.col("ts_s"), F.col("ts_ns")).alias("ts")).alias("new"))
        newer = F.col("held").isNull() | (F.col("new.ts") > F.col("held.ts"))
        here = here.join(there, "name", "full_outer").select("name", F.when(newer & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("held")).alias("held"))
    return here.select("name", "held.kind", "held.hash", "held.ts")


def leaf_diff(changed: DataFrame, base: DataFrame) -> DataFrame:
    """Entries of the leaves whose hash the base does not have: equal leaves are pruned whole."""
    return changed.join(base.select("leaf_hash").distinct(), "leaf_hash", "left_anti")


#: Entries that a leaf holds on average, and the fewest leaves.
LEAF, LEAST_LEAVES = 256, 64


def leaf_count(*sides: DataFrame) -> int:
    """Leaves for the larger of the sides: a power of two, so that a leaf has at most LEAF entries on average."""
    most, found = max(side.count() for side in sides), LEAST_LEAVES
    while found * LEAF < most:
        found *= 2
    return found


def leaves(entries: DataFrame, fanout: int) -> DataFrame:
    """Entries with the id and the hash of their leaf. A leaf holds the keys of one hash bucket, so sides with the same fanout cut alike."""
    bucket = F.conv(F.substring(F.sha2("key", 256), 1, 15), 16, 10).cast("long") % fanout
    rows = entries.withColumn("leaf_id", bucket)
    content = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "hash"))), lambda e: F.concat(e["key"], F.lit("="), e["hash"])), "\n"), 256)
    return rows.join(rows.groupBy("leaf_id").agg(content.alias("leaf_hash")), "leaf_id")


def floor_lookup(first_keys: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked key with the leaf that has the greatest first key not above it; null below the first leaf.

    first_keys is the index of a tree, (first_key, leaf_id). Both sides are dealt out by ranges of keys and sorted there; a range that starts with
    no leaf of its own takes over the last one before it, of which there is a row for each range.
    """
    marks = first_keys.select(F.col("first_key").alias("key"), "leaf_id", F.lit(0).alias("side"))
    kind = dict(first_keys.dtypes)["leaf_id"]
    both = marks.unionByName(asked.select("key", F.lit(None).cast(kind).alias("leaf_id"), F.lit(1).alias("side")))
    ranged = staged(both.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranges")
    within = F.last("leaf_id", ignorenulls=True).over(Window.partitionBy("part").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, 0))
    ends = ranged.groupBy("part").agg(F.max_by("leaf_id", F.when(F.col("side") == 0, F.col("key"))).alias("last_leaf"))
    before = F.last("last_leaf", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = F.broadcast(ends.select("part", before.alias("before")))
    return ranged.withColumn("own", within).join(carried, "part").where("side = 1").select("key", F.coalesce("own", "before").alias("leaf_id"))


def affected_leaves(first_keys: DataFrame, changes: DataFrame) -> DataFrame:
    """Leaves that changes fall into, with their number: for each changed key the leaf with the greatest first key not above it."""
    return floor_lookup(first_keys, changes).where("leaf_id is not null").groupBy("leaf_id").agg(F.count("*").alias("changes"))


def get_raw(layers: list[DataFrame], keys: DataFrame) -> DataFrame:
    """Point reads that show tombstones: the entry of the highest layer that has the key."""
    return merged_view([layer.join(keys, "key", "left_semi") for layer in layers])


def range_in_leaves(entries: DataFrame, first_keys: DataFrame, start: str, end: str) -> DataFrame:
    """Entries of [start, end): only leaves whose keys may lie in it are read.

    entries: (key, ..., leaf_id); first_keys: (first_key, last_key, leaf_id).
    """
    met = first_keys.where((F.col("first_key") < end) & (F.col("last_key") >= start)).select("leaf_id")
    return entries.join(met, "leaf_id", "left_semi").where((F.col("key") >= start) & (F.col("key") < end))


def tree_levels(entries: DataFrame, bits_zero: int = 1, most: int = 16) -> DataFrame:
    """(level, first_key, children, entries, size): a tree cut by content, one row a node, from the leaves to one root.

    A node of level n begins at the first key and at every key whose digest ends with (n + 1) * bits_zero hexadecimal zeros, so that
    a change moves only the borders next to it. Each level is one floor lookup over the level below.
    """
    digest = F.sha2("key", 256)
    below = staged(entries.select("key", F.lit(1).cast("long").alias("entries"), F.col("size").cast("long").alias("size")), "level")
    out, first = None, below.agg(F.min("key")).first()[0]
    for level in range(most):
        marks = below.where(F.endswith(digest, F.lit("0" * bits_zero * (level + 1))) | (F.col("key") == first)).select(F.col("key").alias("first_key"), F.col("key").alias("leaf_id"))
        found = floor_lookup(marks, below.select("key")).withColumnRenamed("leaf_id", "first_key")
        nodes = below.join(found, "key").groupBy("first_key").agg(F.count("*").alias("children"), F.sum("entries").alias("entries"), F.sum("size").alias("size"))
        nodes = staged(nodes.select(F.lit(level).cast("long").alias("level"), "first_key", "children", "entries", "size"), "level")
        out = nodes if out is None else out.unionByName(nodes)
        below = nodes.select(F.col("first_key").alias("key"), "entries", "size")
        if nodes.limit(2).count() < 2:
            break
    return out


def sharded_lww(local: DataFrame, remote: DataFrame, shards: int) -> DataFrame:
    """lww_merge within shards: both sides are dealt out by the digest of their names, so each shard is merged by itself."""
    shard = F.pmod(F.conv(F.substring(F.sha2("name", 256), 1, 4), 16, 10).cast("long"), F.lit(shards))
    place = F.pmod(F.conv(F.substring(F.sha2("name", 256), 1, 4), 16, 10).cast("long"), F.lit(shards)).alias("shard")
    return lww_merge(local.repartition(shard), remote.repartition(shard)).select(place, "name", "hash", "ts", "side")


def reroot(entries: DataFrame, source: str, target: str) -> DataFrame:
    """Entries below source under target instead; what is not below it is left out."""
    below = F.lit(f"{source}/") if source else F.lit("")
    inside = entries.where(F.startswith(F.col("key"), below))
    rest = F.expr(f"substring(key, {len(source) + 2 if source else 1})")
    return inside.withColumn("key", F.concat(F.lit(f"{target}/" if target else ""), rest)).where(F.col("key") != "")


def semantic_merge(previous: DataFrame, following: DataFrame, fields: list[str]) -> DataFrame:
    """Field by field, the previous value where the next has none."""
    p = previous.select("key", *(F.col(f).alias(f"p_{f}") for f in fields))
    return following.join(p, "key", "left").select("key", *(F.coalesce(f, f"p_{f}").alias(f) for f in fields))
