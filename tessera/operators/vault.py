"""Directories with version chains, tree links, restore plans, staging and automation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def apply_ops(ops: DataFrame) -> DataFrame:
    """State of each path after its operations in order of seq: the last put, or a tombstone; versions counts all of them.

    A delete keeps the chain: first_version is the first put.
    """
    puts = F.col("op") == "put"
    last = F.max_by(F.struct("op", "hash"), "seq")
    state = ops.groupBy("path").agg(last.alias("e"), F.count("*").cast("long").alias("versions"), F.min_by("hash", F.when(puts, F.col("seq"))).alias("first_version"), F.max_by("hash", F.when(puts, F.col("seq"))).alias("previous"))
    dead = F.col("e.op") == "delete"
    return state.select("path", F.when(~dead, F.col("e.hash")).alias("hash"), dead.alias("is_tombstone"), "versions", "first_version", F.when(dead, F.col("previous")).alias("deleted_hash"))


def leaf_links(entries: DataFrame, leaf: str = "leaf_id") -> DataFrame:
    """One link a leaf: its first key, its entries and the sum of their sizes."""
    return entries.groupBy(leaf).agg(F.min("key").alias("first_key"), F.count("*").cast("long").alias("entries"), F.sum("size").cast("long").alias("size"))


def level_up(links: DataFrame, fanout: int) -> DataFrame:
    """Links of the next level: `fanout` neighbouring leaf ids a node."""
    node = F.floor(F.col("leaf_id") / fanout).cast("long")
    return links.groupBy(node.alias("leaf_id")).agg(F.min("first_key").alias("first_key"), F.sum("entries").cast("long").alias("entries"), F.sum("size").cast("long").alias("size"))


def build_tree(entries: DataFrame, fanout: int, leaves: int) -> DataFrame:
    """Links of all levels up to the root, with their level; the number of levels follows from the number of leaves."""
    level, now, width = 0, leaf_links(entries), leaves
    out = now.withColumn("level", F.lit(0).cast("long"))
    while width > 1:
        level, width = level + 1, -(-width // fanout)
        now = level_up(now, fanout)
        out = out.unionByName(now.withColumn("level", F.lit(level).cast("long")))
    return out


#: Hexadecimal digits of a key's digest that a level of a hash tree consumes: 256 children a node.
DIGITS, CHILDREN = 2, 256


def root_hashes(entries: DataFrame, tree: str) -> DataFrame:
    """Hash of each tree, rolled up from leaves that hold the keys of one range of digests.

    The largest tree sets the number of levels, so that a leaf has about CHILDREN entries and a node that many children at most: no tree is
    gathered in one row. Trees are equal exactly if their entries are, as long as both are hashed in one call or have as many levels.
    """
    most = entries.groupBy(tree).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = 1
    while CHILDREN ** (levels + 1) < most:
        levels += 1
    now = entries.select(F.col(tree).alias("tree"), F.substring(F.sha2("key", 256), 1, DIGITS * levels).alias("place"), "key", "hash")
    for level in range(levels, -1, -1):
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "hash"))), lambda e: F.concat(e["key"], F.lit("="), e["hash"])), "\n")
        now = now.groupBy("tree", "place").agg(F.sha2(lines, 256).alias("hash"))
        if level:
            now = now.select("tree", F.expr(f"substring(place, 1, {DIGITS * (level - 1)})").alias("place"), F.col("place").alias("key"), "hash")
    return now.select(F.col("tree").alias(tree), F.col("hash").alias("root"))


def restore_plan(entries: DataFrame) -> DataFrame:
    """Steps in order: directories by depth, then files; special files are skipped."""
    depth = F.size(F.split(F.regexp_replace("key", "/$", ""), "/"))
    action = F.when(F.col("kind") == "dir", "mkdir").when(F.col("kind") == "file", "write").otherwise("skip")
    phase = F.when(action == "mkdir", 0).when(action == "write", 1).otherwise(2)
    return entries.select("key", action.alias("action"), phase.cast("long").alias("phase"), F.when(action == "mkdir", depth).otherwise(0).cast("long").alias("depth"))


def vanished(links: DataFrame, present: DataFrame) -> DataFrame:
    """Links to files that are no longer there."""
    return links.join(present.select("path"), "path", "left_anti")


def reconcile_staging(staged: DataFrame, indexed: DataFrame) -> DataFrame:
    """What a restart does with each staged blob: enqueue it again, or delete it because a pack holds it."""
    known = indexed.select("key").distinct().withColumn("known", F.lit(True))
    return staged.join(known, "key", "left").select("key", F.when(F.col("known"), "delete").otherwise("enqueue").alias("action"))


def blinded_match(asked: DataFrame, hashes: DataFrame, salt: str) -> DataFrame:
    """Blobs whose salted digest is asked for: an equi-join on the digest in place of a scan for each question."""
    return hashes.select("hash", F.sha2(F.concat(F.lit(salt), F.col("hash")), 256).alias("blinded")).join(asked, "blinded")


def ready_groups(groups: DataFrame, least: int, now: int, patience: int, force: bool = False) -> DataFrame:
    """Open packs that are flushed: large enough, or waiting too long, or all of them."""
    reason = F.when(F.col("size") >= least, "full").when(F.lit(now) - F.col("oldest") >= patience, "stale").when(F.lit(force), "forced")
    return groups.withColumn("reason", reason).where("reason is not null")


def reconcile_loops(wanted: DataFrame, running: DataFrame) -> DataFrame:
    """What to start, stop or start anew so that the running automations are the wanted ones."""
    a, b = wanted.select("name", F.struct("trigger").alias("w")), running.select("name", F.struct("trigger").alias("r"))
    action = F.when(F.col("r").isNull(), "start").when(F.col("w").isNull(), "stop").when(F.col("w") != F.col("r"), "restart")
    return a.join(b, "name", "full_outer").select("name", action.alias("action")).where("action is not null")


def active_automations(configured: DataFrame, legacy: DataFrame) -> DataFrame:
    """Automations that run by themselves, and one for each legacy source that none of them covers."""
    live = configured.where("trigger <> 'manual' and not paused").select("source", "trigger")
    made = legacy.join(configured.select("source"), "source", "left_anti").select("source", F.lit("watch").alias("trigger"))
    return live.unionByName(made)


def merged_context(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Keys of both contexts, the child's where both have one; single fields fall back to the parent's."""
    p = parent.select("node", F.col("keys").alias("p_keys"), F.col("pipeline").alias("p_pipeline"))
    none = F.create_map().cast("map<string,string>")
    up = F.map_filter(F.coalesce("p_keys", none), lambda k, v: ~F.map_contains_key(F.coalesce(F.col("keys"), none), k))
    return child.join(p, "node", "left").select("node", F.map_concat(up, F.coalesce("keys", none)).alias("keys"), F.coalesce("pipeline", "p_pipeline").alias("pipeline"))


def compact(bulk: DataFrame, recent: DataFrame) -> DataFrame:
    """Pack index after a rebuild: one row a key, that of the smallest pack."""
    return bulk.unionByName(recent).groupBy("key").agg(F.min("pack").alias("pack"))


def late_packs(waiting: DataFrame, headers: DataFrame) -> DataFrame:
    """Registered packs once their headers can be read: enriched, dropped because they are none, or kept for another try."""
    outcome = F.when(F.col("state").isNull(), "retry").when(F.col("state") == "pack", "indexed").otherwise("dropped")
    return waiting.join(headers, "hash", "left").select("hash", outcome.alias("outcome"), F.when(outcome == "indexed", F.col("members")).alias("members"))


def registry_access(requests: DataFrame, members: DataFrame) -> DataFrame:
    """Whether a peer may read or write a stream key: own keys always, vault keys as a member, pins by anyone to read."""
    known = members.select("vault", "peer").distinct().withColumn("member", F.lit(True))
    inside = F.coalesce("member", F.lit(False))
    read = F.when(F.col("kind") == "local", F.col("peer") == F.col("owner")).when(F.col("kind") == "vault", inside).otherwise(True)
    write = F.when(F.col("kind") == "pin", False).otherwise(read)
    return requests.join(known, ["vault", "peer"], "left").select("request", read.alias("may_read"), write.alias("may_write"))


def names_to_identities(asked: DataFrame, friends: DataFrame, own: str) -> DataFrame:
    """Identity of each name; self is one's own."""
    return asked.join(friends, "name", "left").select("name", F.when(F.col("name") == "self", own).otherwise(F.col("did")).alias("did"))


def newest_first(snapshots: DataFrame) -> DataFrame:
    """Names in descending order, so that the current one comes before the times."""
    return snapshots.withColumn("place", F.row_number().over(Window.partitionBy("vault").orderBy(F.desc("ts"))).cast("long"))
