"""Listings over path keys: trees, children, kinds, pages, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree(entries: DataFrame, subtree: str = "", depth: int | None = None) -> DataFrame:
    """(path, is_dir, size) below a subtree, re-rooted, down to a depth. `sub` holds `sub/x` but not `subway`."""
    path = F.regexp_replace("key", "/$", "")
    rel = F.expr(f"substring(path, {len(subtree) + 2})") if subtree else F.col("path")
    rows = entries.withColumn("path", path).withColumn("is_dir", F.col("key").endswith("/"))
    if subtree:
        rows = rows.where(F.startswith(F.col("path"), F.lit(f"{subtree}/")))
    rows = rows.select(rel.alias("path"), "is_dir", "size").where("path <> ''")
    return rows if depth is None else rows.where(F.size(F.split("path", "/")) <= depth)


def children(entries: DataFrame, directory: str = "") -> DataFrame:
    """Distinct next segments below a directory: directories where more follows, files where a live entry ends.

    A directory that holds nothing but tombstones is still listed.
    """
    prefix = f"{directory}/" if directory else ""
    rest = F.expr(f"substring(key, {len(prefix) + 1})")
    rows = entries.where(F.startswith(F.col("key"), F.lit(prefix))).withColumn("rest", rest).where("rest <> ''")
    rows = rows.select(F.split_part("rest", F.lit("/"), F.lit(1)).alias("name"), F.contains("rest", F.lit("/")).alias("is_dir"), "is_tombstone")
    return rows.where("is_dir or not is_tombstone").groupBy("name", "is_dir").agg(F.count("*").cast("long").alias("entries"))


def resolve(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """Kind of each asked path: file, tombstone, directory (something lies below it) or missing.

    The prefixes of all keys meet the paths in one equi-join, so no pair is compared by prefix.
    """
    exact = entries.select(F.col("key").alias("path"), F.lit(True).alias("exact"), "is_tombstone")
    parts = F.split("key", "/")
    above = entries.select(F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))).alias("path"))
    above = above.join(paths, "path", "left_semi").distinct().withColumn("above", F.lit(True))
    kind = F.when(F.col("exact") & ~F.col("is_tombstone"), "file").when(F.col("above"), "directory").when(F.col("exact"), "tombstone").otherwise("missing")
    return paths.join(exact, "path", "left").join(above, "path", "left").select("path", kind.alias("kind"))


def keyset_page(names: DataFrame, after: tuple[str, str] | None, limit: int) -> DataFrame:
    """A page of (name, kind) in order of name, a directory before a file of the same name, after a cursor."""
    order = F.when(F.col("kind") == "dir", 0).otherwise(1)
    rows = names.withColumn("place", order)
    if after is not None:
        name, kind = after
        rows = rows.where((F.col("name") > name) | ((F.col("name") == name) & (F.col("place") > (0 if kind == "dir" else 1))))
    return rows.orderBy("name", "place").limit(limit).select("name", "kind")


def key_range(entries: DataFrame, low: str, high: str) -> DataFrame:
    """Keys from low up to but without high; the bounds reach the scan."""
    return entries.where((F.col("key") >= low) & (F.col("key") < high))


def prefix_promotion(entries: DataFrame, more_than: int = 10) -> DataFrame:
    """Prefixes with more files than that become directories of their own."""
    rows = entries.where(F.contains("key", F.lit("/"))).groupBy(F.regexp_extract("key", "^(.*)/[^/]*$", 1).alias("prefix"))
    return rows.agg(F.count("*").cast("long").alias("files")).where(F.col("files") > more_than)
