"""Connected components by alternating stars, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, stage


def _least(edges: DataFrame, rows: int) -> DataFrame:
    """Staged (u, m): the least of each node and its neighbours. The hub of a large group is summed before the shuffle."""
    return stage(edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m")), "least", rows)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for each node of the edges (u, v); a component is named by its least node. rows: at most so many edges, if known.

    Large and small stars alternate until the edges stay as they are: each node then points at its least one.
    A hub's edges are joined with one row for it, so that a skewed join can be split among tasks.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    mark = _mark(now)
    while rows := mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, 2 * rows)
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large", 2 * rows)
        least_small = _least(large, 2 * rows)
        small = large.join(least_small, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stage(small, "edges", 2 * rows)
        new = _mark(after)
        for old in (now, least, large, least_small):
            drop_staged(old)
        now, done, mark = after, new == mark, new
        if done:
            break
    pointing = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node")).distinct().join(pointing, "node", "left_anti").select("node", F.col("node").alias("component"))
    return stage(pointing.unionAll(roots), "components", 2 * mark[0])
