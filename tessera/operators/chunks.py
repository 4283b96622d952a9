"""Chunked blobs: fixed-size cutting, reuse of earlier chunks, reassembly, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(files: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(key, chunk_index, offset, length, hash, data): chunks of `size` characters, the last one shorter."""
    n = F.ceil(F.length(text) / size).cast("int")
    index = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    rows = files.select("key", text, index.alias("k"))
    data = F.substring(F.col(text), F.col("k") * size + 1, F.lit(size))
    return rows.select("key", F.col("k").cast("long").alias("chunk_index"), (F.col("k") * size).cast("long").alias("offset"), F.length(data).cast("long").alias("length"), F.sha2(data, 256).alias("hash"), data.alias("data"))


def positional_reuse(chunks: DataFrame, previous: DataFrame) -> DataFrame:
    """Each chunk, and whether the previous version has the same one at the same place."""
    before = previous.select("key", "chunk_index", F.col("hash").alias("old_hash"))
    return chunks.join(before, ["key", "chunk_index"], "left").withColumn("reused", F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False))).drop("old_hash")


def full_prefix(previous: DataFrame, size: int) -> DataFrame:
    """(key, chunks, bytes): the leading chunks of full size, which an append-only import takes over unread."""
    so_far = Window.partitionBy("key").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    full = previous.withColumn("full", F.min(F.when(F.col("length") == size, 1).otherwise(0)).over(so_far))
    return full.groupBy("key").agg(F.sum("full").cast("long").alias("chunks"), F.sum(F.col("full") * F.col("length")).cast("long").alias("bytes"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """(key, hash, size): each file from its chunks in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "data"))), lambda c: c["data"]), "")
    return chunks.groupBy("key").agg(text.alias("text")).select("key", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("size"))


def verify(files: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(key, ok): whether the rebuilt content has the recorded hash."""
    return files.select("key", "hash").join(rebuilt.select("key", F.col("hash").alias("found")), "key", "left").select("key", F.coalesce(F.col("hash") == F.col("found"), F.lit(False)).alias("ok"))


def dedup_stats(blobs: DataFrame) -> DataFrame:
    """One row: blobs and bytes as referred to, and as stored once for each hash."""
    each = blobs.groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return each.agg(F.sum("n").cast("long").alias("blobs"), F.count("*").cast("long").alias("stored"), F.sum(F.col("n") * F.col("size")).cast("long").alias("bytes"), F.sum("size").cast("long").alias("stored_bytes"))


def imports(new: DataFrame, existing: DataFrame) -> DataFrame:
    """One row a new hash that the store lacks: what an import writes."""
    return new.groupBy("hash").agg(F.max("size").cast("long").alias("size")).join(existing, "hash", "left_anti")


def node_writes(nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: nodes and bytes uploaded, and those found stored already."""
    known = existing.select("hash").distinct().withColumn("known", F.lit(True))
    rows = nodes.select("hash", "size").distinct().join(known, "hash", "left")
    old = F.coalesce("known", F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).cast("long")
    return rows.agg(F.count_if(~old).cast("long").alias("uploaded"), total(~old).alias("bytes_uploaded"), F.count_if(old).cast("long").alias("deduped"), total(old).alias("bytes_deduped"))
