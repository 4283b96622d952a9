"""Object stores as tables: inventories, content-addressed writes, heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime) of every object below path; contents are not read. Temporary objects are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    rows = files.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return rows.where(~F.contains("path", F.lit("/.tmp/")))


def read_range(objects: DataFrame, offset: int, length: int | None = None, content: str = "content") -> DataFrame:
    """[offset, offset + length) of each object."""
    rest = F.octet_length(content) - offset
    return objects.withColumn(content, F.substring(content, F.lit(offset + 1), F.greatest(F.lit(0), rest if length is None else F.least(rest, F.lit(length)))))


def missing_blobs(new: DataFrame, store: DataFrame) -> DataFrame:
    """One row for each hash of new that the store lacks."""
    return new.dropDuplicates(["hash"]).join(store.select("hash"), "hash", "left_anti")


def put_blobs(new: DataFrame, path: str) -> DataFrame:
    """Append the blobs that the store at path lacks; the store as it is then."""
    spark = new.sparkSession
    try:
        store = spark.read.parquet(path)
    except Exception as error:  # a store that has not been written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        store = spark.createDataFrame([], new.schema)
    missing_blobs(new, store).select(*new.columns).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def publish(data: DataFrame, data_path: str, head: DataFrame, head_path: str) -> None:
    """Write the data, and only when that is done the head that refers to it."""
    data.write.mode("append").parquet(data_path)
    head.write.mode("append").parquet(head_path)


def tee(data: DataFrame, first: str, second: str) -> None:
    """The same rows to two stores."""
    kept = data.persist()
    try:
        kept.write.mode("append").parquet(first)
        kept.write.mode("append").parquet(second)
    finally:
        kept.unpersist()


def migration(objects: DataFrame, source: str, target: str) -> DataFrame:
    """(mode, objects, bytes): by reference where source and target share a substrate, else by copy."""
    mode = F.when(F.col("substrate") == F.lit(target), "reference").otherwise("copy")
    rows = objects.where(F.col("store") == source).groupBy(mode.alias("mode"))
    return rows.agg(F.count("*").cast("long").alias("objects"), F.sum("size").cast("long").alias("bytes"))
