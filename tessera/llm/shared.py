"""Helpers that the operators share: table reads, staged tables, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a temporary folder is set for a session on a single machine; on a cluster that is an error, since
    each machine would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera/{uuid.uuid4().hex}"


#: Rows of a staged table's file, where their number is known before it is written.
ROWS_PER_FILE = 100_000


def stage(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows reads the files, also after executors are lost. The folder is named
    <spark.checkpoint.dir>/tessera/<id>/<tag>; the cluster's cleaning of that folder removes it. Where it is known that there are
    at most `rows` rows, few rows are written by few tasks, though by no fewer than there are cores.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // ROWS_PER_FILE + 1))
    path = f"{shared_folder(spark)}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def collapsed(text: Column) -> Column:
    """The text with each run of separators replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


#: Rows of text that a task unpacks at once.
TEXTS = 1_000


def lean(function, rows: int | None = None):
    """A function for mapInArrow that gives its worker's free memory back to the machine when a task ends.

    Workers live on between tasks, so that what one stage has needed would otherwise stay beside what the next one needs.
    With rows, the function gets its batches in slices of so many rows.
    """

    def run(batches):
        parts = batches if rows is None else (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        try:
            yield from function(parts)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run
