"""Inputs of the catalogue's queries, derived from the driver tables; each with its SQL form for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("stream_key"),
        F.floor("value").cast("long").alias("revision"),
        F.sha2("props", 256).alias("hash"),
        F.when(F.col("event_type") == "view", "Stream").otherwise("Registry").alias("type"),
        F.col("event_id").alias("seq"),
    )


REGISTRY_LOG = """log AS (SELECT user_id AS stream_key, CAST(floor(value) AS BIGINT) AS revision, sha256(props) AS hash,
    CASE WHEN event_type = 'view' THEN 'Stream' ELSE 'Registry' END AS type, event_id AS seq FROM events)"""


def _cents(c):
    return F.round(F.col(c) * 100).cast("long")


def base(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string"))
    return o.select(key.alias("key"), F.sha2(F.concat("o_orderstatus", _cents("o_totalprice").cast("string")), 256).alias("hash"), (_cents("o_totalprice") % 4096).alias("size"), F.lit(False).alias("is_tombstone"), "o_orderkey", "o_orderdate")


def changes(spark, sf_dir, salt: str = "new"):
    b = base(spark, sf_dir).where("o_orderkey % 10 < 3")
    kind = F.col("o_orderkey") % 10
    return b.select(
        F.when(kind == 2, F.concat(F.lit("new/"), F.col("key"))).otherwise(F.col("key")).alias("key"),
        F.when(kind == 0, F.sha2(F.concat(F.lit(salt), F.col("hash")), 256)).when(kind == 2, F.col("hash")).alias("hash"),
        F.when(kind != 1, F.col("size") + 1).alias("size"),
        (kind == 1).alias("is_tombstone"),
    )


LAYERS = """base AS (SELECT 'c' || o_custkey || '/o' || o_orderkey AS key, sha256(o_orderstatus || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)) AS hash,
    CAST(round(o_totalprice * 100) AS BIGINT) % 4096 AS size, false AS is_tombstone, o_orderkey, o_orderdate FROM orders),
changes AS (SELECT CASE WHEN o_orderkey % 10 = 2 THEN 'new/' || key ELSE key END AS key,
    CASE WHEN o_orderkey % 10 = 0 THEN sha256('new' || hash) WHEN o_orderkey % 10 = 2 THEN hash END AS hash,
    CASE WHEN o_orderkey % 10 <> 1 THEN size + 1 END AS size, o_orderkey % 10 = 1 AS is_tombstone FROM base WHERE o_orderkey % 10 < 3)"""


def files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(key.alias("key"), F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("size"), F.lit(False).alias("is_tombstone"), "text", "doc_id", "lang", "source")


FILES = """files AS (SELECT lang || '/' || source || '/' || doc_id || '.txt' AS key, sha256(text) AS hash, CAST(length(text) AS BIGINT) AS size,
    false AS is_tombstone, text, doc_id, lang, source FROM documents)"""


def snapshots(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("vault"), F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0")).alias("ts"), F.sha2("text", 256).alias("hash"))


SNAPSHOTS = """snapshots AS (SELECT 'v' || conv_id AS vault, '2024-01-' || lpad(CAST(turn + 1 AS VARCHAR), 2, '0') AS ts, sha256(text) AS hash FROM conversations)"""


def blobs(spark, sf_dir):
    """Orders as stored blobs with a time; one in eleven has none."""
    b = base(spark, sf_dir)
    mtime = F.when(F.col("o_orderkey") % 11 != 0, F.unix_timestamp("o_orderdate"))
    return b.groupBy("hash").agg(F.max("size").alias("size"), F.max(mtime).alias("mtime"))


def pins(spark, sf_dir):
    o = base(spark, sf_dir).where("o_orderkey % 7 = 0")
    return o.select("hash", F.concat(F.lit("node"), (F.col("o_orderkey") % 3).cast("string")).alias("context"))


def live(spark, sf_dir):
    return base(spark, sf_dir).where("o_orderkey % 5 = 1").select("hash").distinct()


BLOBS = LAYERS + """,
blobs AS (SELECT hash, max(size) AS size, max(CASE WHEN o_orderkey % 11 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END) AS mtime FROM base GROUP BY hash),
pins AS (SELECT DISTINCT hash FROM base WHERE o_orderkey % 7 = 0), live AS (SELECT DISTINCT hash FROM base WHERE o_orderkey % 5 = 1)"""

NOW, MIN_AGE = 978_307_200, 86_400 * 400


def members(spark, sf_dir):
    """Documents as pack members: a pack for each language and source."""
    f = files(spark, sf_dir)
    return f.select(F.concat_ws("-", "lang", "source").alias("pack"), "key", F.col("size").alias("length"))


MEMBERS = FILES + """,
members AS (SELECT lang || '-' || source AS pack, key, size AS length FROM files),
laid AS (SELECT pack, key, CAST(ceil(count(*) OVER (PARTITION BY pack) * 20 / 4096.0) * 4096 + coalesce(sum(length) OVER (PARTITION BY pack ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    length FROM members)"""


def watch_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.col("user_id").alias("source"), F.col("event_type").alias("path"), F.col("event_id").alias("id"))
