"""Streaming operators over the events, and their batch forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import registry
from tessera.streaming import streams

from . import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TUMBLE = "SELECT user_id AS source, CAST(epoch(ts) AS BIGINT) // 2 * 2 AS start_s, count(*) AS events, count(DISTINCT event_type) AS paths FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) GROUP BY 1, 2".replace("CAST(epoch(ts) AS BIGINT)", "s")
_SESSIONS = """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM l)
    SELECT user_id AS source, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS events FROM n GROUP BY user_id, n"""


@query(_TUMBLE)
def watch_tumble_2s(spark, sf):
    rows = fx.watch_events(spark, sf).groupBy("source", F.window("ts", "2 seconds").alias("w"))
    return rows.agg(F.count("*").cast("long").alias("events"), F.count_distinct("path").alias("paths")).select("source", F.unix_timestamp("w.start").alias("start_s"), "events", "paths")


@query(_SESSIONS)
def debounce_sessions(spark, sf):
    """Bursts of writes, each flushed after half an idle hour."""
    rows = fx.watch_events(spark, sf).groupBy("source", F.session_window("ts", "30 minutes").alias("w"))
    return rows.agg(F.count("*").cast("long").alias("events")).select("source", F.unix_timestamp("w.start").alias("start_s"), "events")


@query(f"WITH {fx.REGISTRY_LOG} SELECT stream_key, revision, hash FROM log QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY revision DESC, hash) = 1")
def stream_latest(spark, sf):
    """Latest value of each key, kept by a streaming aggregate."""
    e = streams.stream_of(spark, f"{sf}/events.parquet")
    log = e.select(F.col("user_id").alias("stream_key"), F.floor("value").cast("long").alias("revision"), F.sha2("props", 256).alias("hash"))
    return streams.finished(streams.latest(log), "update", ("stream_key",))


@query(_TUMBLE)
def stream_tumble_2s(spark, sf):
    e = streams.stream_of(spark, f"{sf}/events.parquet").select("ts", F.col("user_id").alias("source"), F.col("event_type").alias("path"))
    return streams.finished(streams.tumbled(e, 2), "update", ("source", "start_s"))


@query(_SESSIONS)
def stream_sessions(spark, sf):
    e = streams.stream_of(spark, f"{sf}/events.parquet").select("ts", F.col("user_id").alias("source"), F.col("event_type").alias("path"))
    return streams.finished(streams.sessions(e, "30 minutes"), "complete")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_first_seen(spark, sf):
    e = streams.stream_of(spark, f"{sf}/events.parquet").select("ts", "event_id", "user_id", "event_type")
    return streams.finished(streams.first_seen(e, ["event_id"]).select("event_id", "user_id", "event_type"), "append")


@query("SELECT event_id, user_id, ts FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def change_feed_page(spark, sf):
    """A page of a change feed after a cursor."""
    return fx.table(spark, sf, "events").where("event_id > 100").orderBy("event_id").limit(50).select("event_id", "user_id", "ts")


@query(f"""WITH {fx.REGISTRY_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_key ORDER BY seq) AS place FROM log), b AS (SELECT stream_key, max(revision) AS held FROM r WHERE place <= 5 GROUP BY 1)
    SELECT r.stream_key, r.seq, r.revision > b.held AS wins FROM r JOIN b USING (stream_key) WHERE place > 5""")
def cas_publish_rounds(spark, sf):
    """Optimistic publishing: a later attempt wins only above the revision that the first five left."""
    place = F.row_number().over(Window.partitionBy("stream_key").orderBy("seq"))
    log = fx.registry_log(spark, sf).withColumn("place", place)
    held = registry.head_by_arrival(log.where("place <= 5")).select("stream_key", F.col("revision").alias("held"))
    return log.where("place > 5").join(held, "stream_key").select("stream_key", "seq", (F.col("revision") > F.col("held")).alias("wins"))


@query("""WITH i AS (SELECT event_id, user_id, event_type FROM events), f AS (SELECT user_id AS key, arg_max(event_type, event_id) AS op, max(event_id) AS seq FROM i GROUP BY 1) SELECT key, seq FROM f WHERE op <> 'error'""")
def index_replay(spark, sf):
    """A change feed folded into an index: the last event of a key upserts or deletes it."""
    last = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", "event_id").alias("op"), F.max("event_id").alias("seq"))
    return last.where("op <> 'error'").select("key", "seq")
