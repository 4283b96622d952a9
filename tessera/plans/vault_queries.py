"""Directories, trees, staging, automation and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import layers, packing, reachability, vault

from . import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _s(prefix, column):
    return F.concat(F.lit(prefix), column.cast("string"))


@query("""WITH o AS (SELECT 'k' || user_id AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CASE WHEN event_type <> 'error' THEN sha256(props) END AS hash, event_id AS seq FROM events),
    s AS (SELECT path, arg_max({'op': op, 'hash': hash}, seq) AS e, count(*) AS versions, arg_min(hash, seq) FILTER (op = 'put') AS first_version, arg_max(hash, seq) FILTER (op = 'put') AS previous FROM o GROUP BY path)
    SELECT path, CASE WHEN e.op <> 'delete' THEN e.hash END AS hash, e.op = 'delete' AS is_tombstone, versions, first_version, CASE WHEN e.op = 'delete' THEN previous END AS deleted_hash FROM s""")
def fs_apply_ops(spark, sf):
    e = fx.table(spark, sf, "events")
    dead = F.col("event_type") == "error"
    return vault.apply_ops(e.select(_s("k", F.col("user_id")).alias("path"), F.when(dead, "delete").otherwise("put").alias("op"), F.when(~dead, F.sha2("props", 256)).alias("hash"), F.col("event_id").alias("seq")))


_TREE = """e AS (SELECT key, size, o_orderkey // 50 AS leaf_id FROM base), l0 AS (SELECT leaf_id, min(key) AS first_key, count(*) AS entries, CAST(sum(size) AS BIGINT) AS size FROM e GROUP BY 1)"""


def _entries(spark, sf):
    return fx.base(spark, sf).select("key", "size", F.expr("o_orderkey div 50").alias("leaf_id"))


@query(f"WITH {fx.LAYERS}, {_TREE} SELECT * FROM l0")
def link_rollup(spark, sf):
    return vault.leaf_links(_entries(spark, sf))


@query(f"""WITH {fx.LAYERS}, {_TREE}, l1 AS (SELECT leaf_id // 8192 AS leaf_id, min(first_key) AS first_key, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(size) AS BIGINT) AS size FROM l0 GROUP BY 1),
    l2 AS (SELECT leaf_id // 8192 AS leaf_id, min(first_key) AS first_key, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(size) AS BIGINT) AS size FROM l1 GROUP BY 1)
    SELECT *, CAST(0 AS BIGINT) AS level FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2""")
def tree_build(spark, sf):
    return vault.build_tree(_entries(spark, sf), 8192, 8192 * 8192)


@query(f"""WITH {fx.FILES}, leaf AS (SELECT lang || '/' || source AS tree, substr(sha256(key), 1, 2) AS place, sha256(string_agg(key || '=' || hash, chr(10) ORDER BY key)) AS h FROM files GROUP BY 1, 2)
    SELECT tree, sha256(string_agg(place || '=' || h, chr(10) ORDER BY place)) AS root FROM leaf GROUP BY 1""")
def root_hashes(spark, sf):
    """The SQL has one level of leaves, as trees of up to 65,536 entries have."""
    return vault.root_hashes(fx.files(spark, sf).withColumn("tree", F.concat_ws("/", "lang", "source")), "tree")


@query("""SELECT 'p/' || p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN 'mkdir' WHEN p_partkey % 11 = 0 THEN 'skip' ELSE 'write' END AS action,
    CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END AS BIGINT) AS phase, CAST(CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END AS BIGINT) AS depth FROM part""")
def restore_plan(spark, sf):
    p = fx.table(spark, sf, "part")
    return vault.restore_plan(p.select(_s("p/", F.col("p_partkey")).alias("key"), F.when(F.expr("p_partkey % 7 = 0"), "dir").when(F.expr("p_partkey % 11 = 0"), "fifo").otherwise("file").alias("kind")))


@query(f"WITH {fx.FILES} SELECT key AS path, hash FROM files WHERE doc_id % 4 = 0")
def vanished_links(spark, sf):
    f = fx.files(spark, sf).select(F.col("key").alias("path"), "hash", "doc_id")
    return vault.vanished(f, f.where("doc_id % 4 <> 0")).drop("doc_id")


@query(f"WITH {fx.FILES} SELECT key, CASE WHEN doc_id % 3 = 0 THEN 'delete' ELSE 'enqueue' END AS action FROM files WHERE doc_id % 2 = 0")
def staging_reconcile(spark, sf):
    f = fx.files(spark, sf)
    return vault.reconcile_staging(f.where("doc_id % 2 = 0").select("key"), f.where("doc_id % 3 = 0"))


@query(f"""WITH {fx.FILES}, asked AS (SELECT DISTINCT sha256('salt' || hash) AS blinded FROM files UNION SELECT sha256('other' || hash) FROM files WHERE doc_id % 100 = 0)
    SELECT DISTINCT blinded, hash FROM asked JOIN files ON blinded = sha256('salt' || hash)""")
def blinded_lookup(spark, sf):
    """Every blinded hash looked up, and some under another salt that match none."""
    f = fx.files(spark, sf)
    blind = lambda salt: F.sha2(F.concat(F.lit(salt), "hash"), 256).alias("blinded")
    asked = f.select(blind("salt")).union(f.where("doc_id % 100 = 0").select(blind("other"))).distinct()
    return vault.blinded_match(asked, f.select("hash").distinct(), "salt")


@query(f"""WITH {fx.MEMBERS}, g AS (SELECT pack, CAST(sum(length) AS BIGINT) AS size, min(doc_id) AS oldest FROM members JOIN files USING (key) GROUP BY pack)
    SELECT *, CASE WHEN size >= 30000 THEN 'full' ELSE 'stale' END AS reason FROM g WHERE size >= 30000 OR 1000 - oldest >= 950""")
def pack_ready(spark, sf):
    f = fx.files(spark, sf)
    groups = f.groupBy(F.concat_ws("-", "lang", "source").alias("pack")).agg(F.sum("size").cast("long").alias("size"), F.min("doc_id").alias("oldest"))
    return vault.ready_groups(groups, 30_000, 1000, 950)


@query("""WITH w AS (SELECT c_name AS name, c_mktsegment AS trigger FROM customer WHERE c_custkey % 3 <> 0), r AS (SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE c_mktsegment END AS trigger FROM customer WHERE c_custkey % 4 <> 0)
    SELECT name, CASE WHEN r.name IS NULL THEN 'start' WHEN w.name IS NULL THEN 'stop' ELSE 'restart' END AS action FROM w FULL JOIN r USING (name) WHERE r.name IS NULL OR w.name IS NULL OR w.trigger <> r.trigger""")
def automation_reconcile(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("trigger"))
    running = c.where("c_custkey % 4 <> 0").withColumn("trigger", F.when(F.expr("c_custkey % 5 = 0"), "old").otherwise(F.col("trigger")))
    return vault.reconcile_loops(c.where("c_custkey % 3 <> 0"), running)


@query("""SELECT c_name AS source, CASE c_custkey % 3 WHEN 1 THEN 'watch' ELSE 'every' END AS trigger FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 2 = 0
    UNION ALL SELECT c_name, 'watch' FROM customer WHERE c_custkey % 2 = 1""")
def active_automations(spark, sf):
    c = fx.table(spark, sf, "customer").withColumnRenamed("c_name", "source")
    trigger = F.when(F.expr("c_custkey % 3 = 0"), "manual").when(F.expr("c_custkey % 3 = 1"), "watch").otherwise("every")
    return vault.active_automations(c.where("c_custkey % 2 = 0").select("source", trigger.alias("trigger"), F.expr("c_custkey % 5 = 0").alias("paused")), c.select("source"))


@query("""SELECT p_partkey AS node, CASE WHEN p_partkey % 2 = 0 THEN 'a=child,b=parent' ELSE 'a=parent,b=parent' END AS keys, CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE p_brand END AS pipeline FROM part""")
def context_merge(spark, sf):
    p = fx.table(spark, sf, "part").withColumnRenamed("p_partkey", "node")
    parent = p.select("node", F.create_map(F.lit("a"), F.lit("parent"), F.lit("b"), F.lit("parent")).alias("keys"), F.col("p_brand").alias("pipeline"))
    child = p.select("node", F.when(F.expr("node % 2 = 0"), F.create_map(F.lit("a"), F.lit("child"))).alias("keys"), F.when(F.expr("node % 3 = 0"), "own").alias("pipeline"))
    entries = F.array_sort(F.transform(F.map_entries("keys"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return vault.merged_context(parent, child).select("node", F.array_join(entries, ",").alias("keys"), "pipeline")


@query(f"WITH {fx.FILES} SELECT hash AS key, min(lang || '-' || source) AS pack FROM files GROUP BY 1")
def index_compact(spark, sf):
    f = fx.files(spark, sf).select("doc_id", F.col("hash").alias("key"), F.concat_ws("-", "lang", "source").alias("pack"))
    return vault.compact(f.where("doc_id % 2 = 0").drop("doc_id"), f.where("doc_id % 2 = 1").drop("doc_id"))


@query(f"""WITH {fx.FILES}, h AS (SELECT hash, count(*) AS n, min(doc_id) AS d FROM files GROUP BY hash) SELECT hash, CASE WHEN d % 3 = 0 THEN 'retry' WHEN d % 3 = 1 THEN 'indexed' ELSE 'dropped' END AS outcome, CASE WHEN d % 3 = 1 THEN n END AS members FROM h""")
def late_packs(spark, sf):
    h = fx.files(spark, sf).groupBy("hash").agg(F.count("*").alias("members"), F.min("doc_id").alias("d"))
    headers = h.where("d % 3 <> 0").select("hash", F.when(F.expr("d % 3 = 1"), "pack").otherwise("other").alias("state"), "members")
    return vault.late_packs(h.select("hash"), headers)


@query("""WITH m AS (SELECT DISTINCT c_nationkey AS vault, c_mktsegment AS peer FROM customer WHERE c_custkey % 7 = 0), r AS (SELECT c_custkey AS request, CASE c_custkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'vault' ELSE 'pin' END AS kind, c_nationkey AS vault,
        c_mktsegment AS peer, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'other' END AS owner FROM customer), a AS (SELECT r.*, m.peer IS NOT NULL AS member FROM r LEFT JOIN m USING (vault, peer))
    SELECT request, CASE kind WHEN 'local' THEN peer = owner WHEN 'vault' THEN member ELSE true END AS may_read, CASE kind WHEN 'local' THEN peer = owner WHEN 'vault' THEN member ELSE false END AS may_write FROM a""")
def registry_access(spark, sf):
    c = fx.table(spark, sf, "customer")
    kind = F.when(F.expr("c_custkey % 3 = 0"), "local").when(F.expr("c_custkey % 3 = 1"), "vault").otherwise("pin")
    vault_peer = [F.col("c_nationkey").alias("vault"), F.col("c_mktsegment").alias("peer")]
    requests = c.select(F.col("c_custkey").alias("request"), kind.alias("kind"), *vault_peer, F.when(F.expr("c_custkey % 2 = 0"), F.col("c_mktsegment")).otherwise("other").alias("owner"))
    return vault.registry_access(requests, c.where("c_custkey % 7 = 0").select(*vault_peer))


@query("SELECT CASE WHEN c_custkey = 0 THEN 'self' ELSE c_name END AS name, CASE WHEN c_custkey = 0 THEN 'did:me' WHEN c_custkey % 4 <> 1 THEN 'did:' || c_custkey END AS did FROM customer")
def name_resolution(spark, sf):
    c = fx.table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") == 0, "self").otherwise(F.col("c_name")).alias("name")
    return vault.names_to_identities(c.select(name), c.where("c_custkey % 4 <> 1").select(name, _s("did:", F.col("c_custkey")).alias("did")), "did:me")


@query(f"WITH {fx.SNAPSHOTS}, s AS (SELECT * FROM snapshots UNION ALL SELECT DISTINCT vault, 'current', vault FROM snapshots) SELECT *, row_number() OVER (PARTITION BY vault ORDER BY ts DESC) AS place FROM s")
def snapshot_list(spark, sf):
    s = fx.snapshots(spark, sf)
    return vault.newest_first(s.unionByName(s.select("vault", F.lit("current").alias("ts"), F.col("vault").alias("hash")).distinct()))


@query(f"WITH {fx.BLOBS}, {fx.SNAPSHOTS} SELECT hash FROM live UNION SELECT hash FROM snapshots UNION SELECT hash FROM pins")
def published_reachable(spark, sf):
    """Head, history and walk together."""
    return fx.live(spark, sf).union(fx.snapshots(spark, sf).select("hash")).union(fx.pins(spark, sf).select("hash")).distinct()


@query(f"WITH {fx.BLOBS} SELECT hash, size FROM blobs WHERE hash NOT IN (SELECT hash FROM pins) AND hash NOT IN (SELECT hash FROM live)")
def gc_without_age(spark, sf):
    """The older collector: what is neither pinned nor reachable, whatever its age."""
    b = fx.blobs(spark, sf).select("hash", "size")
    return b.join(fx.pins(spark, sf), "hash", "left_anti").join(fx.live(spark, sf), "hash", "left_anti")


@query("SELECT user_id AS peer, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS alpns FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def peer_debug_rollup(spark, sf):
    n = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("peer"), "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("peer").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "event_type", F.col("n").cast("string")))), ",").alias("alpns"))


@query("SELECT (SELECT count(*) FROM supplier) AS stores, (SELECT count(*) FROM nation) AS vaults, (SELECT count(*) FROM customer) AS sources, (SELECT count(*) FROM events WHERE event_type = 'view') AS running")
def status_rollup(spark, sf):
    """Counts of what is configured and running, in one row."""
    t = lambda n, c, where="true": fx.table(spark, sf, n).where(where).select(F.lit(c).alias("what"))
    rows = t("supplier", "stores").unionAll(t("nation", "vaults")).unionAll(t("customer", "sources")).unionAll(t("events", "running", "event_type = 'view'"))
    count = lambda c: F.count_if(F.col("what") == c).cast("long").alias(c)
    return rows.agg(*map(count, ("stores", "vaults", "sources", "running")))


@query(f"WITH {fx.FILES} SELECT lang AS store, CAST(sum(size) AS BIGINT) AS staged_bytes, max(doc_id) AS last, count(*) AS inflight FROM files GROUP BY 1")
def staging_gauges(spark, sf):
    return fx.files(spark, sf).groupBy(F.col("lang").alias("store")).agg(F.sum("size").cast("long").alias("staged_bytes"), F.max("doc_id").alias("last"), F.count("*").alias("inflight"))


@query(f"""WITH {fx.LAYERS}, marks AS (SELECT key AS first_key, o_orderkey AS leaf_id FROM base WHERE o_orderkey % 41 = 0)
    SELECT leaf_id, count(*) AS changes FROM base ASOF JOIN marks ON base.key >= marks.first_key GROUP BY leaf_id""")
def floor_seek(spark, sf):
    """Every key of base sought."""
    b = fx.base(spark, sf)
    return layers.affected_leaves(b.where("o_orderkey % 41 = 0").select(F.col("key").alias("first_key"), F.col("o_orderkey").alias("leaf_id")), b)


@query(f"""WITH RECURSIVE {fx.SNAPSHOTS}, c AS (SELECT vault, ts, hash, lag(hash) OVER (PARTITION BY vault ORDER BY ts) AS parent FROM snapshots), edges AS (SELECT vault || ts AS parent, vault || lead(ts) OVER (PARTITION BY vault ORDER BY ts) AS child FROM snapshots),
    r AS (SELECT vault || min(ts) AS node FROM snapshots GROUP BY vault UNION SELECT child FROM r JOIN edges ON parent = node WHERE child IS NOT NULL) SELECT node FROM r""")
def version_walk(spark, sf):
    """All versions that follow from the first of each vault, along its chain."""
    from pyspark.sql import Window

    s = fx.snapshots(spark, sf).withColumn("node", F.concat("vault", "ts"))
    edges = s.withColumn("child", F.lead("node").over(Window.partitionBy("vault").orderBy("ts"))).where("child is not null").select(F.col("node").alias("parent"), "child")
    return reachability.closure(s.groupBy("vault").agg(F.min("node").alias("node")).select("node"), edges)


@query("""SELECT c_custkey, substr(sha256(c_name), 1, 12) AS short, sha256('node key' || c_name) AS secret, substr(sha256('vault id' || c_name), 1, 32) AS vault_id, CASE WHEN c_custkey % 2 = 0 THEN 'z' || replace(CAST(c_custkey + 1 AS VARCHAR), '0', 'a') END AS did FROM customer""")
def identity_scalars(spark, sf):
    c = fx.table(spark, sf, "customer")
    did = F.when(F.expr("c_custkey % 2 = 0"), F.concat(F.lit("did:key:z"), F.translate((F.col("c_custkey") + 1).cast("string"), "0", "a"))).otherwise(_s("did:web:", F.col("c_custkey")))
    return c.select("c_custkey", scalars.short_hash(F.sha2("c_name", 256)).alias("short"), scalars.derived("node key", F.col("c_name")).alias("secret"), scalars.vault_id(F.col("c_name")).alias("vault_id"), scalars.did_key(did, "key").alias("did"))


@query(f"""WITH {fx.REGISTRY_LOG} SELECT seq, CASE WHEN type = 'Stream' THEN '08' ELSE '07' END || sha256(CAST(stream_key AS VARCHAR)) || lower(printf('%016X', revision)) || hash AS wire, type, sha256(CAST(stream_key AS VARCHAR)) AS key, revision, hash, CAST(NULL AS VARCHAR) AS error FROM log""")
def message_codec(spark, sf):
    log = fx.registry_log(spark, sf).withColumn("key", F.sha2(F.col("stream_key").cast("string"), 256))
    wire = log.select("seq", scalars.message(F.col("type"), F.col("key"), F.col("revision"), F.col("hash")).alias("wire"))
    return wire.withColumn("m", scalars.message_fields(F.col("wire"))).select("seq", "wire", "m.*")


@query(f"""WITH {fx.MEMBERS} SELECT pack, substr(sha256(key), 1, 24) AS key, "offset" FROM laid""")
def pack_header_roundtrip(spark, sf):
    laid = packing.layout(fx.members(spark, sf)).select("pack", F.substring(F.sha2("key", 256), 1, 24).alias("key"), "offset")
    headers = laid.groupBy("pack").agg(scalars.pack_header(F.collect_list(F.struct("key", "offset"))).alias("header"))
    return headers.select("pack", F.explode(scalars.pack_members(F.col("header"))).alias("m")).select("pack", "m.*")


@query("SELECT a.p_partkey, a.p_brand = b.p_brand AND a.p_size = b.p_size AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def keyset_equality(spark, sf):
    """Whether neighbouring keysets are equal but for their revision."""
    p = fx.table(spark, sf, "part").select("p_partkey", F.struct("p_brand", "p_size").alias("k"))
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("k").alias("o"))
    return p.join(other, "p_partkey").select("p_partkey", F.col("k").eqNullSafe(F.col("o")).alias("same"))


@query(f"WITH {fx.FILES} SELECT key, CASE WHEN lang = 'en' THEN 'zstd' ELSE 'none' END AS compression, CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN 512 ELSE 4096 END::BIGINT AS padding FROM files")
def route_override(spark, sf):
    """Encoding context of each file: the route's fields, then the defaults."""
    f = fx.files(spark, sf)
    over = f.where("lang = 'en'").select("key", F.lit("zstd").alias("r_compression"), F.when(F.expr("doc_id % 2 = 0"), 512).alias("r_padding"))
    return f.join(over, "key", "left").select("key", F.coalesce("r_compression", F.lit("none")).alias("compression"), F.coalesce("r_padding", F.lit(4096)).cast("long").alias("padding"))


@query(f"""WITH {fx.LAYERS}, own AS (SELECT key, sha256('shard' || hash) AS hash, size, false AS is_tombstone FROM base WHERE o_orderkey % 6 = 0)
    SELECT key, coalesce(o.hash, b.hash) AS hash, coalesce(o.size, b.size) AS size FROM base b LEFT JOIN own o USING (key)""")
def export_merged(spark, sf):
    """A sharded directory as one: what a shard holds overwrites the parent."""
    b = fx.base(spark, sf).select("key", "hash", "size", "is_tombstone", "o_orderkey")
    shard = b.where("o_orderkey % 6 = 0").withColumn("hash", F.sha2(F.concat(F.lit("shard"), "hash"), 256))
    return layers.merged_view([shard.drop("o_orderkey"), b.drop("o_orderkey")]).select("key", "hash", "size")


@query()
def base58_keys(spark, sf):
    return fx.files(spark, sf).select("hash", scalars.base58(F.unhex("hash")).alias("multikey")).distinct()
