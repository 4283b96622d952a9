"""Reachability, chunks, packing, membership, ingest and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import chunks, ingest, membership, packing, reachability, sequential
from tessera.sources import store

from . import fixtures as fx

QUERIES, ORACLES = {}, {}


def _sql(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# reachability


def _edges(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda d, a, b: d.select(a.alias("parent"), b.alias("child"))
    return (
        edge(t("nation"), node("r", "n_regionkey"), node("n", "n_nationkey"))
        .unionAll(edge(t("customer"), node("n", "c_nationkey"), node("c", "c_custkey")))
        .unionAll(edge(t("orders"), node("c", "o_custkey"), node("o", "o_orderkey")))
        .unionAll(edge(t("lineitem").select("l_orderkey", "l_linenumber").distinct(), node("o", "l_orderkey"), F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))))
    )


_EDGES = """edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
    UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'l' || l_orderkey || '.' || l_linenumber FROM lineitem)"""


@query(f"WITH RECURSIVE {_EDGES}, reach AS (SELECT 'r1' AS node UNION SELECT child FROM reach JOIN edges ON parent = node) SELECT node FROM reach")
def reachable_closure(spark, sf):
    return reachability.closure(spark.createDataFrame([("r1",)], "node string"), _edges(spark, sf))


_CLASS = f"""classed AS (SELECT b.hash, b.size, CASE WHEN b.hash IN (SELECT hash FROM pins) THEN 'pinned' WHEN b.hash IN (SELECT hash FROM live) THEN 'reachable'
    WHEN NOT coalesce(b.mtime <= {fx.NOW} AND {fx.NOW} - b.mtime >= {fx.MIN_AGE}, false) THEN 'too_young' ELSE 'candidate' END AS class FROM blobs b)"""


def _classified(spark, sf):
    return reachability.classify(fx.blobs(spark, sf), fx.pins(spark, sf), fx.live(spark, sf), fx.NOW, fx.MIN_AGE)


@query(f"WITH {fx.BLOBS}, {_CLASS} SELECT * FROM classed")
def gc_classify(spark, sf):
    return _classified(spark, sf)


@query(f"""WITH {fx.BLOBS}, {_CLASS} SELECT count(*) AS total, count(*) FILTER (class = 'pinned') AS kept_by_pins, count(*) FILTER (class = 'reachable') AS kept_by_reachability,
    count(*) FILTER (class = 'too_young') AS aged_out_protected, count(*) FILTER (class = 'candidate') AS candidates,
    CAST(coalesce(sum(size) FILTER (class IN ('too_young', 'candidate')), 0) AS BIGINT) AS bytes_candidate, CAST(coalesce(sum(size) FILTER (class = 'candidate'), 0) AS BIGINT) AS bytes_reclaimed FROM classed""")
def gc_report(spark, sf):
    return reachability.report(_classified(spark, sf))


@query(f"WITH {fx.BLOBS}, {_CLASS} SELECT hash, size FROM classed WHERE class <> 'candidate'")
def gc_sweep(spark, sf):
    return reachability.sweep(fx.blobs(spark, sf), fx.pins(spark, sf), fx.live(spark, sf), fx.NOW, fx.MIN_AGE).select("hash", "size")


@query(f"WITH {fx.BLOBS} SELECT hash FROM live WHERE hash NOT IN (SELECT hash FROM blobs WHERE size % 4 <> 0)")
def verify_missing(spark, sf):
    return reachability.missing(fx.live(spark, sf), fx.blobs(spark, sf).where("size % 4 <> 0"))


@query(f"WITH {fx.BLOBS} SELECT hash, size, mtime FROM blobs WHERE hash IN (SELECT hash FROM live)")
def retained_set(spark, sf):
    return reachability.retained(fx.blobs(spark, sf), fx.live(spark, sf))


def _pin_log(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select(F.col("props").alias("hash"), F.concat(F.lit("ctx"), (F.col("user_id") % 4).cast("string")).alias("context"), F.when(F.col("event_type").isin("view", "click"), "add").otherwise("remove").alias("op"), F.col("event_id").alias("seq"))


_PINS = """plog AS (SELECT props AS hash, 'ctx' || (user_id % 4) AS context, CASE WHEN event_type IN ('view', 'click') THEN 'add' ELSE 'remove' END AS op, event_id AS seq FROM events),
lastop AS (SELECT hash, context, arg_max(op, seq) AS op, count(*) AS events FROM plog GROUP BY ALL)"""


@query(f"WITH {_PINS} SELECT hash, coalesce(string_agg(context, ',' ORDER BY context) FILTER (op = 'add'), '') AS contexts, CAST(sum(events) AS BIGINT) AS revision FROM lastop GROUP BY hash")
def pin_sets(spark, sf):
    return reachability.pin_state(_pin_log(spark, sf)).withColumn("contexts", F.array_join("contexts", ","))


@query(f"WITH {_PINS} SELECT hash, CAST(sum(events) AS BIGINT) AS revision FROM lastop GROUP BY hash HAVING count(*) FILTER (op = 'add') = 0")
def pins_orphaned(spark, sf):
    return reachability.orphaned(_pin_log(spark, sf))


# chunks

_SIZE = 512
_CUT = f"""chunks AS (SELECT key, CAST(k AS BIGINT) AS chunk_index, CAST(k * {_SIZE} AS BIGINT) AS "offset", CAST(length(substr(text, k * {_SIZE} + 1, {_SIZE})) AS BIGINT) AS length,
    sha256(substr(text, k * {_SIZE} + 1, {_SIZE})) AS hash FROM (SELECT key, text, unnest(range(0, CAST(ceil(length(text) / {_SIZE}.0) AS BIGINT))) AS k FROM files)),
old AS (SELECT key, CAST(k AS BIGINT) AS chunk_index, sha256(substr(t, k * {_SIZE} + 1, {_SIZE})) AS hash, CAST(length(substr(t, k * {_SIZE} + 1, {_SIZE})) AS BIGINT) AS length
    FROM (SELECT key, t, unnest(range(0, CAST(ceil(length(t) / {_SIZE}.0) AS BIGINT))) AS k FROM (SELECT key, left(text, CAST(length(text) - length(text) // 3 AS BIGINT)) AS t FROM files)))"""


def _chunked(spark, sf):
    return chunks.cut(fx.files(spark, sf), _SIZE)


def _earlier(spark, sf):
    shorter = fx.files(spark, sf).withColumn("text", F.expr("substring(text, 1, length(text) - length(text) div 3)"))
    return chunks.cut(shorter, _SIZE)


@query(f"WITH {fx.FILES}, {_CUT} SELECT * FROM chunks")
def chunk_fixed(spark, sf):
    return _chunked(spark, sf).drop("data")


@query(f"WITH {fx.FILES}, {_CUT} SELECT c.key, c.chunk_index, c.hash, coalesce(c.hash = o.hash, false) AS reused FROM chunks c LEFT JOIN old o USING (key, chunk_index)")
def chunk_positional_dedup(spark, sf):
    return chunks.positional_reuse(_chunked(spark, sf), _earlier(spark, sf)).select("key", "chunk_index", "hash", "reused")


@query(f"""WITH {fx.FILES}, {_CUT}, f AS (SELECT *, min(CASE WHEN length = {_SIZE} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY chunk_index) AS fu FROM old)
    SELECT key, CAST(sum(fu) AS BIGINT) AS chunks, CAST(sum(fu * length) AS BIGINT) AS bytes FROM f GROUP BY key""")
def append_prefix_reuse(spark, sf):
    return chunks.full_prefix(_earlier(spark, sf), _SIZE)


@query(f"WITH {fx.FILES} SELECT DISTINCT key, true AS ok FROM files WHERE length(text) > 0")
def reassemble_verify(spark, sf):
    return chunks.verify(fx.files(spark, sf).where("length(text) > 0"), chunks.reassemble(_chunked(spark, sf)))


@query(f"WITH {fx.FILES}, {_CUT} SELECT key, chunk_index, hash FROM chunks WHERE chunk_index IN (0, 2)")
def chunk_sparse_read(spark, sf):
    return _chunked(spark, sf).where("chunk_index in (0, 2)").select("key", "chunk_index", "hash")


@query(f"WITH {fx.FILES}, e AS (SELECT hash, count(*) AS n, max(size) AS size FROM files GROUP BY hash) SELECT CAST(sum(n) AS BIGINT) AS blobs, count(*) AS stored, CAST(sum(n * size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS stored_bytes FROM e")
def blob_dedup_stats(spark, sf):
    return chunks.dedup_stats(fx.files(spark, sf))


@query(f"WITH {fx.FILES} SELECT hash, max(size) AS size FROM files WHERE doc_id % 2 = 1 AND hash NOT IN (SELECT hash FROM files WHERE doc_id % 2 = 0) GROUP BY hash")
def blob_import(spark, sf):
    f = fx.files(spark, sf)
    return chunks.imports(f.where("doc_id % 2 = 1"), f.where("doc_id % 2 = 0"))


@query(f"""WITH {fx.FILES}, {_CUT}, n AS (SELECT DISTINCT hash, length AS size FROM chunks), r AS (SELECT size, hash IN (SELECT hash FROM old) AS known FROM n)
    SELECT count(*) FILTER (NOT known) AS uploaded, CAST(coalesce(sum(size) FILTER (NOT known), 0) AS BIGINT) AS bytes_uploaded, count(*) FILTER (known) AS deduped, CAST(coalesce(sum(size) FILTER (known), 0) AS BIGINT) AS bytes_deduped FROM r""")
def node_write_dedup(spark, sf):
    return chunks.node_writes(_chunked(spark, sf).select("hash", F.col("length").alias("size")), _earlier(spark, sf))


# packing


@query(f'WITH {fx.MEMBERS} SELECT pack, key, "offset", length FROM laid')
def pack_offsets(spark, sf):
    return packing.layout(fx.members(spark, sf))


@query(f'WITH {fx.MEMBERS} SELECT pack, key, "offset", length FROM laid')
def pack_member_length(spark, sf):
    laid = packing.layout(fx.members(spark, sf))
    ends = laid.groupBy("pack").agg(F.max(F.col("offset") + F.col("length")).alias("end_offset"))
    return packing.lengths(laid.drop("length"), ends)


@query(f"""WITH {fx.MEMBERS}, ix AS (SELECT * FROM laid WHERE pack <> 'en-src1'), asked AS (SELECT key FROM files UNION ALL SELECT 'absent/' || key FROM files WHERE doc_id % 100 = 0)
    SELECT a.key, i.pack, i."offset", CASE WHEN i.key IS NOT NULL THEN 'hit' ELSE 'unknown' END AS outcome FROM asked a LEFT JOIN ix i USING (key)""")
def pack_locate_tristate(spark, sf):
    """Every document located, and some absent keys."""
    f = fx.files(spark, sf)
    absent = f.where("doc_id % 100 = 0").select(F.concat(F.lit("absent/"), "key").alias("key"))
    return packing.locate(f.select("key").unionAll(absent), packing.layout(fx.members(spark, sf)).where("pack <> 'en-src1'"), unread=1)


@query(f"""WITH {fx.MEMBERS}, s AS (SELECT pack, CAST(sum(length) AS BIGINT) AS size FROM members GROUP BY pack), a AS (SELECT *, CAST(ceil(size / 65536.0) * 65536 AS BIGINT) AS allocated FROM s)
    SELECT pack, size, allocated, round((allocated - size) / allocated, 9) AS waste FROM a""")
def pack_waste(spark, sf):
    return packing.waste(fx.members(spark, sf), 65_536)


@query("""WITH f AS (SELECT 's' || (c_nationkey % 4) AS store, c_name AS path, c_custkey % 1000 + 1 AS size, 978307200 - (c_custkey * 7919) % 4000000 AS mtime FROM customer),
    t AS (SELECT store, sum(size) AS total FROM f GROUP BY store HAVING sum(size) > 60000), e AS (SELECT f.*, total FROM f JOIN t USING (store) WHERE mtime > 978307200 OR 978307200 - mtime >= 86400),
    r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY store ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
    SELECT store, path, size FROM r WHERE total - before > 57000""")
def prune_budget(spark, sf):
    c = fx.table(spark, sf, "customer")
    files = c.select(
        F.concat(F.lit("s"), (F.col("c_nationkey") % 4).cast("string")).alias("store"), F.col("c_name").alias("path"), (F.col("c_custkey") % 1000 + 1).alias("size"), (F.lit(fx.NOW) - (F.col("c_custkey") * 7919) % 4_000_000).alias("mtime")
    )
    return packing.prune(files, 60_000, fx.NOW, 86_400)


@query(f"""WITH {fx.FILES} SELECT key, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 END AS BIGINT) AS source, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'hit' ELSE 'unknown' END AS outcome FROM files""")
def multi_source_fetch(spark, sf):
    f = fx.files(spark, sf)
    return packing.fetch(f.select("key"), [f.where("doc_id % 2 = 0"), f.where("doc_id % 3 = 0")], [False, True])


_ADMITS = """x = 0 OR NOT (x + length > 65536 AND (x >= 65536 OR length > 16384 - x % 16384)) AND (x + length <= 65536 AND (ceil(x / 16384.0) * 16384 - x) / (ceil(x / 16384.0) * 16384) >= 0.1 OR length <= 16384 - x % 16384
        OR (ceil((x + length) / 16384.0) * 16384 - x - length) / (ceil((x + length) / 16384.0) * 16384) < (ceil(x / 16384.0) * 16384 - x) / (ceil(x / 16384.0) * 16384))"""


@query(f"""WITH RECURSIVE {fx.FILES}, blobs AS (SELECT lang || '-' || source AS batch, key AS path, size AS length, row_number() OVER (PARTITION BY lang, source ORDER BY key) AS n FROM files),
    r AS (SELECT batch, path, length, n, CAST(0 AS BIGINT) AS pack, [length] AS sizes FROM blobs WHERE n = 1
        UNION ALL SELECT batch, path, length, n, CAST(place - 1 AS BIGINT), list_transform(sizes, lambda x, i: CASE WHEN i = place THEN x + length ELSE x END)
        FROM (SELECT b.batch, b.path, b.length, b.n, list_append(r.sizes, 0) AS sizes, list_position(list_transform(list_append(r.sizes, 0), lambda x: ({_ADMITS.replace('length', 'b.length')})), true) AS place
            FROM r JOIN blobs b ON b.batch = r.batch AND b.n = r.n + 1))
    SELECT batch, path, length, pack FROM r""")
def first_fit_packs(spark, sf):
    f = fx.files(spark, sf)
    return sequential.first_fit(f.select(F.concat_ws("-", "lang", "source").alias("batch"), F.col("key").alias("path"), F.col("size").alias("length")), 16_384, 65_536, 0.1)


@query(f"""WITH RECURSIVE {fx.FILES}, e AS (SELECT lang || '/' || source AS tree, key, ('0x' || sha256(key)[1:2])::BIGINT & 3 = 0 AS ends, row_number() OVER (PARTITION BY lang, source ORDER BY key) AS n FROM files),
    r AS (SELECT tree, key, n, ends, CAST(0 AS BIGINT) AS group_id, 1 AS held FROM e WHERE n = 1
        UNION ALL SELECT e.tree, e.key, e.n, e.ends, r.group_id + CAST(r.ends AND r.held >= 4 AS BIGINT), CASE WHEN r.ends AND r.held >= 4 THEN 1 ELSE r.held + 1 END FROM r JOIN e ON e.tree = r.tree AND e.n = r.n + 1)
    SELECT tree, key, group_id FROM r""")
def boundary_groups_min4(spark, sf):
    return sequential.boundary_groups(fx.files(spark, sf).select(F.concat_ws("/", "lang", "source").alias("tree"), "key"), mask=3)


@query()
def cdc_chunks(spark, sf):
    return sequential.cdc_chunks(fx.files(spark, sf), 512, 8192, 10)


@query()
def shard_buckets(spark, sf):
    return sequential.shard_buckets(fx.files(spark, sf).select(F.col("key").alias("name")))


@query(f"""WITH {fx.LAYERS}, h AS (SELECT key, ('0x' || sha256(key)[1:8])::BIGINT & 3 = 0 AS b FROM base)
    SELECT key, CAST(coalesce(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY split_part(key, '/', 1) ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_id FROM h""")
def boundary_groups_min1(spark, sf):
    """Groups that end at each boundary key, within each directory, for every key of base."""
    from pyspark.sql import Window

    flag = F.conv(F.substring(F.sha2("key", 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(3)) == 0
    order = Window.partitionBy(F.split_part("key", F.lit("/"), F.lit(1))).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return fx.base(spark, sf).select("key", F.coalesce(F.sum(F.when(flag, 1).otherwise(0)).over(order), F.lit(0)).cast("long").alias("group_id"))


# membership

_MEMBERS = """mem AS (SELECT 'v' || c_nationkey AS vault, c_name AS name FROM customer), friends AS (SELECT c_name AS name, 'did:' || c_custkey AS did FROM customer WHERE c_custkey % 10 <> 3),
heads AS (SELECT 'did:' || c_custkey AS did, sha256(c_name) AS bundle_hash FROM customer WHERE c_custkey % 10 <> 4), bundles AS (SELECT sha256(c_name) AS bundle_hash, md5(c_name) AS key FROM customer WHERE c_custkey % 10 <> 5),
resolved AS (SELECT vault, name, coalesce(did, 'unresolved:' || name) AS did, key IS NOT NULL AS resolved, key FROM mem LEFT JOIN friends USING (name) LEFT JOIN heads USING (did) LEFT JOIN bundles USING (bundle_hash))"""


def _resolved(spark, sf):
    c = fx.table(spark, sf, "customer")
    did = F.concat(F.lit("did:"), F.col("c_custkey").cast("string")).alias("did")
    bundle = F.sha2("c_name", 256).alias("bundle_hash")
    return membership.resolve(
        c.select(F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("vault"), F.col("c_name").alias("name")),
        c.where("c_custkey % 10 <> 3").select(F.col("c_name").alias("name"), did),
        c.where("c_custkey % 10 <> 4").select(did, bundle),
        c.where("c_custkey % 10 <> 5").select(bundle, F.md5("c_name").alias("key")),
    )


@query(f"WITH {_MEMBERS} SELECT * FROM resolved")
def membership_resolved(spark, sf):
    return _resolved(spark, sf)


@query(f"WITH {_MEMBERS} SELECT vault, coalesce(string_agg(DISTINCT key, ',' ORDER BY key), '') AS keys, count(*) AS members FROM resolved GROUP BY vault")
def vault_recipients(spark, sf):
    return membership.recipients(_resolved(spark, sf))


@query("""WITH req AS (SELECT o_orderkey AS request, 'c' || o_custkey AS principal, 'b' || (o_orderkey % 500) AS hash FROM orders), pub AS (SELECT DISTINCT 'b' || s_suppkey AS hash FROM supplier),
    vb AS (SELECT 'v' || (p_partkey % 25) AS vault, 'b' || (p_partkey % 500) AS hash FROM part), acl AS (SELECT 'v' || c_nationkey AS vault, 'c' || c_custkey AS principal FROM customer)
    SELECT request, principal, hash, CASE WHEN hash IN (SELECT hash FROM pub) THEN 'public' WHEN EXISTS (SELECT 1 FROM vb JOIN acl USING (vault) WHERE vb.hash = req.hash AND acl.principal = req.principal) THEN 'member' ELSE 'denied' END AS reason FROM req""")
def acl_allowed(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    requests = t("orders").select(F.col("o_orderkey").alias("request"), s("c", F.col("o_custkey")).alias("principal"), s("b", F.col("o_orderkey") % 500).alias("hash"))
    acl = t("customer").select(s("v", F.col("c_nationkey")).alias("vault"), s("c", F.col("c_custkey")).alias("principal"))
    held = t("part").select(s("v", F.col("p_partkey") % 25).alias("vault"), s("b", F.col("p_partkey") % 500).alias("hash")).distinct()
    return membership.allowed(requests, acl, held, t("supplier").select(s("b", F.col("s_suppkey")).alias("hash")))


@query("""WITH acl AS (SELECT DISTINCT c_nationkey AS vault, c_mktsegment AS principal FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier WHERE s_suppkey % 2 = 0),
    pairs AS (SELECT a.n_nationkey AS source, b.n_nationkey AS target FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1)
    SELECT source, target, principal FROM pairs JOIN acl ON vault = target WHERE NOT EXISTS (SELECT 1 FROM acl x WHERE x.vault = source AND x.principal = acl.principal)""")
def reader_widening(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    acl = t("customer").select(F.col("c_nationkey").alias("vault"), F.col("c_mktsegment").alias("principal")).union(t("supplier").where("s_suppkey % 2 = 0").select("s_nationkey", F.lit("supplier"))).distinct()
    pairs = t("nation").select(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") + 1).alias("target")).join(t("nation").select(F.col("n_nationkey").alias("target")), "target", "left_semi")
    return membership.wider_readers(acl, acl, pairs)


@query("SELECT user_id AS peer, event_type AS alpn, count(*) AS connections, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END, {'a': ts, 'b': event_id}) AS last_direction FROM events GROUP BY ALL")
def peer_stats(spark, sf):
    e = fx.table(spark, sf, "events")
    return membership.peer_stats(e.select(F.col("user_id").alias("peer"), F.col("event_type").alias("alpn"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "in").otherwise("out").alias("direction")))


@query("""WITH w AS (SELECT l_orderkey AS write, count(*) FILTER (l_returnflag <> 'R') AS oks, count(*) AS replicas FROM lineitem GROUP BY 1) SELECT write, oks, replicas, oks = replicas AS "all", oks >= 1 AS "any", oks >= 3 AS quorum FROM w""")
def quorum_outcome(spark, sf):
    writes = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("write"), (F.col("l_returnflag") != "R").alias("ok"))
    return membership.quorum(writes, 3)


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events")
def counter_delta(spark, sf):
    return membership.counter_delta(fx.table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", "event_id")


@query("""WITH s AS (SELECT c_name AS name FROM customer WHERE c_custkey % 2 = 0), p AS (SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN 'down' ELSE 'up' END AS state FROM customer WHERE c_custkey % 3 = 0)
    SELECT name, s.name IS NOT NULL AS configured, coalesce(state, 'unknown') AS state FROM s FULL JOIN p USING (name)""")
def health_rollup(spark, sf):
    c = fx.table(spark, sf, "customer").withColumnRenamed("c_name", "name")
    return membership.health(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").select("name", F.when(F.col("c_acctbal") < 0, "down").otherwise("up").alias("state")))


@query("SELECT 'k' || (c_custkey % 97) AS key, arg_min('did:' || c_custkey, c_custkey) AS did FROM customer GROUP BY 1")
def bundle_fold(spark, sf):
    c = fx.table(spark, sf, "customer")
    return membership.first_wins(c.select(F.concat(F.lit("k"), (F.col("c_custkey") % 97).cast("string")).alias("key"), F.concat(F.lit("did:"), F.col("c_custkey").cast("string")).alias("did"), F.col("c_custkey").alias("place")))


# ingest

_SCAN = """prev AS (SELECT 'f' || p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN 'dir' ELSE 'file' END AS kind, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey * 3 END AS mtime, p_partkey AS inode FROM part WHERE p_partkey % 9 <> 0),
cur AS (SELECT 'f' || p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN 'dir' ELSE 'file' END AS kind, CAST(p_size + CASE WHEN p_partkey % 14 = 0 OR p_partkey % 10 = 1 THEN 1 ELSE 0 END AS BIGINT) AS size,
    CASE WHEN p_partkey % 22 <> 0 AND p_partkey % 11 <> 5 THEN p_partkey * 3 END AS mtime, p_partkey + CASE WHEN p_partkey % 13 = 2 THEN 1 ELSE 0 END AS inode FROM part WHERE p_partkey % 8 <> 0)"""


def _scans(spark, sf):
    p = fx.table(spark, sf, "part")
    key, kind = F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_partkey") % 7 == 0, "dir").otherwise("file").alias("kind")
    size, time = F.col("p_size").cast("long"), F.col("p_partkey") * 3
    prev = p.where("p_partkey % 9 <> 0").select(key, kind, size.alias("size"), F.when(F.expr("p_partkey % 11 <> 0"), time).alias("mtime"), F.col("p_partkey").alias("inode"))
    grown = F.when(F.expr("p_partkey % 14 = 0 or p_partkey % 10 = 1"), 1).otherwise(0)
    cur = p.where("p_partkey % 8 <> 0").select(key, kind, (size + grown).alias("size"), F.when(F.expr("p_partkey % 22 <> 0 and p_partkey % 11 <> 5"), time).alias("mtime"), (F.col("p_partkey") + F.when(F.expr("p_partkey % 13 = 2"), 1).otherwise(0)).alias("inode"))
    return cur, prev


@query(f"""WITH {_SCAN}, j AS (SELECT c.key, CASE WHEN p.key IS NULL THEN 'new' WHEN c.kind = 'file' AND c.size IS DISTINCT FROM p.size THEN 'size' WHEN c.mtime IS DISTINCT FROM p.mtime THEN 'mtime'
    WHEN c.inode IS DISTINCT FROM p.inode THEN 'inode' END AS reason FROM cur c LEFT JOIN prev p USING (key)) SELECT * FROM j WHERE reason IS NOT NULL""")
def change_detect(spark, sf):
    return ingest.changes(*_scans(spark, sf))


@query(f"WITH {_SCAN} SELECT key FROM prev WHERE key NOT IN (SELECT key FROM cur)")
def mirror_deletes(spark, sf):
    cur, prev = _scans(spark, sf)
    return ingest.mirror_deletes(prev, cur, enabled=True)


@query(f"WITH {fx.FILES} SELECT key, CASE WHEN regexp_matches(key, '^en/.*/[^/]*5\\.txt$') THEN 'five' WHEN regexp_matches(key, '^[^/]*/src1[^/]/.*$') THEN 'teens' WHEN regexp_matches(key, '^de/.*$') THEN 'german' ELSE 'default' END AS route FROM files")
def route_first_match(spark, sf):
    routes = [("en/**/*5.txt", "five"), ("*/src1?/**", "teens"), ("de/**", "german")]
    return fx.files(spark, sf).select("key", ingest.route(F.col("key"), routes, "default").alias("route"))


@query(r"""SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1) || '/' || regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2) ||
    CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) = '' THEN '/' ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) END AS key FROM pages""")
def url_key(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", ingest.url_key(F.col("url")).alias("key"))


_LINKS = f"""links AS (SELECT DISTINCT page_id, url, link FROM (SELECT page_id, url, regexp_replace(link, '^["'']|["'']$', '', 'g') AS link
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {_sql(ingest.HREF)}, 1)) AS link FROM pages)) WHERE link <> '' AND substr(link, 1, 1) NOT IN ('?', '#', '.'))"""


@query(f"WITH {_LINKS} SELECT DISTINCT page_id, link FROM links")
def page_links(spark, sf):
    return ingest.page_links(fx.table(spark, sf, "pages"))


@query(rf"""WITH {_LINKS}, u AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)', 0) AS host, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) AS scheme,
        regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)([^?#]*)', 3) AS path FROM links),
    t AS (SELECT page_id, url, host, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN scheme || link WHEN starts_with(link, '/') THEN host || link
        ELSE host || '/' || regexp_replace(regexp_replace(path, '^/', ''), '[^/]*$', '') || link END AS target FROM u)
    SELECT DISTINCT page_id, target FROM t WHERE starts_with(target, host || '/') AND target <> url""")
def linked_pages(spark, sf):
    """The pages of its own host that each page links to."""
    return ingest.linked_pages(fx.table(spark, sf, "pages"), F.concat(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0), F.lit("/")))


@query("""SELECT url, CASE WHEN page_id % 5 = 0 THEN 'new' WHEN page_id % 3 = 0 OR page_id % 7 = 0 THEN 'changed' ELSE 'same' END AS action FROM pages""")
def http_refetch(spark, sf):
    """Pages are known by their id and URL: several may share a URL, and each is asked for."""
    p = fx.table(spark, sf, "pages").withColumn("length", F.length(F.coalesce("html", F.lit(""))).cast("long"))
    seen = p.where("coalesce(page_id % 5 <> 0, true)").select("page_id", "url", "length", F.col("page_id").alias("modified"))
    now = p.select("page_id", "url", (F.col("length") + F.when(F.expr("page_id % 3 = 0"), 1).otherwise(0)).alias("length"), F.when(F.expr("page_id % 7 <> 0"), F.col("page_id")).alias("modified"))
    return ingest.http_state(now, seen, ("page_id", "url"))


@query(f"""WITH {fx.FILES}, cur AS (SELECT key AS path, size, CASE WHEN doc_id % 6 = 1 THEN doc_id + 1 ELSE doc_id END AS mtime FROM files WHERE doc_id % 4 <> 0)
    SELECT f.hash, min(f.key) AS path FROM files f JOIN cur ON cur.path = f.key AND cur.size = f.size AND cur.mtime = f.doc_id GROUP BY f.hash""")
def fresh_path(spark, sf):
    f = fx.files(spark, sf)
    now = f.where("doc_id % 4 <> 0").select(F.col("key").alias("path"), "size", F.when(F.expr("doc_id % 6 = 1"), F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("mtime"))
    return ingest.fresh_path(f.select("hash", F.col("key").alias("path"), "size", F.col("doc_id").alias("mtime")), now)


@query(f"WITH {fx.FILES} SELECT CASE WHEN doc_id % 3 = 0 THEN 'reference' ELSE 'copy' END AS mode, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE lang = 'en' GROUP BY 1")
def store_migration(spark, sf):
    f = fx.files(spark, sf).select(F.col("lang").alias("store"), "size", F.when(F.expr("doc_id % 3 = 0"), "disk").otherwise("cloud").alias("substrate"))
    return store.migration(f, "en", "disk")


# scalar functions


@query(f"""WITH {fx.FILES}, n AS (SELECT hash, rtrim(replace(replace(to_base64(unhex(hash)), '+', '-'), '/', '_'), '=') AS b FROM files)
    SELECT DISTINCT hash, 'blob3/' || substr(b, 1, 2) || '/' || substr(b, 3, 2) || '/' || substr(b, 5) AS path, hash AS back FROM n""")
def blob_path(spark, sf):
    h = fx.files(spark, sf).select("hash").distinct().withColumn("path", scalars.blob_path(F.col("hash")))
    return h.withColumn("back", scalars.hash_of_path(F.col("path")))


@query("SELECT DISTINCT p_brand AS name, 'file' AS kind, p_brand AS back_name, 'file' AS back_kind FROM part")
def cursor_roundtrip(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.lit("file").alias("kind")).distinct()
    back = p.withColumn("c", scalars.cursor_fields(scalars.cursor(F.col("name"), F.col("kind"))))
    return back.select("name", "kind", F.col("c.position").alias("back_name"), F.col("c.kind").alias("back_kind"))


_SPANS = "t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || 's' WHEN 1 THEN ' ' || p_size || 'm ' WHEN 2 THEN p_size || 'h' WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN p_size || 'd' ELSE '' END AS span, p_size FROM part)"


@query(f"WITH {_SPANS} SELECT p_partkey, span, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 60 WHEN 2 THEN p_size * 3600 WHEN 3 THEN p_size END AS BIGINT) AS seconds FROM t")
def duration_parse(spark, sf):
    p = fx.table(spark, sf, "part")
    n = F.col("p_size").cast("string")
    span = F.expr("p_partkey % 6")
    text = F.when(span == 0, F.concat(n, F.lit("s"))).when(span == 1, F.concat(F.lit(" "), n, F.lit("m "))).when(span == 2, F.concat(n, F.lit("h"))).when(span == 3, n).when(span == 4, F.concat(n, F.lit("d"))).otherwise("")
    return p.select("p_partkey", text.alias("span")).withColumn("seconds", scalars.seconds(F.col("span")))


_REFS = [("photos:", "vault", "photos", None, None), ("photos:a/b#2", "vault", "photos", "a/b", "2"), ("photos:#abc", "vault", "photos", None, "abc"), ("#deadbeef", "hash", None, None, "deadbeef"), ("#", "invalid", None, None, None), ("", "invalid", None, None, None),
         ("./x:y", "local", None, "./x:y", None), ("C:\\dir", "local", None, "C:\\dir", None), ("/a#b", "local", None, "/a#b", None), ("plain#name", "local", None, "plain#name", None), ("Bad Name:x", "invalid", None, None, None), ("x:y", "local", None, "x:y", None)]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in _REFS) + ") AS t(ref, kind, name, path, snap)")
def ref_parse(spark, sf):
    return spark.createDataFrame([(r[0],) for r in _REFS], "ref string").select("ref", scalars.reference(F.col("ref")).alias("r")).select("ref", "r.*")


@query(f"WITH {fx.FILES} SELECT key, size, CAST(ceil(size / 4096.0) * 4096 AS BIGINT) AS padded, CAST(ceil(size / 4096.0) AS BIGINT) AS blocks, size AS unpadded, ceil(size * 0.99 / 4096) >= ceil(size / 4096.0) AS plain FROM files")
def padded_sizes(spark, sf):
    f = fx.files(spark, sf)
    size = F.col("size")
    return f.select("key", "size", scalars.padded(size, 4096).alias("padded"), scalars.stored_blocks(size, 4096).alias("blocks"), scalars.padded(size, 1).alias("unpadded"), scalars.stored_plain(size, size * 0.99, 4096).alias("plain"))


@query(f"""WITH {fx.FILES}, x AS (SELECT DISTINCT hash, size, printf('%016X', size) AS h FROM files)
    SELECT hash, size, lower('5B821E' || hash || regexp_replace(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2), '(00)+$', '')) AS id, size AS back FROM x""")
def blob_id_roundtrip(spark, sf):
    f = fx.files(spark, sf).select("hash", "size").distinct().withColumn("id", scalars.blob_id(F.col("hash"), F.col("size")))
    return f.withColumn("back", scalars.blob_id_size(F.col("id")))


@query(f"WITH {fx.FILES} SELECT DISTINCT hash, 'f' || hash AS b16, rtrim(replace(replace(to_base64(unhex(hash)), '+', '-'), '/', '_'), '=') AS b64 FROM files")
def multibase(spark, sf):
    data = F.unhex("hash")
    return fx.files(spark, sf).select("hash", scalars.base16(data).alias("b16"), scalars.base64url(data).alias("b64")).distinct()


@query("SELECT p_partkey, CAST(p_partkey & ~3072 AS BIGINT) AS mode, CASE WHEN p_partkey % 4 = 0 THEN 'absolute' WHEN p_partkey % 4 = 1 THEN 'parent' END AS error FROM part")
def mode_and_key_checks(spark, sf):
    key = F.when(F.expr("p_partkey % 4 = 0"), "/a").when(F.expr("p_partkey % 4 = 1"), "a/../b").otherwise("a/..b")
    return fx.table(spark, sf, "part").select("p_partkey", scalars.without_setid(F.col("p_partkey")).alias("mode"), scalars.key_error(key).alias("error"))


@query(f"WITH {fx.FILES} SELECT key, hash, true AS ok FROM files")
def encode_roundtrip(spark, sf):
    """Texts packed with zstd, padded to whole blocks and unpacked again."""
    f = fx.files(spark, sf).withColumn("frame", scalars.compressed(F.col("text").cast("binary")))
    pad = F.unhex(F.repeat(F.lit("00"), (scalars.padded(F.octet_length("frame"), 512) - F.octet_length("frame")).cast("int")))
    back = scalars.decompressed(F.concat("frame", pad))
    return f.select("key", "hash", (F.sha2(back, 256) == F.col("hash")).alias("ok"))
