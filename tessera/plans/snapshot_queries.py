"""Registry, layers, convergence, listings and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import history, layers, listing, registry

from . import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {fx.REGISTRY_LOG} SELECT stream_key, revision, hash, seq FROM log QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY revision DESC, hash, seq) = 1")
def registry_head_reconciled(spark, sf):
    return registry.head_reconciled(fx.registry_log(spark, sf))


@query(f"WITH {fx.REGISTRY_LOG} SELECT stream_key, revision, hash, seq FROM log QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY revision DESC, seq) = 1")
def registry_head_arrival(spark, sf):
    return registry.head_by_arrival(fx.registry_log(spark, sf))


@query(f"WITH {fx.REGISTRY_LOG} SELECT * FROM log WHERE type = 'Stream'")
def registry_log_full(spark, sf):
    return registry.stream_log(fx.registry_log(spark, sf))


@query(f"""WITH {fx.REGISTRY_LOG}, h AS (SELECT *, arg_max({{'r': revision, 'h': hash}}, {{'r': revision, 's': -seq}}) OVER (PARTITION BY stream_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM log)
    SELECT stream_key, seq, revision, held.r AS held_revision, held IS NULL OR revision > held.r OR (revision = held.r AND hash = held.h) AS accepted FROM h""")
def registry_write_decision(spark, sf):
    return registry.write_decisions(fx.registry_log(spark, sf))


@query(f"""WITH {fx.REGISTRY_LOG}, b AS (SELECT 0 AS backend, * FROM log WHERE stream_key % 3 = 0 UNION ALL SELECT 1, * FROM log WHERE stream_key % 2 = 0 UNION ALL SELECT 2, * FROM log),
    h AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY backend, stream_key ORDER BY revision DESC, hash, seq) = 1)
    SELECT stream_key, CAST(backend AS BIGINT) AS backend, revision, hash FROM h QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY backend) = 1""")
def registry_multi_read(spark, sf):
    log = fx.registry_log(spark, sf)
    return registry.multi_registry_get([registry.head_reconciled(log.where(c)).select("stream_key", "revision", "hash") for c in ("stream_key % 3 = 0", "stream_key % 2 = 0", "true")])


@query(f"""WITH {fx.REGISTRY_LOG}, h AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY revision DESC, hash, seq) = 1)
    SELECT DISTINCT c_mktsegment AS reader, stream_key, revision, hash FROM customer JOIN h ON stream_key = c_custkey""")
def registry_subscribe_replay(spark, sf):
    readers = fx.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("reader"), F.col("c_custkey").alias("stream_key")).distinct()
    return registry.subscribe_replay(fx.registry_log(spark, sf), readers)


_RAW = """raw AS (SELECT key, CASE WHEN c.key IS NOT NULL THEN c.hash ELSE b.hash END AS hash, CASE WHEN c.key IS NOT NULL THEN c.size ELSE b.size END AS size,
    coalesce(c.is_tombstone, false) AS is_tombstone FROM base b FULL JOIN changes c USING (key))"""


@query(f"WITH {fx.LAYERS}, {_RAW} SELECT * FROM raw")
def merge2_scan_raw(spark, sf):
    return layers.overlay_scan(fx.base(spark, sf), fx.changes(spark, sf))


@query(f"WITH {fx.LAYERS}, {_RAW} SELECT key, hash, size FROM raw WHERE NOT is_tombstone")
def merge2_scan_live(spark, sf):
    return layers.merge(fx.base(spark, sf), fx.changes(spark, sf))


@query(f"""WITH {fx.LAYERS} SELECT count(*) FILTER (WHERE c.key IS NULL OR NOT c.is_tombstone) AS entries, count(*) FILTER (WHERE c.key IS NULL) AS reused,
    count(*) FILTER (WHERE NOT c.is_tombstone) AS changed, count(*) FILTER (WHERE c.is_tombstone) AS tombstones_filtered,
    CAST(sum(CASE WHEN c.key IS NULL THEN b.size WHEN NOT c.is_tombstone THEN c.size END) AS BIGINT) AS bytes FROM base b FULL JOIN changes c USING (key)""")
def merge_stats(spark, sf):
    return layers.merge_stats(fx.base(spark, sf), fx.changes(spark, sf))


def _three(spark, sf):
    entry = ["key", "hash", "size", "is_tombstone"]
    top = fx.changes(spark, sf, "top").where("key like '%7'")
    return [top, fx.changes(spark, sf), fx.base(spark, sf).select(*entry)]


_THREE = """stack AS (SELECT key, CASE WHEN key LIKE 'new/%' OR is_tombstone THEN hash ELSE sha256('top' || b_hash) END AS hash, size, is_tombstone, 0 AS priority FROM (
        SELECT c.*, b.hash AS b_hash FROM changes c LEFT JOIN base b USING (key)) WHERE key LIKE '%7'
    UNION ALL SELECT key, hash, size, is_tombstone, 1 FROM changes UNION ALL SELECT key, hash, size, is_tombstone, 2 FROM base),
won AS (SELECT key, hash, size, is_tombstone, CAST(priority AS BIGINT) AS priority FROM stack QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority) = 1)"""


@query(f"WITH {fx.LAYERS}, {_THREE} SELECT * FROM won")
def mergek_priority(spark, sf):
    return layers.merged_view(_three(spark, sf))


@query(f"""WITH {fx.LAYERS}, {_THREE}, asked AS (SELECT key FROM base UNION SELECT key FROM changes UNION SELECT 'absent/' || key FROM base WHERE o_orderkey % 100 = 0)
    SELECT key, hash, size, priority FROM won WHERE NOT is_tombstone AND key IN (SELECT key FROM asked)""")
def layered_point_get(spark, sf):
    """Every key of the layers asked for, and some absent ones."""
    b = fx.base(spark, sf)
    absent = b.where("o_orderkey % 100 = 0").select(F.concat(F.lit("absent/"), "key").alias("key"))
    return layers.get_live(_three(spark, sf), b.select("key").union(fx.changes(spark, sf).select("key")).union(absent).distinct())


@query(f"""WITH {fx.LAYERS}, pub AS (SELECT key, hash, size FROM base WHERE o_orderkey % 3 <> 0), loc AS (SELECT key, sha256('l' || hash) AS hash, size FROM base WHERE o_orderkey % 2 = 0)
    SELECT key, CASE WHEN l.key IS NOT NULL THEN l.hash ELSE p.hash END AS hash, coalesce(l.size, p.size) AS size, CASE WHEN l.key IS NOT NULL THEN 'local' ELSE 'published' END AS side FROM loc l FULL JOIN pub p USING (key)""")
def convergence_union(spark, sf):
    b = fx.base(spark, sf)
    local = b.where("o_orderkey % 2 = 0").withColumn("hash", F.sha2(F.concat(F.lit("l"), "hash"), 256))
    return layers.union_local_wins(local, b.where("o_orderkey % 3 <> 0"))


def _lww(spark, sf):
    p = fx.table(spark, sf, "part").withColumn("name", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    kind = lambda c: F.when(c, "dir").otherwise("file").alias("kind")
    local = p.where("p_partkey % 5 <> 0").select("name", kind(F.col("p_partkey") % 7 == 0), F.sha2(F.concat(F.lit("l"), "name"), 256).alias("hash"), F.col("p_size").cast("long").alias("ts_s"), F.when(F.col("p_partkey") % 2 == 0, F.lit(5).cast("long")).alias("ts_ns"))
    remote = p.where("p_partkey % 4 <> 0").select("name", kind(F.col("p_partkey") % 6 == 0), F.sha2(F.concat(F.lit("r"), "name"), 256).alias("hash"), (F.col("p_partkey") % 50).alias("ts_s"), F.lit(None).cast("long").alias("ts_ns"))
    return local, remote


_LWW = """p AS (SELECT 'p' || p_partkey AS name, * FROM part),
loc AS (SELECT name, CASE WHEN p_partkey % 7 = 0 THEN 'dir' ELSE 'file' END AS kind, sha256('l' || name) AS hash, CAST(p_size AS BIGINT) * 1000000000 + CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END AS ts FROM p WHERE p_partkey % 5 <> 0),
rem AS (SELECT name, CASE WHEN p_partkey % 6 = 0 THEN 'dir' ELSE 'file' END AS kind, sha256('r' || name) AS hash, (p_partkey % 50) * 1000000000 AS ts FROM p WHERE p_partkey % 4 <> 0)"""


@query(f"""WITH {_LWW} SELECT name, CASE WHEN l.name IS NULL OR r.ts > l.ts THEN r.hash ELSE l.hash END AS hash, CASE WHEN l.name IS NULL OR r.ts > l.ts THEN r.ts ELSE l.ts END AS ts,
    CASE WHEN l.name IS NULL OR r.ts > l.ts THEN 'remote' ELSE 'local' END AS side FROM loc l FULL JOIN rem r USING (name)""")
def lww_merge(spark, sf):
    return layers.lww_merge(*_lww(spark, sf))


@query(f"""WITH {_LWW}, a AS (SELECT name, CASE WHEN l.name IS NULL OR r.ts > l.ts THEN {{'kind': r.kind, 'hash': r.hash, 'ts': r.ts}} ELSE {{'kind': l.kind, 'hash': l.hash, 'ts': l.ts}} END AS e
        FROM loc l FULL JOIN (SELECT * FROM rem WHERE kind = 'dir') r USING (name)),
    b AS (SELECT name, CASE WHEN a.e IS NULL OR r.ts > a.e.ts THEN {{'kind': r.kind, 'hash': r.hash, 'ts': r.ts}} ELSE a.e END AS e FROM a FULL JOIN (SELECT * FROM rem WHERE kind = 'file') r USING (name))
    SELECT name, e.kind AS kind, e.hash AS hash, e.ts AS ts FROM b""")
def lww_kind_conflict(spark, sf):
    return layers.lww_kinds(*_lww(spark, sf))


_LEAVES = """cut AS (SELECT key, hash, CAST(('0x' || sha256(key)[1:15]) AS BIGINT) % (SELECT CAST(greatest(64, pow(2, ceil(log2(count(*) / 256.0)))) AS BIGINT) FROM base) AS leaf_id, o_orderkey FROM base),
bl AS (SELECT leaf_id, sha256(string_agg(key || '=' || hash, chr(10) ORDER BY key)) AS leaf_hash FROM cut GROUP BY leaf_id),
upd AS (SELECT key, CASE WHEN o_orderkey % 997 = 3 THEN sha256('u' || hash) ELSE hash END AS hash, leaf_id FROM cut),
ul AS (SELECT leaf_id, sha256(string_agg(key || '=' || hash, chr(10) ORDER BY key)) AS leaf_hash FROM upd GROUP BY leaf_id)"""


def _updated(spark, sf):
    b = fx.base(spark, sf)
    changed = b.withColumn("hash", F.when(F.col("o_orderkey") % 997 == 3, F.sha2(F.concat(F.lit("u"), "hash"), 256)).otherwise(F.col("hash")))
    n = layers.leaf_count(b, changed)
    return layers.leaves(b.select("key", "hash"), n), layers.leaves(changed.select("key", "hash"), n)


@query(f"WITH {fx.LAYERS}, {_LEAVES} SELECT u.key, u.hash, u.leaf_id FROM upd u JOIN ul USING (leaf_id) WHERE ul.leaf_hash NOT IN (SELECT leaf_hash FROM bl)")
def leaf_diff_antijoin(spark, sf):
    base, changed = _updated(spark, sf)
    return layers.leaf_diff(changed, base).select("key", "hash", "leaf_id")


@query(f"WITH {fx.LAYERS}, {_LEAVES} SELECT count(*) AS differing FROM ((SELECT key, hash FROM upd EXCEPT ALL SELECT key, hash FROM upd) UNION ALL (SELECT key, hash FROM upd EXCEPT ALL SELECT key, hash FROM upd))")
def treediff_equals_full(spark, sf):
    """The base overlaid with the leaf diff is the full new state."""
    base, changed = _updated(spark, sf)
    state = lambda d: d.select("key", "hash", F.lit(0).cast("long").alias("size"))
    merged = layers.union_local_wins(state(layers.leaf_diff(changed, base)), state(base)).select("key", "hash")
    full = changed.select("key", "hash")
    return merged.exceptAll(full).unionAll(full.exceptAll(merged)).agg(F.count("*").alias("differing"))


@query(f"""WITH {fx.LAYERS}, firsts AS (SELECT key AS first_key, o_orderkey AS leaf_id FROM base WHERE o_orderkey % 53 = 0), c AS (SELECT key FROM changes),
    f AS (SELECT c.key, l.leaf_id FROM c ASOF JOIN firsts l ON c.key >= l.first_key) SELECT leaf_id, count(*) AS changes FROM f GROUP BY leaf_id""")
def affected_leaves(spark, sf):
    marks = fx.base(spark, sf).where("o_orderkey % 53 = 0").select(F.col("key").alias("first_key"), F.col("o_orderkey").alias("leaf_id"))
    return layers.affected_leaves(marks, fx.changes(spark, sf))


@query(f"""WITH {fx.LAYERS}, moved AS (SELECT 'archive/' || substr(key, 4) AS key, hash, size FROM base WHERE starts_with(key, 'c1/')), rest AS (SELECT key, hash, size FROM base WHERE key LIKE 'c2/%')
    SELECT * FROM moved UNION ALL SELECT * FROM rest""")
def reroot_copy(spark, sf):
    b = fx.base(spark, sf).select("key", "hash", "size")
    return layers.union_local_wins(layers.reroot(b, "c1", "archive"), b.where("key like 'c2/%'")).drop("side")


@query("""SELECT 'p' || a.p_partkey AS key, coalesce(CASE WHEN a.p_partkey % 2 = 0 THEN a.p_brand END, a.p_type) AS media, coalesce(CASE WHEN a.p_partkey % 3 = 0 THEN CAST(a.p_size AS BIGINT) END, a.p_partkey) AS mode FROM part a""")
def semantic_merge(spark, sf):
    p = fx.table(spark, sf, "part").withColumn("key", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    old = p.select("key", F.col("p_type").alias("media"), F.col("p_partkey").alias("mode"))
    new = p.select("key", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("media"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("long")).alias("mode"))
    return layers.semantic_merge(old, new, ["media", "mode"])


@query(f"WITH {fx.FILES} SELECT substr(key, 4) AS path, false AS is_dir, size FROM files WHERE starts_with(key, 'en/') AND len(string_split(substr(key, 4), '/')) <= 2")
def tree_list_subtree(spark, sf):
    return listing.tree(fx.files(spark, sf), "en", 2)


@query(f"WITH {fx.FILES} SELECT split_part(substr(key, 4), '/', 1) AS name, contains(substr(key, 4), '/') AS is_dir, count(*) AS entries FROM files WHERE starts_with(key, 'en/') GROUP BY 1, 2")
def list_children(spark, sf):
    return listing.children(fx.files(spark, sf), "en")


@query(f"""WITH {fx.FILES}, e AS (SELECT key, doc_id % 13 = 0 AS is_tombstone FROM files), asked AS (SELECT key AS path FROM files UNION SELECT DISTINCT lang FROM files UNION SELECT DISTINCT lang || '/' || source FROM files UNION SELECT 'en/sr' UNION SELECT 'zz')
    SELECT path, CASE WHEN e.key IS NOT NULL AND NOT e.is_tombstone THEN 'file' WHEN path IN (SELECT lang FROM files UNION SELECT lang || '/' || source FROM files) THEN 'directory' WHEN e.key IS NOT NULL THEN 'tombstone' ELSE 'missing' END AS kind
    FROM asked LEFT JOIN e ON e.key = path""")
def resolve_kind(spark, sf):
    f = fx.files(spark, sf)
    entries = f.select("key", (F.col("doc_id") % 13 == 0).alias("is_tombstone"))
    path = lambda d, c: d.select(c.alias("path"))
    asked = path(f, F.col("key")).union(path(f, F.col("lang"))).union(path(f, F.concat_ws("/", "lang", "source"))).union(spark.createDataFrame([("en/sr",), ("zz",)], "path string"))
    return listing.resolve(entries, asked.distinct())


_NAMES = "names AS (SELECT p_brand AS name, 'dir' AS kind FROM part WHERE p_size > 25 UNION SELECT p_brand, 'file' FROM part WHERE p_size <= 25)"


@query(f"WITH {_NAMES} SELECT name, kind FROM names WHERE (name, CASE kind WHEN 'dir' THEN 0 ELSE 1 END) > ('Brand#12', 0) ORDER BY name, kind LIMIT 7")
def keyset_page(spark, sf):
    p = fx.table(spark, sf, "part")
    names = p.select(F.col("p_brand").alias("name"), F.when(F.col("p_size") > 25, "dir").otherwise("file").alias("kind")).distinct()
    return listing.keyset_page(names, ("Brand#12", "dir"), 7)


@query(f"WITH {fx.LAYERS} SELECT key, hash, size FROM base WHERE key >= 'c1' AND key < 'c3'")
def range_scan(spark, sf):
    return listing.key_range(fx.base(spark, sf).select("key", "hash", "size"), "c1", "c3")


@query(f"WITH {fx.FILES} SELECT regexp_extract(key, '^(.*)/[^/]*$', 1) AS prefix, count(*) AS files FROM files GROUP BY 1 HAVING count(*) > 10")
def prefix_promotion(spark, sf):
    return listing.prefix_promotion(fx.files(spark, sf))


@query(f"WITH {fx.SNAPSHOTS} SELECT vault, ts, hash, row_number() OVER (PARTITION BY vault ORDER BY ts, hash) AS revision FROM snapshots")
def history_ranked(spark, sf):
    return history.ranked(fx.snapshots(spark, sf))


@query(f"WITH {fx.SNAPSHOTS}, s AS (SELECT * FROM snapshots UNION ALL SELECT DISTINCT vault, '', vault FROM snapshots) SELECT * FROM s WHERE ts = '' UNION ALL (SELECT * FROM s WHERE ts <> '' QUALIFY row_number() OVER (PARTITION BY vault ORDER BY ts DESC, hash DESC) <= 3)")
def history_keep_n(spark, sf):
    s = fx.snapshots(spark, sf)
    return history.keep_last(s.unionByName(s.select("vault", F.lit("").alias("ts"), F.col("vault").alias("hash")).distinct()), 3)


_SELECT = """r AS (SELECT *, row_number() OVER (PARTITION BY vault ORDER BY ts, hash) AS revision, count(*) OVER (PARTITION BY vault) AS total FROM snapshots),
asked AS (SELECT DISTINCT vault, {selector} AS selector FROM snapshots),
m AS (SELECT a.vault, a.selector, r.hash, r.revision, CASE WHEN regexp_full_match(trim(a.selector), '[0-9]{{1,9}}') AND CAST(trim(a.selector) AS BIGINT) BETWEEN 1 AND r.total THEN CASE WHEN CAST(trim(a.selector) AS BIGINT) = r.revision THEN 1 END
    END AS num, r.ts = trim(a.selector) AS is_ts, starts_with(r.hash, lower(trim(a.selector))) AS is_hash FROM asked a JOIN r USING (vault)),
k AS (SELECT *, CASE WHEN num = 1 THEN 1 WHEN is_ts THEN 2 WHEN is_hash THEN 3 END AS kind FROM m),
g AS (SELECT vault, selector, min(kind) AS kind, arg_min(hash, kind * 100000 + revision) AS found, count(*) FILTER (WHERE kind = 3) AS n FROM k GROUP BY vault, selector)
SELECT vault, selector, CASE WHEN kind = 1 THEN 'revision' WHEN kind = 2 THEN 'timestamp' WHEN kind = 3 AND n = 1 THEN 'hash' WHEN kind = 3 THEN 'ambiguous' ELSE 'missing' END AS outcome,
    CASE WHEN kind < 3 OR (kind = 3 AND n = 1) THEN found END AS hash FROM g"""


def _selected(spark, sf, selector):
    s = fx.snapshots(spark, sf)
    return history.select(s, s.select("vault", selector.alias("selector")).distinct())


@query(f"WITH {fx.SNAPSHOTS}, {_SELECT.format(selector=chr(39) + ' 2 ' + chr(39))}")
def select_by_revision(spark, sf):
    return _selected(spark, sf, F.lit(" 2 "))


@query(f"WITH {fx.SNAPSHOTS}, {_SELECT.format(selector=chr(39) + '2024-01-03' + chr(39))}")
def select_by_timestamp(spark, sf):
    return _selected(spark, sf, F.lit("2024-01-03"))


@query(f"WITH {fx.SNAPSHOTS}, {_SELECT.format(selector='upper(substr(hash, 1, 1))')}")
def select_by_prefix(spark, sf):
    return _selected(spark, sf, F.upper(F.substring("hash", 1, 1)))


@query("SELECT DISTINCT 'k' || conv_id AS key, sha256(text) AS hash FROM conversations WHERE NOT (turn % 4 = 3)")
def version_chain_hashes(spark, sf):
    c = fx.table(spark, sf, "conversations")
    return history.version_chain(c.select(F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("key"), F.sha2("text", 256).alias("hash"), (F.col("turn") % 4 == 3).alias("is_tombstone")))
