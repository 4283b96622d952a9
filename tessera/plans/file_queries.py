"""File-system interface, tree levels, snapshots, feeds and scheduled passes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import layers, objects, packing, registry, vault
from tessera.sources import store
from tessera.sources.staging import shared_folder, staged
from tessera.streaming import feeds, streams

from . import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# point reads

#: every key of both layers, and as many that neither has
_KEYS = "asked AS (SELECT key FROM base UNION SELECT key FROM changes UNION ALL SELECT 'none/' || key FROM base)"
_TOP = "top AS (SELECT key, hash, size, is_tombstone FROM changes UNION ALL SELECT key, hash, size, false FROM base WHERE key NOT IN (SELECT key FROM changes))"


def _layers(spark, sf):
    return [fx.changes(spark, sf), fx.base(spark, sf).select("key", "hash", "size", "is_tombstone")]


def _asked(spark, sf):
    c, b = (d.select("key") for d in _layers(spark, sf))
    return c.union(b).distinct().unionAll(b.select(F.concat(F.lit("none/"), "key").alias("key")))


@query(f"WITH {fx.LAYERS}, {_KEYS}, {_TOP} SELECT key, hash, size, is_tombstone FROM asked JOIN top USING (key)")
def get_raw(spark, sf):
    """Every key of two layers, with tombstones visible."""
    return layers.get_raw(_layers(spark, sf), _asked(spark, sf)).select("key", "hash", "size", "is_tombstone")


@query(f"WITH {fx.LAYERS}, {_KEYS}, {_TOP} SELECT key, hash, size FROM asked JOIN top USING (key) WHERE NOT is_tombstone")
def file_get(spark, sf):
    """Every key of two layers; a tombstone hides what is below it."""
    return layers.get_live(_layers(spark, sf), _asked(spark, sf)).select("key", "hash", "size")


@query(f"WITH {fx.LAYERS}, {_KEYS}, {_TOP} SELECT a.key, coalesce(NOT is_tombstone, false) AS found FROM asked a LEFT JOIN top USING (key)")
def file_exists(spark, sf):
    asked = _asked(spark, sf)
    return objects.contains(asked, layers.get_live(_layers(spark, sf), asked))


@query(f"WITH {fx.LAYERS} SELECT key, coalesce(c.size, b.size) AS size, c.key IS NOT NULL AS pending FROM base b FULL JOIN (SELECT * FROM changes WHERE NOT is_tombstone) c USING (key) WHERE key NOT IN (SELECT key FROM changes WHERE is_tombstone)")
def overlay_get(spark, sf):
    """Every key from the pending layer, or else from the base."""
    pending, base = _layers(spark, sf)
    raw = layers.merged_view([pending, base]).where("not is_tombstone")
    return raw.select("key", "size", (F.col("priority") == 0).alias("pending"))


# trees


def _leaves(spark, sf):
    """The base cut into runs of 64 neighbours of one customer's range: (key, hash, size, leaf_id)."""
    b = fx.base(spark, sf)
    return b.select("key", "hash", "size", F.substring("key", 1, 3).alias("leaf_id"))


_LEAVES = fx.LAYERS + ", l AS (SELECT key, hash, size, substr(key, 1, 3) AS leaf_id FROM base), fk AS (SELECT min(key) AS first_key, max(key) AS last_key, leaf_id FROM l GROUP BY leaf_id)"


def _first_keys(spark, sf):
    return _leaves(spark, sf).groupBy("leaf_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query(f"WITH {_LEAVES}, {_KEYS}, m AS (SELECT key, NULL AS leaf_id, 1 AS side FROM asked UNION ALL SELECT first_key, leaf_id, 0 FROM fk), f AS (SELECT key, side, last_value(leaf_id IGNORE NULLS) OVER (ORDER BY key, side) AS leaf_id FROM m) SELECT key, leaf_id FROM f WHERE side = 1")
def floor_seek_entry(spark, sf):
    """The leaf in which each key belongs: that with the greatest first key not above it."""
    return layers.floor_lookup(_first_keys(spark, sf), _asked(spark, sf))


@query(f"WITH {_LEAVES} SELECT key, leaf_id FROM l WHERE key >= 'c12' AND key < 'c15/o3'")
def range_scan_pruned(spark, sf):
    """A range of keys, read from the leaves that meet it alone."""
    return layers.range_in_leaves(_leaves(spark, sf), _first_keys(spark, sf), "c12", "c15/o3").select("key", "leaf_id")


@query(f"WITH {_LEAVES} SELECT key, hash, size FROM l WHERE leaf_id = 'c12'")
def leaf_load(spark, sf):
    return _leaves(spark, sf).where("leaf_id = 'c12'").select("key", "hash", "size")


@query(f"""WITH {_LEAVES}, n AS (SELECT key, 'leaf' AS structural FROM l UNION ALL SELECT first_key || '#', 'link' FROM fk) SELECT structural, CAST(count(*) AS BIGINT) AS entries, structural = 'leaf' AS is_leaf, structural = 'link' AS is_link FROM n GROUP BY structural""")
def structural_kinds(spark, sf):
    """Entries of a tree's nodes by what they hold: contents, or links to lower nodes."""
    kind = lambda d, k, v: d.select(F.col(k).alias("key"), F.struct(F.lit(v).alias("structural")).alias("content"))
    both = kind(_leaves(spark, sf), "key", "leaf").unionAll(kind(_first_keys(spark, sf), "first_key", "link"))
    s = F.col("content.structural")
    return both.groupBy(s.alias("structural")).agg(F.count("*").alias("entries"), F.bool_and(s == "leaf").alias("is_leaf"), F.bool_and(s == "link").alias("is_link"))


def _levels(entries: str) -> str:
    """Nodes of a tree cut by content, level by level up to the first one with a single node."""
    zeros = " ".join(f"WHEN suffix(h, '{'0' * n}') THEN {n}" for n in range(12, 0, -1))
    return f"""z AS (SELECT key, size, CASE {zeros} ELSE 0 END AS z, key = min(key) OVER () AS first FROM (SELECT *, sha256(key) AS h FROM {entries})), lv AS (SELECT unnest(range(12)) AS level),
    cut AS (SELECT level, key, size, max(CASE WHEN z > level OR first THEN key END) OVER (PARTITION BY level ORDER BY key) AS first_key, z >= level OR first AS child FROM z, lv),
    nodes AS (SELECT level, first_key, count(*) FILTER (child) AS children, count(*) AS entries, CAST(sum(size) AS BIGINT) AS size FROM cut GROUP BY ALL),
    tree AS (SELECT * FROM nodes WHERE level <= (SELECT min(level) FROM (SELECT level FROM nodes GROUP BY level HAVING count(*) = 1)))"""


@query(f"WITH {fx.LAYERS}, {_levels('base')} SELECT * FROM tree")
def content_tree(spark, sf):
    """A tree whose borders are told by digests of keys, from its leaves to the root."""
    return layers.tree_levels(fx.base(spark, sf))


_MERGED = fx.LAYERS + ", merged AS (SELECT key, hash, size FROM changes WHERE NOT is_tombstone UNION ALL SELECT key, hash, size FROM base WHERE key NOT IN (SELECT key FROM changes))"


@query(f"WITH {_MERGED}, {_levels('merged')} SELECT * FROM tree")
def merge_and_build(spark, sf):
    """Two layers merged and written as a new tree."""
    return layers.tree_levels(layers.merge(fx.base(spark, sf), fx.changes(spark, sf)))


@query(f"""WITH {_MERGED}, zb AS (SELECT key, hash, suffix(sha256(key), '0') AS cut FROM base), zm AS (SELECT key, hash, suffix(sha256(key), '0') AS cut FROM merged),
    lb AS (SELECT key, hash, max(CASE WHEN cut THEN key ELSE '' END) OVER (ORDER BY key) AS first_key FROM zb), lm AS (SELECT key, hash, max(CASE WHEN cut THEN key ELSE '' END) OVER (ORDER BY key) AS first_key FROM zm),
    b AS (SELECT first_key, string_agg(key || '=' || hash, ',' ORDER BY key) AS c FROM lb GROUP BY 1), m AS (SELECT first_key, string_agg(key || '=' || hash, ',' ORDER BY key) AS c, count(*) AS n FROM lm GROUP BY 1)
    SELECT CAST(count(*) AS BIGINT) AS leaves, CAST(count(*) FILTER (b.c IS DISTINCT FROM m.c) AS BIGINT) AS rewritten, CAST(sum(n) AS BIGINT) AS entries FROM m LEFT JOIN b USING (first_key)""")
def structural_merge(spark, sf):
    """A merge that writes only the leaves that changes touch: the others are the base's own."""
    base, merged = (d.select("key", "hash") for d in (fx.base(spark, sf), layers.merge(fx.base(spark, sf), fx.changes(spark, sf))))

    def cut(entries):
        marks = entries.where(F.endswith(F.sha2("key", 256), F.lit("0"))).select(F.col("key").alias("first_key"), F.col("key").alias("leaf_id"))
        return entries.join(layers.floor_lookup(marks, entries.select("key")), "key").withColumn("leaf_id", F.coalesce("leaf_id", F.lit("")))

    def content(rows):
        # sums of digests do not depend on an order, so no leaf is collected
        digest = F.conv(F.substring(F.sha2(F.concat("key", F.lit("="), "hash"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        return rows.groupBy("leaf_id").agg(F.sum(digest).alias("digest"), F.count("*").alias("n"))

    both = content(cut(merged)).join(content(cut(base)).select("leaf_id", F.col("digest").alias("old"), F.col("n").alias("old_n")), "leaf_id", "left")
    same = F.col("digest").eqNullSafe(F.col("old")) & F.col("n").eqNullSafe(F.col("old_n"))
    return both.agg(F.count("*").alias("leaves"), F.count_if(~same).alias("rewritten"), F.sum("n").alias("entries"))


# merges

_SIDES = """l AS (SELECT p_name || p_partkey AS name, sha256('l' || p_partkey) AS hash, CAST(p_size AS BIGINT) * 1000000000 AS ts FROM part WHERE p_partkey % 5 <> 0),
r AS (SELECT p_name || p_partkey AS name, sha256('r' || p_partkey) AS hash, p_partkey % 50 * 1000000000 AS ts FROM part WHERE p_partkey % 3 <> 0)"""


@query(f"""WITH {_SIDES}, m AS (SELECT name, CASE WHEN l.name IS NULL OR r.ts > l.ts THEN r.hash ELSE l.hash END AS hash, CASE WHEN l.name IS NULL OR r.ts > l.ts THEN r.ts ELSE l.ts END AS ts, CASE WHEN l.name IS NULL OR r.ts > l.ts THEN 'remote' ELSE 'local' END AS side FROM l FULL JOIN r USING (name))
    SELECT CAST('0x' || substr(sha256(name), 1, 4) AS BIGINT) % 8 AS shard, * FROM m""")
def lww_sharded(spark, sf):
    """Last-writer-wins within eight shards."""
    p = fx.table(spark, sf, "part")
    name = F.concat("p_name", F.col("p_partkey").cast("string")).alias("name")
    side = lambda s, w, t: p.where(w).select(name, F.sha2(F.concat(F.lit(s), F.col("p_partkey").cast("string")), 256).alias("hash"), t.cast("long").alias("ts_s"), F.lit(0).alias("ts_ns"))
    return layers.sharded_lww(side("l", "p_partkey % 5 <> 0", F.col("p_size")), side("r", "p_partkey % 3 <> 0", F.col("p_partkey") % 50), 8)


@query("""SELECT c_custkey AS vault, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'remote ' || c_custkey) AS title, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 5 <> 0 THEN 'far' END) AS kind FROM customer""")
def header_merge(spark, sf):
    """Header fields that are missing here come from the remote side."""
    c = fx.table(spark, sf, "customer")
    local = c.select(F.col("c_custkey").alias("key"), F.when(F.expr("c_custkey % 2 = 0"), F.col("c_name")).alias("title"), F.when(F.expr("c_custkey % 3 = 0"), F.col("c_mktsegment")).alias("kind"))
    remote = c.select(F.col("c_custkey").alias("key"), F.concat(F.lit("remote "), F.col("c_custkey").cast("string")).alias("title"), F.when(F.expr("c_custkey % 5 <> 0"), F.lit("far")).alias("kind"))
    r = remote.select("key", F.col("title").alias("r_title"), F.col("kind").alias("r_kind"))
    return local.join(r, "key", "left").select(F.col("key").alias("vault"), F.coalesce("title", "r_title").alias("title"), F.coalesce("kind", "r_kind").alias("kind"))


@query(f"WITH {fx.FILES} SELECT 'copy/' || substr(key, 4) AS key, sha256('new key' || hash) AS hash, size FROM files WHERE key LIKE 'en/%'")
def deep_copy(spark, sf):
    """A subtree under another root, each file encoded anew under the target's key."""
    f = fx.files(spark, sf).select("key", "hash", "size")
    return layers.reroot(f, "en", "copy").withColumn("hash", F.sha2(F.concat(F.lit("new key"), "hash"), 256))


@query(f"WITH {fx.FILES}, prev AS (SELECT key, hash FROM files WHERE doc_id % 5 <> 0), batch AS (SELECT key, CASE WHEN doc_id % 3 = 0 THEN sha256('v2' || hash) WHEN doc_id % 3 = 1 THEN hash END AS hash FROM files WHERE doc_id % 4 = 0) SELECT key, hash FROM prev WHERE key NOT IN (SELECT key FROM batch) UNION ALL SELECT key, hash FROM batch WHERE hash IS NOT NULL")
def incremental_backup(spark, sf):
    """A batch of changed paths applied to the previous snapshot: written, new and vanished ones."""
    f = fx.files(spark, sf)
    new = F.when(F.expr("doc_id % 3 = 0"), F.sha2(F.concat(F.lit("v2"), "hash"), 256)).when(F.expr("doc_id % 3 = 1"), F.col("hash"))
    batch = f.where("doc_id % 4 = 0").select("key", new.alias("hash"), "size", F.expr("doc_id % 3 = 2").alias("is_tombstone"))
    return layers.merge(f.where("doc_id % 5 <> 0"), batch).select("key", "hash")


@query(f"WITH {fx.FILES} SELECT key, substr(key, 4) || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END AS relative FROM files WHERE key LIKE 'en/%'")
def relative_keys(spark, sf):
    """Keys below a base, relative to it; those of directories end with a slash."""
    f = fx.files(spark, sf).where(F.startswith("key", F.lit("en/")))
    return f.select("key", F.concat(F.expr("substring(key, 4)"), F.when(F.col("doc_id") % 3 == 0, "/").otherwise("")).alias("relative"))


# members


@query("""WITH acl AS (SELECT n_nationkey AS vault, c_custkey AS principal FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 1) SELECT c_custkey AS principal, c_custkey IN (SELECT principal FROM acl) AS allowed FROM customer""")
def acl_principals(spark, sf):
    """Whether each principal is on the list of any vault."""
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("principal"), F.col("c_nationkey").alias("vault"))
    return objects.contains(c.select("principal"), c.where("principal % 4 <> 1"), "principal").withColumnRenamed("found", "allowed")


@query("""WITH u AS (SELECT c_nationkey AS vault, 'k' || c_custkey % 13 AS r, c_custkey AS place FROM customer UNION ALL SELECT s_nationkey, 'k' || s_suppkey % 17, 1000000000 + s_suppkey FROM supplier), f AS (SELECT vault, r, min(place) AS place FROM u GROUP BY ALL)
    SELECT vault, string_agg(r, ',' ORDER BY place) AS recipients FROM f GROUP BY vault""")
def recipient_union(spark, sf):
    """Recipients of two lists without repeats, in the order in which they first come."""
    c = fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("vault"), F.concat(F.lit("k"), (F.col("c_custkey") % 13).cast("string")).alias("r"), F.col("c_custkey").alias("place"))
    s = fx.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("vault"), F.concat(F.lit("k"), (F.col("s_suppkey") % 17).cast("string")).alias("r"), (F.col("s_suppkey") + 1_000_000_000).alias("place"))
    first = c.unionAll(s).groupBy("vault", "r").agg(F.min("place").alias("place"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "r"))), lambda x: x["r"])
    return first.groupBy("vault").agg(F.array_join(ordered, ",").alias("recipients"))


# the file-system interface

_DIRS = "dirs AS (SELECT DISTINCT lang || '/' || source AS path FROM documents)"


@query(f"WITH {fx.FILES}, w AS (SELECT DISTINCT 'new/' || lang AS path FROM files UNION SELECT DISTINCT lang || '/' || source FROM files) SELECT path, CASE WHEN path LIKE 'new/%' THEN 'created' ELSE 'exists' END AS outcome FROM w")
def create_dir(spark, sf):
    """Directories to be made: those that hold something already are left as they are."""
    f = fx.files(spark, sf).where("lang is not null and source is not null")
    there = f.select(F.concat_ws("/", "lang", "source").alias("key")).distinct()
    wanted = f.select(F.concat(F.lit("new/"), "lang").alias("key")).distinct().unionAll(there)
    found = objects.contains(wanted, there)
    return found.select(F.col("key").alias("path"), F.when(F.col("found"), "exists").otherwise("created").alias("outcome"))


@query(f"WITH {_MERGED} SELECT key, hash, size FROM merged")
def file_put_sync(spark, sf):
    """Puts and deletes are written before they are read again."""
    pending = staged(fx.changes(spark, sf), "pending")
    return layers.merge(fx.base(spark, sf), pending)


@query(f"WITH {fx.FILES} SELECT substr(key, 4) AS key, hash, size FROM files WHERE key LIKE 'en/%'")
def subdir_view(spark, sf):
    """A subdirectory as a file system of its own."""
    return layers.reroot(fx.files(spark, sf).select("key", "hash", "size"), "en", "")


_PAGE = 20


@query(f"""WITH {fx.FILES}, c AS (SELECT DISTINCT split_part(key, '/', 1) AS dir, split_part(key, '/', 2) AS name FROM files), r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY name) AS place FROM c WHERE name > 'src10') SELECT dir, name FROM r WHERE place <= 5""")
def list_at_path(spark, sf):
    """A page of five names of each directory after a cursor."""
    f = fx.files(spark, sf)
    names = f.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("dir"), F.split_part("key", F.lit("/"), F.lit(2)).alias("name")).distinct().where("name > 'src10'")
    place = F.row_number().over(Window.partitionBy("dir").orderBy("name"))
    return names.withColumn("place", place).where("place <= 5").select("dir", "name")


@query(f"WITH {_MERGED} SELECT (SELECT count(*) FROM merged) AS entries, CAST((SELECT sum(size) FROM merged) AS BIGINT) AS size, 1 AS roots")
def save_and_flush(spark, sf):
    """A file system saved: its entries first, then the root that names them; what is read back is whole."""
    root = shared_folder(spark)
    merged = staged(layers.merge(fx.base(spark, sf), fx.changes(spark, sf)), "entries")
    store.publish(merged, f"{root}/entries", merged.agg(F.count("*").alias("entries"), F.sum("size").alias("size")), f"{root}/root")
    back, head = spark.read.parquet(f"{root}/entries"), spark.read.parquet(f"{root}/root")
    return back.agg(F.count("*").alias("entries"), F.sum("size").cast("long").alias("size")).join(head.groupBy("entries").agg(F.count("*").cast("int").alias("roots")), "entries")


@query(f"WITH {fx.LAYERS} SELECT key, hash, size, is_tombstone FROM base UNION ALL SELECT key, hash, size, is_tombstone FROM changes")
def export_physical(spark, sf):
    """What is stored, layer by layer, tombstones and covered entries included."""
    c, b = _layers(spark, sf)
    return b.unionByName(c.select(*b.columns))


@query(f"WITH {fx.LAYERS} SELECT key, hash, size, is_tombstone FROM base WHERE key LIKE 'c1/%' UNION ALL SELECT key, hash, size, is_tombstone FROM changes WHERE key LIKE 'c1/%'")
def export_physical_at(spark, sf):
    """The same below one path."""
    return export_physical(spark, sf).where(F.startswith("key", F.lit("c1/")))


@query(f"WITH {_MERGED} SELECT key, hash, size FROM merged WHERE key LIKE 'new/%'")
def export_merged_at(spark, sf):
    """The merged view below one path."""
    return layers.merge(fx.base(spark, sf), fx.changes(spark, sf)).where(F.startswith("key", F.lit("new/")))


@query("SELECT user_id AS fs, 'snap-' || count(*) AS name, sha256(string_agg(props, ',' ORDER BY event_id)) AS root, true AS pinned FROM events GROUP BY user_id")
def create_snapshot(spark, sf):
    """A snapshot of each file system: its root under a name, and a pin that keeps it."""
    e = fx.table(spark, sf, "events")
    props = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"])
    made = e.groupBy(F.col("user_id").alias("fs")).agg(F.concat(F.lit("snap-"), F.count("*").cast("string")).alias("name"), F.sha2(F.array_join(props, ","), 256).alias("root"))
    pins = made.select(F.col("root").alias("hash"), F.concat(F.lit("fs"), F.col("fs").cast("string")).alias("context"))
    return made.join(pins.groupBy("hash").agg(F.lit(True).alias("pinned")), F.col("root") == F.col("hash")).select("fs", "name", "root", "pinned")


_SNAPS = f"{fx.SNAPSHOTS}, gone AS (SELECT vault, ts FROM snapshots WHERE ts = '2024-01-02')"


@query(f"WITH {_SNAPS}, k AS (SELECT * FROM snapshots WHERE (vault, ts) NOT IN (SELECT vault, ts FROM gone)) SELECT vault, ts, hash FROM k")
def delete_snapshot(spark, sf):
    """Snapshots after one of each vault was deleted by name; its pin goes with it."""
    s = fx.snapshots(spark, sf)
    return s.join(s.where("ts = '2024-01-02'").select("vault", "ts"), ["vault", "ts"], "left_anti").select("vault", "ts", "hash")


@query(f"WITH {_SNAPS}, g AS (SELECT DISTINCT hash FROM snapshots JOIN gone USING (vault, ts)) SELECT hash FROM g WHERE hash NOT IN (SELECT s.hash FROM snapshots s WHERE (s.vault, s.ts) NOT IN (SELECT vault, ts FROM gone))")
def delete_snapshot_unpins(spark, sf):
    """Roots that no snapshot keeps any more."""
    s = fx.snapshots(spark, sf)
    return s.where("ts = '2024-01-02'").select("hash").distinct().join(delete_snapshot(spark, sf), "hash", "left_anti")


@query(f"WITH {fx.SNAPSHOTS}, n AS (SELECT vault, ts AS name, hash, row_number() OVER (PARTITION BY vault ORDER BY ts) AS place FROM snapshots) SELECT * FROM n")
def snapshot_names(spark, sf):
    """Names and roots of each vault in order."""
    place = F.row_number().over(Window.partitionBy("vault").orderBy("ts")).cast("long")
    return fx.snapshots(spark, sf).select("vault", F.col("ts").alias("name"), "hash", place.alias("place"))


@query(f"WITH {fx.SNAPSHOTS}, v AS (SELECT DISTINCT 'v' || conv_id AS vault FROM conversations UNION ALL SELECT 'empty' || n_nationkey FROM nation) SELECT v.vault, coalesce(s.ts, 'local') AS ts, coalesce(s.hash, sha256(v.vault)) AS hash FROM v LEFT JOIN snapshots s USING (vault)")
def snapshot_list_fallback(spark, sf):
    """Snapshots of all vaults; a vault without any is listed with its local root."""
    s = fx.snapshots(spark, sf)
    known = s.select("vault").distinct().unionAll(fx.table(spark, sf, "nation").select(F.concat(F.lit("empty"), F.col("n_nationkey").cast("string")).alias("vault")))
    return known.join(s, "vault", "left").select("vault", F.coalesce("ts", F.lit("local")).alias("ts"), F.coalesce("hash", F.sha2("vault", 256)).alias("hash"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS hash, CAST(NULL AS BIGINT) AS size, CAST(p_size AS BIGINT) AS timestamp, true AS is_tombstone FROM part")
def tombstones(spark, sf):
    """Entries of deleted paths."""
    p = fx.table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("path"), scalars.tombstone(F.col("p_size")).alias("e")).select("path", "e.*")


@query('SELECT p_partkey AS id, hex(encode(p_name)) AS "inline", sha256(p_name) AS hash, CAST(octet_length(encode(p_name)) AS BIGINT) AS size, CAST(p_size AS BIGINT) AS timestamp, false AS is_tombstone FROM part')
def inline_versions(spark, sf):
    """Versions that carry their content."""
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalars.inline_version(F.col("p_name"), F.col("p_size")).alias("e")).select("id", "e.*")


# feeds and scheduled passes


@query(f"WITH {fx.REGISTRY_LOG}, h AS (SELECT stream_key, revision, hash FROM log QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY revision DESC, seq) = 1), p AS (SELECT h.*, s FROM h, (SELECT unnest(['one', 'two']) AS s)) SELECT stream_key, revision, hash, s AS backend FROM p")
def registry_tee(spark, sf):
    """Messages set in two registries at once, batch by batch; both come to hold the same."""
    log = feeds.messages(spark, sf)
    one, two = feeds.set_in(log, 2)
    return one.withColumn("backend", F.lit("one")).unionByName(two.withColumn("backend", F.lit("two")))


_WINS = "o AS (SELECT *, max(revision) OVER (PARTITION BY stream_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM log), w AS (SELECT * FROM o WHERE held IS NULL OR revision > held)"


@query(f"WITH {fx.REGISTRY_LOG}, {_WINS} SELECT stream_key, seq, revision FROM w")
def change_broadcast(spark, sf):
    """Events of a registry: one after each message that raised the revision of its key, none for the others."""
    return feeds.broadcast(feeds.messages(spark, sf)).select("stream_key", "seq", "revision")


@query(f"WITH {fx.REGISTRY_LOG}, {_WINS}, k AS (SELECT DISTINCT stream_key FROM log WHERE stream_key % 3 <> 0), s AS (SELECT stream_key, max(revision) AS revision, 'replay' AS phase FROM log WHERE seq < 500 AND stream_key IN (SELECT stream_key FROM k) GROUP BY stream_key)"
       " SELECT stream_key, revision, phase FROM s UNION ALL SELECT stream_key, revision, 'live' FROM w WHERE seq >= 500 AND stream_key IN (SELECT stream_key FROM k)")
def subscription(spark, sf):
    """A subscription to the keys that a peer may read: what is held when it begins, then every change."""
    allowed = fx.registry_log(spark, sf).select("stream_key").distinct().where("stream_key % 3 <> 0")
    held = registry.head_by_arrival(fx.registry_log(spark, sf).where("seq < 500").join(allowed, "stream_key", "left_semi"))
    live = feeds.broadcast(feeds.messages(spark, sf)).where("seq >= 500").join(allowed, "stream_key", "left_semi")
    return held.select("stream_key", "revision", F.lit("replay").alias("phase")).unionByName(live.select("stream_key", "revision", F.lit("live").alias("phase")))


@query(f"WITH {fx.REGISTRY_LOG}, v AS (SELECT * FROM log WHERE seq % 7 <> 0) SELECT stream_key, revision, hash FROM v QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY revision DESC, seq) = 1")
def peer_feed_applied(spark, sf):
    """A peer's feed applied to the local registry: events that fail verification are passed over."""
    log = feeds.messages(spark, sf).where("seq % 7 <> 0")
    return feeds.set_in(log, 1)[0]


@query("SELECT DISTINCT event_id, user_id FROM events")
def index_sync_resumed(spark, sf):
    """A feed read in two runs from one checkpoint: the second goes on where the first has ended, and nothing comes twice."""
    return feeds.in_two_runs(spark, fx.table(spark, sf, "events").select("event_id", "user_id"))


@query(f"WITH {fx.REGISTRY_LOG}, a AS (SELECT stream_key, seq, row_number() OVER (PARTITION BY stream_key ORDER BY seq) AS place FROM log) SELECT stream_key, seq, place AS attempt FROM a WHERE place <= 16")
def cas_publish_retried(spark, sf):
    """Publishers of one key that start together: in each round one wins and the others read again; after 16 attempts they give up."""
    return feeds.publish_rounds(fx.registry_log(spark, sf).select("stream_key", "seq"), 16)


@query("""WITH r AS (SELECT event_id % 40 AS loop, row_number() OVER (PARTITION BY event_id % 40 ORDER BY event_id) - 1 AS n FROM events), a AS (SELECT *, CAST(CASE WHEN n % 9 >= 7 THEN 60 ELSE 1 << CAST(n % 9 AS INTEGER) END AS BIGINT) AS delay FROM r) SELECT loop, n, least(delay, 60) AS delay_s FROM a""")
def supervised_backoff(spark, sf):
    """Pauses before each restart of a failing loop: doubled up to a minute, and from one second again after nine."""
    n = F.row_number().over(Window.partitionBy("loop").orderBy("event_id")) - 1
    e = fx.table(spark, sf, "events").select((F.col("event_id") % 40).alias("loop"), "event_id").withColumn("n", n.cast("long"))
    return e.select("loop", "n", feeds.backoff(F.col("n") % 9, 60).alias("delay_s"))


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS task, CAST(p_size % 7 + 1 AS BIGINT) AS took, 0 AS run, CAST(0 AS BIGINT) AS start FROM part UNION ALL SELECT task, took, run + 1, start + took + 30 FROM t WHERE run < 9) SELECT task, CAST(run AS BIGINT) AS run, start, start + took AS done FROM t""")
def schedule_gaps(spark, sf):
    """Ten runs of each task, each thirty seconds after the one before was done."""
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("task"), (F.col("p_size") % 7 + 1).cast("long").alias("took"))
    return feeds.scheduled(p, 30, 10)


@query(f"""WITH {fx.BLOBS}, ticks AS (SELECT unnest([0, 1, 2]) AS tick), c AS (SELECT tick, b.*, {fx.NOW} - 31536000 * (2 - tick) AS t FROM blobs b, ticks), g AS (SELECT hash, size, min(tick) AS tick FROM c WHERE hash NOT IN (SELECT hash FROM pins) AND hash NOT IN (SELECT hash FROM live) AND mtime <= t AND t - mtime >= {fx.MIN_AGE} GROUP BY ALL)
    SELECT CAST(tick AS INTEGER) AS tick, CAST(count(*) AS BIGINT) AS collected, CAST(sum(size) AS BIGINT) AS bytes FROM g GROUP BY tick""")
def periodic_gc(spark, sf):
    """Three passes of a collection, a year apart: each takes what has become old since the one before."""
    from tessera.operators import reachability

    kept, out = fx.blobs(spark, sf), None
    for tick in range(3):
        classed = staged(reachability.classify(kept, fx.pins(spark, sf), fx.live(spark, sf), fx.NOW - 31_536_000 * (2 - tick), fx.MIN_AGE), "classed")
        gone = classed.where("class = 'candidate'").groupBy(F.lit(tick).alias("tick")).agg(F.count("*").alias("collected"), F.sum("size").cast("long").alias("bytes"))
        out = gone if out is None else out.unionByName(gone)
        kept = kept.join(classed.where("class = 'candidate'").select("hash"), "hash", "left_anti")
    return out


@query("""WITH f AS (SELECT 's' || (c_nationkey % 4) AS store, c_name AS path, c_custkey % 1000 + 1 AS size, 978307200 - (c_custkey * 7919) % 4000000 AS mtime FROM customer), t AS (SELECT store, sum(size) AS total FROM f GROUP BY store HAVING sum(size) > 60000),
    r AS (SELECT f.*, total, coalesce(sum(size) OVER (PARTITION BY store ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f JOIN t USING (store) WHERE mtime > 978307200 OR 978307200 - mtime >= 86400)
    SELECT store, CAST(count(*) AS BIGINT) AS first_pass, CAST(0 AS BIGINT) AS second_pass FROM r WHERE total - before > 57000 GROUP BY store""")
def periodic_prune(spark, sf):
    """Two pruning passes in a row: after the first, stores are within their budget and the second takes nothing."""
    c = fx.table(spark, sf, "customer")
    files = c.select(F.concat(F.lit("s"), (F.col("c_nationkey") % 4).cast("string")).alias("store"), F.col("c_name").alias("path"), (F.col("c_custkey") % 1000 + 1).alias("size"), (F.lit(fx.NOW) - (F.col("c_custkey") * 7919) % 4_000_000).alias("mtime"))
    first = staged(packing.prune(files, 60_000, fx.NOW, 86_400), "pruned")
    second = packing.prune(files.join(first.select("store", "path"), ["store", "path"], "left_anti"), 60_000, fx.NOW, 86_400)
    count = lambda d, n: d.groupBy("store").agg(F.count("*").alias(n))
    return count(first, "first_pass").join(count(second, "second_pass"), "store", "left").select("store", "first_pass", F.coalesce("second_pass", F.lit(0).cast("long")).alias("second_pass"))


@query(f"""WITH {fx.MEMBERS}, g AS (SELECT pack, sum(length) AS size FROM members GROUP BY pack), h AS (SELECT sha256(pack) AS hash, pack, size FROM g) SELECT hash, CASE WHEN size % 3 = 0 THEN 'retry' WHEN size % 3 = 1 THEN 'indexed' ELSE 'dropped' END AS outcome, CAST(CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS waiting FROM h""")
def pack_enrichment(spark, sf):
    """Registered packs once some headers can be read: what is no pack is dropped, what cannot be read yet waits for another try."""
    packs = fx.members(spark, sf).groupBy("pack").agg(F.sum("length").alias("size")).select(F.sha2("pack", 256).alias("hash"), "size")
    headers = packs.where("size % 3 <> 0").select("hash", F.when(F.col("size") % 3 == 1, "pack").otherwise("other").alias("state"), F.col("size").alias("members"))
    done = vault.late_packs(packs.select("hash"), headers)
    return done.select("hash", "outcome", F.when(F.col("outcome") == "retry", 1).otherwise(0).cast("long").alias("waiting"))


@query("""WITH e AS (SELECT user_id AS task, event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status FROM events), f AS (SELECT task, min(event_id) FILTER (status = 'failed') AS last FROM e GROUP BY task) SELECT e.task, e.event_id, e.status FROM e JOIN f USING (task) WHERE f.last IS NULL OR e.event_id <= f.last""")
def task_status_feed(spark, sf):
    """Status of each task until it has come to an end; what is reported after that is not passed on."""
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("task"), "event_id", F.when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"))
    last = e.where("status = 'failed'").groupBy("task").agg(F.min("event_id").alias("last"))
    return e.join(last, "task", "left").where("last is null or event_id <= last").select("task", "event_id", "status")


@query("SELECT user_id AS task, event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS done FROM events")
def task_progress(spark, sf):
    """A counter of each task that only grows, after every report."""
    done = F.sum(F.floor("value").cast("long")).over(Window.partitionBy("user_id").orderBy("event_id"))
    return fx.table(spark, sf, "events").select(F.col("user_id").alias("task"), "event_id", done.alias("done"))


@query("""WITH b AS (SELECT user_id AS source, event_id, floor(epoch(ts) / 86400) AS day FROM events), g AS (SELECT source, day, count(*) AS n FROM b GROUP BY ALL) SELECT source, CAST(count(*) AS BIGINT) AS saves, CAST(sum(n) AS BIGINT) AS changes FROM g GROUP BY source""")
def batch_closures(spark, sf):
    """Changes that are grouped and saved once a group: here by source and day."""
    e = fx.watch_events(spark, sf)
    groups = e.groupBy("source", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return groups.groupBy("source").agg(F.count("*").alias("saves"), F.sum("n").alias("changes"))


@query("""WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM l), f AS (SELECT user_id AS source, count(*) AS n FROM n GROUP BY user_id, n)
    SELECT source, CAST(count(*) AS BIGINT) AS flushes, CAST(sum(n) AS BIGINT) AS changes FROM f GROUP BY source""")
def flush_hook(spark, sf):
    """What a hook is told at each flush after an idle gap, summed by source."""
    path = f"{shared_folder(spark)}/told"
    e = streams.stream_of(spark, f"{sf}/events.parquet").select("ts", F.col("user_id").alias("source"))
    streams.handed(streams.sessions(e, "30 minutes"), lambda batch, number: batch.write.mode("overwrite").parquet(path), "complete")
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("flushes"), F.sum("events").cast("long").alias("changes"))


@query(f"WITH {fx.REGISTRY_LOG}, h AS (SELECT stream_key, hash FROM log QUALIFY row_number() OVER (PARTITION BY stream_key ORDER BY revision DESC, hash) = 1) SELECT stream_key, event_id, props FROM h JOIN events ON user_id = stream_key AND sha256(props) = hash")
def peer_snapshot(spark, sf):
    """What the published head of each peer refers to."""
    head = registry.head_reconciled(fx.registry_log(spark, sf)).select("stream_key", "hash")
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("stream_key"), "event_id", "props", F.sha2("props", 256).alias("hash"))
    return e.join(head, ["stream_key", "hash"]).select("stream_key", "event_id", "props")


@query(f"""WITH {fx.MEMBERS}, g AS (SELECT pack, CAST(sum(length) AS BIGINT) AS size, max(doc_id) AS newest FROM members JOIN files USING (key) GROUP BY pack), t AS (SELECT unnest(range(5)) AS tick), r AS (SELECT pack, tick, size, CASE WHEN size >= 30000 THEN 'full' WHEN tick * 400 >= newest THEN 'stale' END AS reason FROM g, t)
    SELECT pack, CAST(min(tick) AS BIGINT) AS tick, arg_min(reason, tick) AS reason FROM r WHERE reason IS NOT NULL GROUP BY pack""")
def pack_upload_ticks(spark, sf):
    """The tick at which each open pack goes: at once when it is full, else when it has waited long enough."""
    f = fx.files(spark, sf)
    groups = f.groupBy(F.concat_ws("-", "lang", "source").alias("pack")).agg(F.sum("size").cast("long").alias("size"), F.max("doc_id").alias("oldest"))
    out = None
    for tick in range(5):
        ready = vault.ready_groups(groups, 30_000, 400 * tick, 0).select("pack", F.lit(tick).cast("long").alias("tick"), "reason")
        out = ready if out is None else out.unionByName(ready)
    return out.groupBy("pack").agg(F.min("tick").alias("tick"), F.min_by("reason", "tick").alias("reason"))
