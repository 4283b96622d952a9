import hashlib
import itertools
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import history, ingest, layers, listing, packing, reachability, registry, sequential, vault
from tessera.sources import store

ENTRY = "key string, hash string, size long, is_tombstone boolean"


def _layer(spark, entries):
    return spark.createDataFrame([(k, *v) for k, v in entries.items()], ENTRY)


def test_priority_comes_before_tombstones(spark):
    rng = random.Random(4)
    stack = []
    for _ in range(3):
        stack.append({f"k{rng.randrange(40)}": (None, None, True) if rng.random() < 0.3 else (f"h{rng.randrange(99)}", rng.randrange(9), False) for _ in range(25)})
    won = {}
    for layer in reversed(stack):
        won |= layer
    frames = [_layer(spark, x) for x in stack]
    assert {r["key"]: (r["hash"], r["size"], r["is_tombstone"]) for r in layers.merged_view(frames).collect()} == won
    asked = spark.createDataFrame([(f"k{k}",) for k in range(0, 40, 3)], "key string")
    want = {k: v[:2] for k, v in won.items() if not v[2] and int(k[1:]) % 3 == 0}
    assert {r["key"]: (r["hash"], r["size"]) for r in layers.get_live(frames, asked).collect()} == want


def test_live_entry_without_content_is_not_a_delete(spark):
    base, change = _layer(spark, {"a": ("x", 1, False), "b": ("y", 2, False)}), _layer(spark, {"a": (None, None, False), "b": (None, None, True), "c": (None, None, True)})
    assert [(r["key"], r["hash"]) for r in layers.merge(base, change).collect()] == [("a", None)]
    s = layers.merge_stats(base, change).first()
    assert (s["entries"], s["reused"], s["changed"], s["tombstones_filtered"]) == (1, 0, 1, 2)


def test_registry_orders(spark):
    rows = [("k", 5, "b", 1), ("k", 7, "z", 2), ("k", 7, "a", 3), ("k", 6, "c", 4)]
    log = spark.createDataFrame(rows, "stream_key string, revision long, hash string, seq long")
    assert registry.head_reconciled(log).first()["hash"] == "a" and registry.head_by_arrival(log).first()["hash"] == "z"
    assert [r["accepted"] for r in registry.write_decisions(log).orderBy("seq").collect()] == [True, True, False, False]


def test_last_writer_wins_ties_stay_local(spark):
    side = "name string, kind string, hash string, ts_s long, ts_ns long"
    local = spark.createDataFrame([("a", "file", "l", 100, None), ("b", "file", "l", 100, 5), ("d", "dir", "l", 9, 0)], side)
    remote = spark.createDataFrame([("a", "file", "r", 100, 0), ("b", "file", "r", 100, 6), ("c", "file", "r", None, None), ("d", "file", "r", 10, 0)], side)
    assert {r["name"]: r["side"] for r in layers.lww_merge(local, remote).collect()} == {"a": "local", "b": "remote", "c": "remote", "d": "remote"}
    assert {r["name"]: r["kind"] for r in layers.lww_kinds(local, remote).collect()}["d"] == "file"


def test_keyset_pages_visit_everything_once(spark):
    names = [(n, k) for n in ("a", "b", "c", "d") for k in ("dir", "file") if (n, k) != ("c", "dir")]
    frame = spark.createDataFrame(random.Random(1).sample(names, len(names)), "name string, kind string")
    seen, after = [], None
    while page := [tuple(r) for r in listing.keyset_page(frame, after, 2).collect()]:
        seen += page
        after = page[-1]
    assert seen == names


def test_subtree_is_exact_to_the_segment(spark):
    keys = ["sub/x", "subway", "sub/deep/leaf", "sub/", "sub/e/", "top"]
    found = listing.tree(spark.createDataFrame([(k, 1) for k in keys], "key string, size long"), "sub", 1)
    assert sorted((r["path"], r["is_dir"]) for r in found.collect()) == [("e", True), ("x", False)]


def test_selector_precedence(spark):
    rows = [("v", "t1", "2aa"), ("v", "t2", "2bb"), ("v", "9", "c00")]
    snaps = spark.createDataFrame(rows, "vault string, ts string, hash string")
    asked = spark.createDataFrame([("v", s) for s in ("2", "9", "C0", "2a", "22", "nope", "t1")], "vault string, selector string")
    got = {r["selector"]: (r["outcome"], r["hash"]) for r in history.select(snaps, asked).collect()}
    ordered = sorted(rows, key=lambda r: r[1])
    assert got["2"] == ("revision", ordered[1][2]) and got["9"] == ("timestamp", "c00") and got["C0"] == ("hash", "c00") and got["t1"] == ("timestamp", "2aa")
    assert got["2a"] == ("hash", "2aa") and got["22"] == ("missing", None) and got["nope"] == ("missing", None)


def test_garbage_collection(spark):
    now, age = 1000, 100
    blobs = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 4, 950), ("d", 8, None), ("e", 16, 1200), ("f", 32, 900)], "hash string, size long, mtime long")
    pins, live = spark.createDataFrame([("a",)], "hash string"), spark.createDataFrame([("a",), ("b",)], "hash string")
    assert {r["hash"]: r["class"] for r in reachability.classify(blobs, pins, live, now, age).collect()} == {"a": "pinned", "b": "reachable", "c": "too_young", "d": "too_young", "e": "too_young", "f": "candidate"}
    assert {r["hash"] for r in reachability.sweep(blobs, pins, live, now, age).collect()} == set("abcde")
    with pytest.raises(ValueError):
        reachability.sweep(blobs, pins, live.limit(0), now, age)


def test_closure_of_a_cyclic_graph(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)}
    reach, todo = {0}, [0]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in reach:
                reach.add(b)
                todo.append(b)
    frame = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "parent string, child string")
    assert {int(r["node"]) for r in reachability.closure(spark.createDataFrame([("0",)], "node string"), frame).collect()} == reach
    with pytest.raises(ValueError):
        reachability.closure(spark.createDataFrame([("0",)], "node string"), spark.createDataFrame([(str(k), str(k + 1)) for k in range(9)], "parent string, child string"), 4)


def test_prune_stops_at_the_low_watermark(spark):
    rng = random.Random(6)
    files = [("s", f"f{k:03}", rng.randrange(1, 50), rng.randrange(0, 1_000_000)) for k in range(200)] + [("small", "x", 5, 1), ("s", "future", 7, 3_000_000)]
    now, age, budget = 1_000_000, 50_000, 2_000
    total, gone = sum(f[2] for f in files if f[0] == "s"), set()
    for _, path, size, mtime in sorted((f for f in files if f[0] == "s"), key=lambda f: (f[3], f[1])):
        if total <= int(budget * 0.95):
            break
        if mtime > now or now - mtime >= age:
            gone.add(path)
            total -= size
    got = packing.prune(spark.createDataFrame(files, "store string, path string, size long, mtime long"), budget, now, age, step=100_000)
    assert {r["path"] for r in got.collect()} == gone


def test_affected_leaves(spark):
    rng = random.Random(2)
    keys = sorted({"".join(rng.choices("abc/x", k=rng.randrange(1, 6))) for _ in range(200)})
    firsts = [(k, n) for n, k in enumerate(keys[10::17])]
    want = {}
    for k in keys:
        if below := [n for f, n in firsts if f <= k]:
            want[below[-1]] = want.get(below[-1], 0) + 1
    got = layers.affected_leaves(spark.createDataFrame(firsts, "first_key string, leaf_id long"), spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {r["leaf_id"]: r["changes"] for r in got.collect()} == want


def test_boundary_groups(spark):
    keys = [f"dir/{k:04}" for k in range(300)]
    got = {r["key"]: r["group_id"] for r in sequential.boundary_groups(spark.createDataFrame([("t", k) for k in keys], "tree string, key string"), 3).collect()}
    groups = [list(g) for _, g in itertools.groupby(keys, got.get)]
    assert sum(groups, []) == keys
    for group in groups[:-1]:
        assert len(group) >= 4 and sequential.boundary(group[-1], 3) and not any(sequential.boundary(k, 3) for k in group[3:-1])


def test_pack_admission():
    slab, cap = 100, 300
    assert sequential.admits(0, 5000, slab, cap, 0.1)
    assert sequential.admits(150, 50, slab, cap, 0.1) and not sequential.admits(300, 10, slab, cap, 0.1)
    assert sequential.admits(250, 50, slab, cap, 0.1) and not sequential.admits(250, 60, slab, cap, 0.1)
    assert not sequential.admits(295, 6, slab, cap, 0.1)


def test_first_fit_loses_nothing(spark):
    rng = random.Random(8)
    blobs = [(f"b{k % 3}", f"p{k:04}", rng.randrange(1, 90)) for k in range(300)]
    got = sequential.first_fit(spark.createDataFrame(blobs, "batch string, path string, length long"), 64, 256, 0.1).collect()
    assert sorted((r["batch"], r["path"], r["length"]) for r in got) == sorted(blobs)
    sizes = {}
    for r in got:
        sizes[r["batch"], r["pack"]] = sizes.get((r["batch"], r["pack"]), 0) + r["length"]
    assert all(s <= 256 + 64 for s in sizes.values())


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_rolling_hash_by_doubling(data):
    h, hits = 0, []
    for i, b in enumerate(data):
        h = (h << 1) + int(sequential._GEAR[b]) & (1 << 64) - 1
        if h >> 59 == 0:
            hits.append(i + 1)
    ends, start = [], 0
    while start < len(data):
        end = min(next((x for x in hits if x >= start + 100), len(data)), start + 400)
        ends.append(min(end, len(data)))
        start = ends[-1]
    assert sequential.gear_ends(data, 100, 400, 5) == ends


def test_chunks_survive_an_insertion(spark):
    text = " ".join(str(random.Random(1).randrange(10**9) * k) for k in range(4000))
    files = spark.createDataFrame([("a", text), ("b", text[:2000] + "inserted" + text[2000:]), ("c", None), ("d", "")], "key string, text string")
    got = sequential.cdc_chunks(files, 256, 4096, 8).collect()
    a, b = ({r["hash"] for r in got if r["key"] == k} for k in "ab")
    assert len(a & b) >= len(a) - 4 and {r["key"] for r in got} == {"a", "b"}


def test_shard_buckets(spark):
    got = {r["name"]: r["bucket"] for r in sequential.shard_buckets(spark.createDataFrame([("a",), ("ü",), (None,)], "name string"), 1).collect()}
    assert got == {"a": xxhash.xxh3_64_intdigest("a") >> 8 & 255, "ü": xxhash.xxh3_64_intdigest("ü".encode()) >> 8 & 255, None: None}


def test_scalars(spark):
    rows = spark.createDataFrame([("10s", 10), ("5 m", 300), (" 1h", 3600), ("7", 7), ("x", None), ("", None), ("5d", None)], "t string, s long")
    assert rows.where(~scalars.seconds(F.col("t")).eqNullSafe(F.col("s"))).count() == 0
    digest = hashlib.sha256(b"x").hexdigest()
    one = spark.range(1)
    path = one.select(scalars.blob_path(F.lit(digest)).alias("p"), scalars.hash_of_path(scalars.blob_path(F.lit(digest))).alias("h"), scalars.hash_of_path(F.lit("other/x")).alias("n")).first()
    assert path["h"] == digest and path["n"] is None and path["p"].startswith("blob3/")
    sizes = spark.createDataFrame([(0,), (1,), (255,), (256,), (1 << 40,)], "s long").withColumn("i", scalars.blob_id(F.lit(digest), F.col("s")))
    assert sizes.where(scalars.blob_id_size(F.col("i")) != F.col("s")).count() == 0
    assert one.select(scalars.base32(F.unhex(F.lit("f00f"))).alias("b")).first()["b"] == "b6ahq"
    keys = spark.createDataFrame([("/a",), ("a/../b",), ("a..b",), ("..",), ("a\u0000",)], "k string").select(scalars.key_error(F.col("k")).alias("e"))
    assert [r["e"] for r in keys.collect()] == ["absolute", "parent", None, "parent", "nul"]
    tags = one.select(scalars.stream_key(F.lit("vault"), F.lit("aa"), F.lit("bb")).alias("v"), scalars.stream_key(F.lit("local"), F.lit("aa"), F.lit("bb")).alias("l")).first()
    assert tuple(tags) == ("01aabb", "00aa")


def test_routes(spark):
    keys = spark.createDataFrame([("a/b.txt",), ("a/c/b.txt",), ("x.md",)], "k string")
    got = [r["r"] for r in keys.select(ingest.route(F.col("k"), [("a/*.txt", "one"), ("**.txt", "two")], "none").alias("r")).collect()]
    assert got == ["one", "two", "none"]


def test_store(spark, tmp_path):
    blobs = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "hash string, content string")
    path = str(tmp_path / "blobs")
    assert store.put_blobs(blobs, path).count() == 2
    more = spark.createDataFrame([("b", "2"), ("c", "3")], "hash string, content string")
    assert sorted(r["hash"] for r in store.put_blobs(more, path).collect()) == ["a", "b", "c"]
    found = store.inventory(spark, path, "*.parquet")
    assert found.count() > 0 and found.where("size <= 0 or mtime is null").count() == 0
    store.publish(blobs, str(tmp_path / "data"), more, str(tmp_path / "head"))
    store.tee(blobs, str(tmp_path / "one"), str(tmp_path / "two"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == spark.read.parquet(str(tmp_path / "two")).count() == 3
    data = spark.createDataFrame([(bytearray(b"0123456789"),)], "content binary")
    assert bytes(store.read_range(data, 3, 4).first()["content"]) == b"3456" and bytes(store.read_range(data, 8).first()["content"]) == b"89" and bytes(store.read_range(data, 20).first()["content"]) == b""


def test_links_of_any_spelling(spark):
    html = """<a class="x" href='/one'>1</a><A HREF="two">2</A><a href=three>3</a><a href="#part">4</a><a href="?q">5</a><a data-href="no" href = "//other/x">6</a><abbr href="never"><a href="http://h/dir/page">7</a>"""
    pages = spark.createDataFrame([(1, "http://h/dir/page", html), (2, "http://h", '<a href="sub/x">'), (3, "http://h/a", None)], "page_id long, url string, html string")
    assert {(r["page_id"], r["link"]) for r in ingest.page_links(pages).collect()} == {(1, "/one"), (1, "two"), (1, "three"), (1, "//other/x"), (1, "http://h/dir/page"), (2, "sub/x")}
    targets = {(r["page_id"], r["target"]) for r in ingest.linked_pages(pages, F.lit("http://h/")).collect()}
    assert targets == {(1, "http://h/one"), (1, "http://h/dir/two"), (1, "http://h/dir/three"), (2, "http://h/sub/x")}


def test_root_hashes_of_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(vault, "CHILDREN", 4)
    rows = [(t, f"k{k}", f"h{k}") for t in "ab" for k in range(100)] + [("c", f"k{k}", f"h{k % 99}") for k in range(100)] + [("d", "k1", "h1")]
    roots = {r["t"]: r["root"] for r in vault.root_hashes(spark.createDataFrame(rows, "t string, key string, hash string"), "t").collect()}
    assert roots["a"] == roots["b"] and len(set(roots.values())) == 3
    assert vault.root_hashes(spark.createDataFrame([], "t string, key string, hash string"), "t").count() == 0


def test_leaves_grow_with_the_data(spark, monkeypatch):
    monkeypatch.setattr(layers, "LEAF", 1)
    base = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("h").alias("hash"))
    new = base.withColumn("hash", F.when(F.col("key") == "k7", "x").otherwise("h"))
    n = layers.leaf_count(base, new)
    assert n == 512
    found = layers.leaf_diff(layers.leaves(new, n), layers.leaves(base, n)).select("key").collect()
    assert "k7" in {r["key"] for r in found} and len(found) < 20


def test_closure_writes_what_was_seen_now_and_then(spark, monkeypatch):
    monkeypatch.setattr(reachability, "ROUNDS_APART", 3)
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(10)] + [("10", "2")], "parent string, child string")
    assert {int(r["node"]) for r in reachability.closure(spark.createDataFrame([("0",)], "node string"), chain).collect()} == set(range(11))
