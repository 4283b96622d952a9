import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing
from tessera.llm.exact_dedup import CuckooIndex
from tessera.llm.shared import stage


def test_cuckoo_index_against_a_dict():
    rng, index, live = random.Random(1), CuckooIndex(buckets=2), {}
    pool = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    for step in range(30_000):
        d = rng.choice(pool)
        if d in live and rng.random() < 0.5:
            assert index.delete(d)
            del live[d]
        elif d not in live:
            assert index.find(d) is None and not index.delete(d)
            index.insert(d, step)
            live[d] = step
        else:
            assert index.find(d)[1] == live[d]
    assert {d: v for d, v in index.entries()} == live and len(index) == len(live)


def test_false_hits_are_verified():
    index = CuckooIndex(buckets=1)
    a = bytes([1, 0]) + bytes(30)
    b = bytes([1, 0]) + bytes(29) + b"x"
    index.insert(a, 1)
    assert index.find(b) is None
    index.insert(b, 2)
    assert index.delete(a) and index.find(a) is None and index.find(b)[1] == 2


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (7, "a b"), (7, "a b"), (None, "a b"), (None, "q"), (None, "q"), (8, "x" * 100_000)]


def test_exact_dedup(spark):
    docs = spark.createDataFrame([(*r, "k") for r in ROWS], "doc_id long, text string, kept string").repartition(3)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS]
    want = sorted(((d, min((e for (e, _), m in zip(ROWS, norm, strict=True) if m == n and e is not None), default=None), norm.count(n), hashlib.sha256(n.encode()).hexdigest()) for (d, _), n in zip(ROWS, norm, strict=True)), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [(r["doc_id"], r["text_sha256"]) for r in got if r["kept"]]
    assert len(kept) == len(set(norm)) == len({s for _, s in kept})
    clean = exact_dedup.without_copies(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 3, 8, 9] and clean.columns == docs.columns
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_repeated_rows_are_reduced_to_one(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    left = exact_dedup.without_copies(docs).collect()
    assert sorted(((r["doc_id"], (r["text"] or "")[:2]) for r in left), key=str) == sorted([(3, "a\t"), (9, "a "), (1, ""), (8, "xx"), (None, "q")], key=str)


def _targets(sizes, weights=(1.0, 2.0, 3.0), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out = float(sum(sizes.values())), {}
    while rest := [s for s in names if s not in out]:
        each = left / sum(weight[s] for s in rest)
        full = [s for s in rest if each * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: each * weight[s] for s in rest}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
    return out


def test_columns_of_any_name(spark):
    names = "doc_id long, text string, drop_id int, _drop_id int, SHA string, keep_sha string, _sha int, _gone int"
    docs = spark.createDataFrame([(1, "a b", 1, 2, "s", "k", 3, 4), (2, "a  b", 1, 2, "s", "k", 3, 4), (2, "a\tb", 1, 2, "s", "k", 3, 4), (3, "c", 1, 2, "s", "k", 3, 4)], names)
    for some, n in ((docs, 2), (docs.where("doc_id <> 2 or text = 'a  b'"), 2)):
        left = exact_dedup.without_copies(some)
        assert left.columns == docs.columns and left.count() == n and left.first()["_sha"] == 3


def test_a_full_index_deletes_what_is_rare():
    fold = exact_dedup._fold(50)
    rng, rows = random.Random(3), []
    for k in range(2000):
        rows.append((hashlib.sha256(str(rng.randrange(5) if rng.random() < 0.4 else 100 + rng.randrange(900)).encode()).digest(), k, k, 1))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20], strict=True), exact_dedup._PARTIAL.types, strict=True)], schema=exact_dedup._PARTIAL) for i in range(0, len(rows), 20)]
    out = [tuple(r.values()) for b in fold(batches) for r in b.to_pylist()]
    total, first, times = {}, {}, {}
    for d, doc, _, n in out:
        total[d], first[d], times[d] = total.get(d, 0) + n, min(first.get(d, doc), doc), times.get(d, 0) + 1
    want = {}
    for d, doc, _, _ in rows:
        want.setdefault(d, []).append(doc)
    assert total == {d: len(v) for d, v in want.items()} and first == {d: v[0] for d, v in want.items()}
    assert all(times[hashlib.sha256(str(k).encode()).digest()] < 5 for k in range(5))


def test_live_index_under_updates(spark):
    rng, live, want = random.Random(9), spark.createDataFrame([], "digest binary, n long"), {}
    for _ in range(3):
        changes = [(bytes([rng.randrange(40)]) * 8, rng.choice((1, 1, 2, -1, -3))) for _ in range(200)] + [(None, 1), (b"x", None)]
        live = exact_dedup.update(live, spark.createDataFrame(changes, "digest binary, change long"))
        net = {}
        for d, c in changes:
            if d is not None and c is not None:
                net[d] = net.get(d, 0) + c
        for d, c in net.items():
            want[d] = max(0, want.get(d, 0) + c)
        assert {bytes(r["digest"]): r["n"] for r in live.collect()} == {d: n for d, n in want.items() if n}


def test_targets(spark):
    rng = random.Random(4)
    many = {f"s{k}": rng.choice((0, 1, 5, 100, 40_000)) for k in range(300)}
    for sizes in ({"a": 100, "b": 100, None: 100}, {"a": 10, "b": 1000, "c": 1, "d": 989}, {"a": 0}, {"é": 7, "z": 1, "Z": 2, None: 0, "": 9}, many):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)).collect()
        want = _targets(sizes)
        assert len(got) == len(want) and all(abs(r["target"] - want[r["source"]]) <= 1e-9 * (1 + want[r["source"]]) for r in got)
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randrange(1, 60)), rng.choice(("hot", "hot", "hot", "b", "c", None, "d")), "x") for k in range(4000)]
    rows += [(5000, None, "b", "x"), (5001, "", "empty", "x"), (None, "a b", "c", "x"), (1, rows[1][1], rows[1][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)
    plan = mixing.mix(docs).collect()
    assert len(plan) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    aim = _targets(sizes)
    taken, expected = {s: 0 for s in sizes}, {}
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - aim[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        assert int(r["expected"] + 1e-9) <= r["copies"] <= int(r["expected"] + 1e-9) + (r["expected"] % 1 > 1e-9)
        taken[r["source"]] += r["taken"]
        each = r["expected"] / max(1, r["size"].bit_length())
        expected.setdefault(r["source"], []).append((r["expected"], each, r["size"]))
    for s in sizes:
        assert abs(taken[s] - aim[s]) <= max(2.0, 0.002 * aim[s]), (s, taken[s], aim[s])
        # by definition: in proportion to the digits unless full, and the target in expectation
        assert abs(sum(e * n for e, _, n in expected[s]) - aim[s]) < 1e-6 * (1 + aim[s])
        open_ = [x for e, x, _ in expected[s] if e < 3]
        assert not open_ or max(open_) - min(open_) < 1e-9
        assert not open_ or all(max(1, n.bit_length()) * open_[0] >= 3 - 1e-9 for e, _, n in expected[s] if e >= 3)
    again = mixing.mix(docs.repartition(2)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(again, key=key) == sorted(plan, key=key)
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed(docs.where("doc_id > 1"))
    assert out.columns == docs.columns
    assert out.groupBy("doc_id").count().where("count > 3").count() == 0


def test_repeated_rows_are_taken_one_by_one(spark):
    """Hundreds of rows with one id and text: the source comes within one document of its target."""
    rows = [(1, "w " * 10, "a")] * 300 + [(k, "w " * 10, "b") for k in range(300)] + [(7, "v " * 5, None)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert len(found) == 3 and all(abs(r["taken"] - r["target"]) <= r["most"] for r in found)
    stored = stage(docs, "docs")
    assert mixing.mixed(stored).where("source = 'a'").count() == mixing.mix(stored).where("source = 'a'").agg(F.sum("copies")).first()[0]


def test_inclusion_follows_the_odds(spark):
    """Over many seeds short and long documents of one source are taken as often as their own expectations say."""
    docs = stage(spark.createDataFrame([(k, "w " * (3, 100)[k // 2 % 2], "ab"[k % 2]) for k in range(2000)], "doc_id long, text string, source string"), "docs")
    got, seeds = {}, 3
    for seed in range(seeds):
        for r in mixing.mix(docs, seed=seed).groupBy("source", "size", "expected").agg(F.avg("copies").alias("mean")).collect():
            got.setdefault((r["source"], r["size"], r["expected"]), []).append(r["mean"])
    assert len(got) == 4
    for (source, size, expected), means in got.items():
        assert len(means) == seeds and abs(sum(means) / seeds - expected) < 0.05, (source, size, expected, means)
    for s in "ab":
        short, long = (next(e for (t, n, e) in got if t == s and n == size) for size in (3, 100))
        assert abs(long / short - 7 / 2) < 1e-9 or long == 3.0
