import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ngram_join
from tessera.llm.components import components


def _shingles(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def _brute(rows):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 0.79 < (len(a) / len(b)) < 1.27:
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def _check(spark, rows):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs).collect()), key=str)
    assert got == _brute(rows)


def _texts(rng, n):
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 6, 9, 40, 120)))] for _ in range(12)]
    passage = [rng.choice(words) for _ in range(40)]
    out = []
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 8))):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.4:
            text = text + passage
        out.append(rng.choice((" ", "  ", "\n")).join(text if rng.random() < 0.7 else [t.upper() for t in text]))
    return out


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    _check(spark, list(enumerate(_texts(rng, 250))))
    # small blocks: frequent shingles are salted, blocks are split, hubs have several groups
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "SLAB", 9)
    monkeypatch.setattr(ngram_join, "STAR", 3)
    monkeypatch.setattr(ngram_join, "NAME_BITS", 7)  # sets share the leading halves of their names
    _check(spark, list(enumerate(_texts(rng, 250))))


def test_candidates_come_from_the_trees(spark, monkeypatch):
    """On a real table the trees find candidates and leave others out, and no link is found without them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    served, by_pivots = [], ngram_join._found_by_pivots

    def counted(blocks, classes):
        found = by_pivots(blocks, classes)
        served.append((blocks.where("name <> pivot").count(), found.agg(F.sum("common")).first()[0]))
        return found

    monkeypatch.setattr(ngram_join, "_found_by_pivots", counted)
    linked = ngram_join.ngram_join(docs).where("component_id <> doc_id").count()
    assert linked and 0 < served[0][1] <= served[0][0]
    monkeypatch.setattr(ngram_join, "_found_by_pivots", lambda blocks, classes: by_pivots(blocks, classes).limit(0))
    monkeypatch.setattr(ngram_join, "_across", lambda blocks, joined, classes, tried, rows: tried.limit(0))
    equal = ngram_join.ngram_join(docs).where("component_id <> doc_id").count()
    assert equal < linked  # equal sets are one class without any search


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2), (2, "A b", 1, 2), (3, "c", 1, 2)], "doc_id long, text string, gone int, GONE_ int")
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (None, "a b"), (None, "x y z q r s"), (7, "a b c d e"), (7, "a b c d e"), (9, "long " * 30_000)]
    _check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0
    assert ngram_join.ngram_join(docs.where("doc_id = 1")).count() == 1


def test_tree_loses_nothing():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 90)).astype(np.uint64)) for _ in range(400)]
    sets += [np.unique(np.r_[s[: int(len(s) * 0.95)], rng.integers(0, 2**63, 2).astype(np.uint64)]) for s in sets]
    vectors = ngram_join.vectors_of([ngram_join.count_vector(s) for s in sets])
    n = np.array([len(s) for s in sets])
    block = np.arange(len(sets)) * 7 // len(sets)
    forest = ngram_join.CountForest(block, vectors, n)
    found = {(forest.order[a], forest.order[b]) for q, row in forest.search(np.arange(len(sets))) for a, b in zip(q, row, strict=True)}
    assert all(block[a] == block[b] for a, b in found) and len(found) < len(sets) ** 2 / 20
    for i in range(len(sets)):
        for j in range(len(sets)):
            if block[i] == block[j] and 0.79 < n[i] / n[j] < 1.27:
                both = len(np.intersect1d(sets[i], sets[j]))
                assert 100 * both < 80 * (n[i] + n[j] - both) or (i, j) in found


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1000 + k + 1) for k in range(40)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want
