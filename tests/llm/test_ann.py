import numpy as np

from tessera.llm import ann


def _brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            out[i] = sorted((float(a), int(b)) for a, b in zip(d, ids, strict=True) if b != i)[:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32).astype(float)
    x[500:560] = x[0]  # copies: ties go to the smaller id
    ids = rng.permutation(3000)
    vectors = spark.createDataFrame([(int(i), v.tolist(), "a") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank string")
    found = {}
    for r in ann.nearest(vectors).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = _brute(ids, x, 100, 10)
    assert set(found) == set(want)
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert [(r[1], r[2]) for r in rows] == sorted((r[1], r[2]) for r in rows)
        hits += len({r[2] for r in rows} & {b for _, b in want[q]})
        by = {b: a for a, b in ((float(np.sqrt(((x[j] - x[list(ids).index(q)]) ** 2).sum())), int(ids[j])) for j in range(3000))}
        assert all(abs(by[r[2]] - r[1]) < 1e-9 for r in rows)
    assert hits / (10 * len(want)) >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0]), (8, [1.0, 2.0]), (9, [float("inf"), 1.0]), (9, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(vectors).collect())
    assert got == [(0, 1, 8, 0.0), (0, 2, 100, 0.5), (100, 1, 0, 0.5), (100, 2, 8, 0.5)]
    assert ann.nearest(vectors.limit(0)).count() == 0
    assert ann.nearest(vectors.where("vec_id = 8")).count() == 0


def test_doubles_are_measured_as_they_are(spark):
    rows = [(0, [1e39, 2.0]), (100, [1e39, 2.5]), (1, [-1e300, 1e300]), (2, [1.0, 2.0]), (3, [1e-200, 0.0]), (4, [0.1, 0.2]), (5, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(vectors).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(got) == {0, 100} and set(got[0]) == {100, 1, 2, 3, 4} and got[0][100] == 0.5 and got[100][0] == 0.5
    assert got[0][4] == float(np.sqrt(((np.array([0.1, 0.2]) - np.array([1e39, 2.0])) ** 2).sum())) and abs(got[0][1] / (2**0.5 * 1e300) - 1) < 1e-12
    assert ann.distances(np.array([[1e-200, 0.0]]), np.zeros(2))[0] == 1e-200
