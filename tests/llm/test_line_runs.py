import random

from tessera.llm import line_runs


def _brute(rows, least):
    """Lines that a run of `least` words covers which also occurs at an earlier (id, row, line)."""
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    lines = {r: [x.strip(" \t\r\x0b\x0c") for x in rows[r][1].split("\n")] for r in order if rows[r][1] is not None}
    seen, gone = {}, {r: set() for r in lines}
    for at, r in enumerate(order):
        if r not in lines:
            continue
        own = lines[r]
        for i in range(len(own)):
            for j in range(i + 1, len(own) + 1):
                run = tuple(own[i:j])
                if sum(len(x.split()) for x in run) >= least:
                    first = seen.setdefault(run, (at, i))
                    if first < (at, i):
                        gone[r] |= set(range(i, j))
    return {r: sorted(g) for r, g in gone.items()}


def _lines_of(row):
    return [i for s in row["spans"] for i in range(s["start"], s["end"])]


def _check(spark, rows, least):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, i string")
    got = line_runs.line_dedup(docs, least).collect()
    assert len(got) == len(rows)
    want = _brute(rows, least)
    by = {r["doc_id"]: r for r in got}
    for k, (d, text) in enumerate(rows):
        assert _lines_of(by[d]) == want.get(k, []), (d, text)
        assert by[d]["removed_lines"] == len(want.get(k, [])) and by[d]["n_lines"] == (0 if text is None else text.count("\n") + 1)
    return docs, want


def test_against_brute_force(spark):
    for seed, least in ((1, 6), (2, 3), (3, 12)):
        rng = random.Random(seed)
        pool = ["", "a", "b c", "d e f", "g h i j k l m n", "o p", "q"]
        rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.choice((1, 2, 5, 9, 14))))) for k in range(25)]
        rows += [(100 + k, rows[k][1] + "\nend " + str(k)) for k in range(0, 20, 3)]
        docs, want = _check(spark, rows, least)
    clean = {r["doc_id"]: r["text"] for r in line_runs.without_runs(docs, least).collect()}
    for k, (d, text) in enumerate(rows):
        assert clean[d] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[k])


def test_odd_rows(spark):
    long = "\n".join(f"line number {k}" for k in range(700))
    rows = [(1, None), (2, ""), (3, long), (4, "head\n" + long + "\ntail"), (None, long), (6, "spam " * 60 + "\n" + "spam " * 60), (7, " \r\n" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r["doc_id"]: r for r in line_runs.line_dedup(docs).collect()}
    assert by[1]["n_lines"] == 0 and by[2]["n_lines"] == 1 and not by[3]["spans"]
    assert [tuple(s) for s in by[4]["spans"]] == [(1, 701)] and [tuple(s) for s in by[None]["spans"]] == [(0, 700)]
    assert [tuple(s) for s in by[6]["spans"]] == [(1, 2)] and not by[7]["spans"]
    same = spark.createDataFrame([(1, long), (1, long), (1, long)], "doc_id long, text string")
    assert sorted(r["removed_lines"] for r in line_runs.line_dedup(same).collect()) == [0, 700, 700]
    assert line_runs.line_dedup(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, long, 1, 2), (1, long, 3, 4), (None, long, 5, 6), (1, None, 7, 8)], "doc_id long, text string, spans int, _doc_id int")
    left = line_runs.without_runs(odd)
    assert left.columns == odd.columns and sorted((r["spans"], r["text"]) for r in left.where("text is not null").collect()) == [(1, long), (3, ""), (5, "")]
    assert left.where("text is null").count() == 1
