import hashlib
import re

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tessera.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def _brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    rows = [r for r in sorted(docs.collect(), key=lambda r: r["doc_id"]) if r["doc_id"] in kept]
    seen, unique = set(), []
    for r in rows:
        if (t := re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) not in seen:
            seen.add(t)
            unique.append(r)
    sets, root = [_shingles(r["text"]) for r in unique], list(range(len(unique)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    single = [r for i, r in enumerate(unique) if find(i) == i]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(single, docs.schema)).collect()}
    library, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in single:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        out += [(r["doc_id"], len(ids), *digests)] * plan[r["doc_id"]]
    return out


def test_against_brute_force(spark):
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(_brute(spark)) and got


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count()
        assert step(spark, docs.limit(0), SF).count() == 0


def test_queries_and_oracles(spark):
    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in __spark_entry__.oracle_sql().items():
        if name.startswith("op"):
            want = con.sql(sql)
            got = names[name](spark, SF).select(*want.columns).collect()
            assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str), name


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with names that the operators use."""
    rows = [
        (None, None, None, None, None, 1, 2),
        (None, None, None, None, None, 1, 2),
        (1, "one two three four five six", "en", "a", 5, 1, 2),
        (1, "one two three four five six", "en", "a", 5, 1, 2),
        (1, "another text under the same id", "en", "a", 5, None, None),
        (2, "", "en", None, 0, 1, 2),
        (3, " \n\t", None, "b", 0, 1, 2),
        (4, "one  two three four five six", "de", "b", 5, 1, 2),
        (5, "word " * 50_000, "xx", "c", 5, 1, 2),
        (6, "one two three four five six seven", "en", "c", 5, 1, 2),
        (None, "a text without an id", "en", "c", 5, 1, 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, name int").repartition(3)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, SF).collect(), docs.schema)
        assert docs.columns[-2:] == ["size", "name"], name
    texts = [" ".join((r["text"] or "").split()) for r in docs.collect()]
    assert texts.count("one two three four five six") <= 3 and "word" in texts[[len(t) for t in texts].index(max(map(len, texts)))]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
