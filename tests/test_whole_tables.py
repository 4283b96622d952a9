"""Queries that ask for a whole table give a result for each of its keys."""

from collections import Counter

import duckdb

from tessera.plans import catalogue
from tessera.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_every_key_of_base_has_its_group(spark):
    got = catalogue.queries()["boundary_groups_min1"](spark, SF)
    base = fx.base(spark, SF).select("key")
    assert got.count() == base.count() and not base.exceptAll(got.select("key")).count()


def test_lookups_ask_for_every_key(spark):
    run = lambda name: catalogue.queries()[name](spark, SF)
    files, base, changes = fx.files(spark, SF), fx.base(spark, SF), fx.changes(spark, SF)
    located = run("pack_locate_tristate")
    assert not files.select("key").exceptAll(located.select("key")).count()
    assert not located.where("key like 'absent/%' and outcome <> 'unknown'").count() and located.where("key like 'absent/%'").count()
    gone = changes.where("is_tombstone").select("key")
    live = base.select("key").union(changes.select("key")).distinct().join(gone, "key", "left_anti")
    assert not live.exceptAll(run("layered_point_get").select("key")).count()
    assert run("blinded_lookup").count() == files.select("hash").distinct().count()
    least = base.where("o_orderkey % 41 = 0").agg({"key": "min"}).first()[0]
    assert run("floor_seek").agg({"changes": "sum"}).first()[0] == base.where(base.key >= least).count()


def test_pages_that_share_a_url_are_asked_for_each(spark, tmp_path):
    rows = [(k, f"http://h/{k % 40}", "x" * (k % 7)) for k in range(1, 211)]
    rows += [(300, None, "x"), (301, None, None), (302, None, None), (None, "http://h/1", "y"), (303, "http://h/1", None), (303, "http://h/1", None), (421, "http://h/2", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalogue.queries()["http_refetch"](spark, str(tmp_path))
    want = duckdb.sql(catalogue.oracle_sql()["http_refetch"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
