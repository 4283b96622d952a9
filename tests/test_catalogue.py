"""Every query of the catalogue against its SQL form, and the algorithms without one against their definitions."""

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(str(round(r[k], 6) if isinstance(r[k], float) else r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, con, name):
    got, want = catalogue.queries()[name](spark, SF), con.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    whole = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert not [(c, t) for c, t in got.dtypes if t in whole and whole[t] != kinds[c]]
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
