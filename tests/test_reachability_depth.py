"""A closure follows chains of any length."""

from tessera.operators import reachability


def test_a_chain_longer_than_64_rounds(spark):
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(67)], "parent string, child string").coalesce(1)
    assert reachability.closure(spark.createDataFrame([("0",)], "node string"), edges).count() == 68
