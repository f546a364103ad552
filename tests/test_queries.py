"""Every registered query against its SQL; those without SQL give rows."""

import pytest

from inkwell.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck, same):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        same(got, duck.sql(ORACLES[name]).df())
    else:
        assert len(got)
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["docnum", "score", "hits"]
