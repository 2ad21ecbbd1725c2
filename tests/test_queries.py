import pytest

from tests.oracle import differences
from weirflow import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_matches_sql(spark, sf_dir, name):
    query, sql = queries.QUERIES[name]
    assert not differences(spark, name, query, sql, sf_dir)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
