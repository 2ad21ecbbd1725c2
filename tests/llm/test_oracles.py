"""Queries that SQL can express, against their SQL."""

import pytest

from tests.oracle import differences
from weirflow.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    assert not differences(spark, name, queries.queries()[name], queries.oracle_sql()[name], sf_dir)
