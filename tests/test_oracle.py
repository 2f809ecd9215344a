"""Every query of the reference's operators that has SQL, held against it."""

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from voxelry.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
