import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from voxelry.session import session

    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Holds a query's rows against its SQL."""
    def check(query, sql):
        got, want = query(spark, sf_dir).toPandas(), duck.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        order = lambda d: d[columns].astype(str).sort_values(columns).reset_index(drop=True)
        a, b = order(got), order(want)
        assert len(a) == len(b)
        assert a.equals(b), a.compare(b).head()

    return check
