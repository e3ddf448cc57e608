import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v if isinstance(v, (str, bytes, type(None))) else repr(v)


@pytest.fixture(scope="session")
def same_rows(spark, sf_dir, duck):
    """Compares a query with its SQL: equal columns, and equal rows in any order."""
    from collections import Counter

    def check(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
        found = duck.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

    return check
