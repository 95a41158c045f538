import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the tables of the small scale as views."""
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(SMALL)):
        path = f"{SMALL}/{name}"
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{source}'")
    return con


def _plain(v):
    import datetime
    import decimal
    import math

    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}"))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="session")
def same_rows():
    """Asserts that a DataFrame and a DuckDB query have the same columns and rows, in any order."""

    def check(df, con, sql):
        names = sorted(df.columns)
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert names == sorted(columns)
        theirs = [tuple(_plain(dict(zip(columns, r))[n]) for n in names) for r in found.fetchall()]
        ours = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
        assert sorted(map(repr, ours)) == sorted(map(repr, theirs))

    return check
