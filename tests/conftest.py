import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def same(df, con, sql, digits=6):
    """Rows of a Spark frame and of SQL, by column name, in any order; floats to some digits."""
    cols = sorted(df.columns)
    norm = lambda v: None if v is None or v != v else float(f"{v:.{digits}g}") + 0.0 if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    place = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in place) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-6 * max(1, abs(x)), (a, b)


@pytest.fixture(scope="session")
def agrees():
    return same
