"""Every query with SQL, against DuckDB on the same tables."""

import math

import duckdb
import pytest
from pyspark.sql import SparkSession

from quarry import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR)
    want = duck.execute(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x) if not isinstance(x, float) else f"{x:.6f}") for x in r)
    left = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    right = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
    assert len(left) == len(right) > 0
    bad = [(x, y) for x, y in zip(left, right, strict=True) if not all(map(same, x, y))]
    assert not bad, bad[:3]


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
