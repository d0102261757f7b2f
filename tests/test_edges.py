"""Colour distance by hand, quantiles of odd groups, and all queries over tables with nulls, empty values, ties and repeated rows."""

import math
import shutil

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry import registry
from quarry.operators.statistics import quantiles
from quarry.operators.transfer import colour_distance_of
from tests.test_queries import DIR, TABLES, same


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def test_colour_distance_by_hand(spark):
    rows = [([10, 20, 30], [12, 18, 33]), ([0, 0, 0], [0, 0, 0]), ([200, 10, 0], [100, 10, 0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<int>, b array<int>").select(colour_distance_of("a", "b")).collect()]
    # weights 3, 5 and 2 + 1.12; 4 (2² 3² + 2² 5² + 3² 3.12²) + (160 - 159)²
    assert math.isclose(got[0], 4 * (36 + 100 + 9 * 3.12**2) + 1) and got[1] == 0
    assert math.isclose(got[2], 4 * 100**2 * 4.15**2 + 300**2)


def test_quantiles(spark):
    rows = [("a", 1.0), ("a", None), ("a", 4.0), ("a", 4.0), ("a", 10.0), ("b", 7.0), (None, 1.0), (None, 2.0), ("c", None)]
    got = {r["k"]: (r["p25"], r["p50"], r["p100"]) for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), {"p25": 0.25, "p50": 0.5, "p100": 1.0}).collect()}
    assert got == {"a": (3.25, 4.0, 10.0), "b": (7.0, 7.0, 7.0), None: (1.25, 1.5, 2.0)}


#: Texts without a character, of one, of equal ones, of other planes and scripts, and one as long as many rows.
TEXTS = [None, "", "a", "aa", "\n", "z" * 31, "z" * 32, "z" * 33, "ab" * 40, "é漢😀" * 30, "\x7f\x00\x01" * 9, " " * 70, "Long text, and longer. " * 150]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A few documents, odd ones, repeated texts; half a table of each other kind, some of its rows twice."""
    path = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for t in TABLES:
        shutil.copy(f"{DIR}/{t}.parquet", path / f"{t}.parquet")
    names = "doc_id, text, lang, source, n_chars"
    con.execute("CREATE TABLE odd (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO odd VALUES (?, ?)", list(enumerate(TEXTS, 10_000)) + [(20_000, TEXTS[-1]), (20_001, "a")])
    con.execute(f"COPY (SELECT {names} FROM '{DIR}/documents.parquet' WHERE doc_id < 12 UNION ALL SELECT doc_id, text, 'en', 'src0', length(text) FROM odd) TO '{path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{DIR}/lineitem.parquet' WHERE l_orderkey % 7 < 3 UNION ALL SELECT * REPLACE (l_orderkey + 1000000 AS l_orderkey) FROM '{DIR}/lineitem.parquet' WHERE l_orderkey % 7 = 0) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_tables(spark, odd, name):
    got = registry.QUERIES[name](spark, odd)
    rows = got.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    key = lambda r: tuple((x is None, str(x) if not isinstance(x, float) else f"{x:.6f}") for x in r)
    left = sorted((tuple(r[c] for c in names) for r in rows), key=key)
    right = sorted(want.fetchall(), key=key)
    assert len(left) == len(right)
    bad = [(x, y) for x, y in zip(left, right, strict=True) if not all(map(same, x, y))]
    assert not bad, bad[:3]
