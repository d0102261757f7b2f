"""Reports over pairs of cells, where ties hang on the last bit of a mean: it is that of the sum in the order of the table's rows."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession

from quarry import registry
from quarry.registered import ORACLES

GROUPS = 3000


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="module")
def split_groups(tmp_path_factory):
    """Each group's rows in two files: one row of strategy A and one of R, then three of A in a larger file, so that neither partial
    sums nor the order in which tasks begin are the order of the rows."""
    path = tmp_path_factory.mktemp("split")
    (path / "lineitem.parquet").mkdir()
    rng = np.random.default_rng(3)
    for name, strategies in (("part-0", ("A", "R")), ("part-1", ("A", "A", "A"))):
        n = GROUPS * len(strategies)
        image = np.repeat(np.arange(GROUPS), len(strategies))
        pq.write_table(
            pa.table({
                "l_orderkey": np.arange(n), "l_partkey": image, "l_suppkey": image % 10, "l_linenumber": (image % 7 + 1).astype(np.int32), "l_quantity": np.full(n, 10.0), "l_extendedprice": rng.integers(900, 1100, n) + 0.5,
                "l_discount": rng.integers(0, 11, n) / 100, "l_tax": rng.integers(0, 9, n) / 100, "l_returnflag": list(strategies) * GROUPS,
            }),
            path / "lineitem.parquet" / f"{name}.parquet",
        )
    return str(path)


@pytest.mark.parametrize("name", ["f18_axes", "f22_calibrated", "g37_verdict_counts"])
def test_means_in_the_order_of_rows(spark, split_groups, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{split_groups}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, split_groups).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
