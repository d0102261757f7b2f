"""Carriers: the test tables read as rasters, transform blocks and experiment cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raster width of a text.
WIDTH = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL for the samples of whole texts in long form: doc_id, p (position from 0), v (a character's code, modulo 256).
RASTER_SQL = """px AS (SELECT doc_id, unnest(range(len(c))) AS p, unnest(list_transform(c, lambda x: ascii(x) % 256)) AS v
FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 0))"""


#: SQL for a digest of a text's samples: their sum, weighted by position.
DIGEST = "CAST(sum(({}) * (p % 97 + 1)) AS BIGINT)"


#: SQL for the neighbours of every sample (al), the residuals of the clamped gradient (res) and their unsigned form (tok).
RESIDUAL_SQL = """nb AS (SELECT doc_id, p, v, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2, lag(v, 30) OVER w AS l30, lag(v, 31) OVER w AS l31,
lag(v, 32) OVER w AS l32, lag(v, 33) OVER w AS l33, lag(v, 64) OVER w AS l64 FROM px WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
lf AS (SELECT *, CASE WHEN p % 32 > 0 THEN l1 WHEN p >= 32 THEN l32 ELSE 0 END AS w FROM nb),
tp AS (SELECT *, CASE WHEN p >= 32 THEN l32 ELSE w END AS n, CASE WHEN p % 32 > 0 AND p >= 32 THEN l33 ELSE w END AS nw, CASE WHEN p % 32 > 1 THEN l2 ELSE w END AS ww FROM lf),
fr AS (SELECT *, CASE WHEN p % 32 < 31 AND p >= 32 THEN l31 ELSE n END AS ne, CASE WHEN p >= 64 THEN l64 ELSE n END AS nn FROM tp),
al AS (SELECT doc_id, p, v, w, n, nw, ne, ww, nn, CASE WHEN p % 32 < 30 AND p >= 32 THEN l30 ELSE ne END AS nee FROM fr),
res AS (SELECT doc_id, p, v - greatest(least(w, n), least(greatest(w, n), w + n - nw)) AS r FROM al),
tok AS (SELECT doc_id, p, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS u FROM res)"""


def cells(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Experiment cells from lineitem, and more columns of its rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("image"),
        (F.col("l_linenumber") + 2).cast("int").alias("effort"),
        (F.col("l_quantity") / 10).alias("distance"),
        F.col("l_returnflag").alias("strategy"),
        F.col("l_suppkey").alias("params"),
        F.floor("l_extendedprice").cast("long").alias("bytes"),
        (100 * (1 - F.col("l_discount"))).alias("quality"),
        F.col("l_tax").alias("butter"),
        "l_orderkey",
        *more,
    )


CELLS_SQL = """cells AS (SELECT l_partkey AS image, CAST(l_linenumber + 2 AS INT) AS effort, l_quantity / 10 AS distance,
l_returnflag AS strategy, l_suppkey AS params, CAST(floor(l_extendedprice) AS BIGINT) AS bytes, 100 * (1 - l_discount) AS quality,
l_tax AS butter, l_orderkey FROM lineitem)"""
