"""Experiment analytics: merging, stratification, fronts, curves and verdicts over cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registered import query
from ..sources.tables import CELLS_SQL, cells, table
from .statistics import quantiles


@query("u01_merge_keep_last", f"WITH {CELLS_SQL} SELECT image, effort, strategy, distance, params, bytes FROM (SELECT *, row_number() OVER (PARTITION BY image, effort, strategy ORDER BY l_orderkey DESC, bytes DESC, params DESC, distance DESC) AS k FROM cells) WHERE k = 1")
def merge_keep_last(spark, sf_dir):
    """Of cells with one configuration, the last; as a maximum, so that partitions reduce before the shuffle."""
    last = F.max(F.struct("l_orderkey", "bytes", "params", "distance")).alias("x")
    return cells(spark, sf_dir).groupBy("image", "effort", "strategy").agg(last).select("image", "effort", "strategy", "x.distance", "x.params", "x.bytes")


@query("missing_cells", f"WITH {CELLS_SQL}, i AS (SELECT DISTINCT image FROM cells), s AS (SELECT DISTINCT strategy FROM cells), e AS (SELECT DISTINCT effort FROM cells) SELECT image, effort, strategy FROM i, e, s EXCEPT SELECT image, effort, strategy FROM cells")
def missing_cells(spark, sf_dir):
    """Planned cells without a result: every image by the grid of efforts and strategies, less the cells that exist."""
    have = cells(spark, sf_dir).select("image", "effort", "strategy").distinct()
    grid = have.agg(F.collect_set("effort").alias("efforts"), F.collect_set("strategy").alias("strategies"))  # one row: the levels of two factors
    plan = have.select("image").distinct().crossJoin(F.broadcast(grid)).select("image", "strategies", F.explode("efforts").alias("effort"))
    plan = plan.select("image", "effort", F.explode("strategies").alias("strategy"))
    return plan.join(have, ["image", "effort", "strategy"], "left_anti")


@query(
    "u07_pareto_front",
    f"""WITH {CELLS_SQL} SELECT DISTINCT image, bytes, quality FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.image = a.image
AND b.bytes <= a.bytes AND b.quality >= a.quality AND (b.bytes < a.bytes OR b.quality > a.quality))""",
)
def pareto_front(spark, sf_dir):
    """Cells of an image that no other beats in both bytes and quality: one ordered pass, not pairs."""
    best = cells(spark, sf_dir).groupBy("image", "bytes").agg(F.max("quality").alias("quality"))
    before = Window.partitionBy("image").orderBy("bytes").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("b", F.max("quality").over(before)).filter("b IS NULL OR quality > b").select("image", "bytes", "quality")


_BAND = "CASE WHEN distance < 1 THEN 'low' WHEN distance < 2.5 THEN 'mid' ELSE 'high' END"


@query(
    "g38_band_summary",
    f"""WITH {CELLS_SQL} SELECT {_BAND} AS band, strategy, count(*) AS n, round(avg(bytes), 4) AS mean_bytes, round(quantile_cont(bytes, 0.25), 4) AS p25_bytes, round(median(bytes), 4) AS median_bytes, round(quantile_cont(bytes, 0.75), 4) AS p75_bytes,
round(quantile_cont(butter, 0.9), 6) AS p90_butter, round(regr_slope(quality, distance), 8) AS slope, round(corr(bytes, distance), 8) AS r FROM cells GROUP BY ALL""",
)
def band_summary(spark, sf_dir):
    """Cells of each band and strategy: bytes' mean and quartiles, the metric's ninth tenth, slope and correlation."""
    band = F.when(F.col("distance") < 1, "low").when(F.col("distance") < 2.5, "mid").otherwise("high")
    c, keys = cells(spark, sf_dir).withColumn("band", band), ["band", "strategy"]
    t = c.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("bytes"), 4).alias("mean_bytes"), F.round(F.regr_slope("quality", "distance"), 8).alias("slope"), F.round(F.corr("bytes", "distance"), 8).alias("r"))
    points = {"p25_bytes": 0.25, "median_bytes": 0.5, "p75_bytes": 0.75}
    b = quantiles(c, keys, F.col("bytes"), points).select(*keys, *[F.round(p, 4).alias(p) for p in points])
    p = quantiles(c, keys, F.col("butter"), {"p90_butter": 0.9}).withColumn("p90_butter", F.round("p90_butter", 6))
    return t.join(b, keys).join(p, keys)


@query("cell_totals", f"WITH {CELLS_SQL} SELECT coalesce(strategy, 'TOTAL') AS strategy, coalesce(CAST(effort AS VARCHAR), 'TOTAL') AS effort, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM cells GROUP BY ROLLUP (strategy, effort)")
def totals_rollup(spark, sf_dir):
    t = cells(spark, sf_dir).rollup("strategy", "effort").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return t.select(F.coalesce("strategy", F.lit("TOTAL")).alias("strategy"), F.coalesce(F.col("effort").cast("string"), F.lit("TOTAL")).alias("effort"), "n", "bytes")


_SIDES = {"a": "A", "n": "N", "r": "R"}


@query(
    "g36_strategy_pivot",
    f"""WITH {CELLS_SQL} SELECT effort, count(*) AS cells, {', '.join(f"CAST(sum(bytes) FILTER (strategy = '{v}') AS BIGINT) AS {k}, round(avg(bytes) FILTER (strategy = '{v}'), 4) AS mean_{k}, count(*) FILTER (strategy = '{v}' AND quality >= 95) AS good_{k}" for k, v in _SIDES.items())} FROM cells GROUP BY effort""",
)
def strategy_pivot(spark, sf_dir):
    """Bytes, their mean, and cells of quality 95 or more, of each strategy beside the others."""
    own = lambda v, x: F.when(F.col("strategy") == v, x)
    columns = [f for k, v in _SIDES.items() for f in (F.sum(own(v, F.col("bytes"))).alias(k), F.round(F.avg(own(v, F.col("bytes"))), 4).alias(f"mean_{k}"), F.count_if((F.col("strategy") == v) & (F.col("quality") >= 95)).alias(f"good_{k}"))]
    return cells(spark, sf_dir).groupBy("effort").agg(F.count("*").alias("cells"), *columns)


@query("curve_rises", f"WITH {CELLS_SQL}, c AS (SELECT image, distance, min(bytes) AS b FROM cells GROUP BY ALL), l AS (SELECT image, b - lag(b) OVER (PARTITION BY image ORDER BY distance) AS s FROM c) SELECT image, count(s) AS steps, CAST(sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rises, max(s) AS worst FROM l GROUP BY image")
def monotonicity(spark, sf_dir):
    """Steps of a curve of bytes by distance that rise where they should fall."""
    c = cells(spark, sf_dir).groupBy("image", "distance").agg(F.min("bytes").alias("b"))
    s = c.select("image", (F.col("b") - F.lag("b").over(Window.partitionBy("image").orderBy("distance"))).alias("s"))
    return s.groupBy("image").agg(F.count("s").alias("steps"), F.sum(F.when(F.col("s") > 0, 1).otherwise(0)).alias("rises"), F.max("s").alias("worst"))


@query("w19_residualise", f"WITH {CELLS_SQL}, m AS (SELECT image, avg(quality) AS q FROM cells GROUP BY image) SELECT strategy, effort, round(avg(c.quality - m.q), 8) AS mean_residual, round(var_pop(c.quality - m.q), 8) AS variance FROM cells c JOIN m USING (image) GROUP BY ALL")
def residualise(spark, sf_dir):
    """Quality less its image's mean, by strategy and effort."""
    c = cells(spark, sf_dir)
    m = c.groupBy("image").agg(F.avg("quality").alias("q"))
    r = F.col("quality") - F.col("q")
    return c.join(m, "image").groupBy("strategy", "effort").agg(F.round(F.avg(r), 8).alias("mean_residual"), F.round(F.var_pop(r), 8).alias("variance"))


@query("t02_top_images", f"WITH {CELLS_SQL} SELECT strategy, image, bytes FROM (SELECT strategy, image, CAST(sum(bytes) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY strategy ORDER BY sum(bytes) DESC, image) AS k FROM cells GROUP BY strategy, image) WHERE k <= 10")
def top_images(spark, sf_dir):
    """The ten images of each strategy with most bytes: a report of the top ten."""
    t = cells(spark, sf_dir).groupBy("strategy", "image").agg(F.sum("bytes").alias("bytes"))
    k = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("bytes"), "image"))
    return t.withColumn("k", k).filter("k <= 10").select("strategy", "image", "bytes")


@query("x08_frame_clock", "SELECT user_id, event_id, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ticks, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS frame FROM events")
def frame_clock(spark, sf_dir):
    """Frames of a sequence with the running sum of their durations."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.sum(F.floor("value").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ticks"), F.row_number().over(w).alias("frame"))


@query("event_parameters", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_parameters(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return table(spark, sf_dir, "events").groupBy(k, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
