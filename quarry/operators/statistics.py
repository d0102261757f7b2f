"""Statistics of experiment cells. Values are counted before they are ordered, so that a window holds the distinct values
of a group and not its rows."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registered import query
from ..sources.tables import CELLS_SQL, cells, table


def _counted(spark, sf_dir, value):
    """Distinct values of each image with their number, the running number and the image's total."""
    c = cells(spark, sf_dir).groupBy("image", value).agg(F.count("*").alias("n"))
    w = Window.partitionBy("image").orderBy(value)
    return c.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy("image"))})


def quantiles(rows, keys: list[str], value, points: dict[str, float], name: str = "value_"):
    """Quantiles of a column by keys, between the two values nearest in rank where the rank is not whole. Values are counted before they are ordered;
    nulls have no rank."""
    c = rows.withColumn(name, value).filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*keys)
    c = c.withColumns({"upto_": F.sum("n_").over(w.orderBy(name)), "total_": F.sum("n_").over(w)})
    rank = lambda q: F.lit(q) * (F.col("total_") - 1)
    at = lambda r: F.min(F.when(F.col("upto_") > r, F.col(name)))
    ends = c.groupBy(*keys).agg(F.max("total_").alias("total_"), *[f for p, q in points.items() for f in (at(F.floor(rank(q))).alias(f"{p}_low"), at(F.ceil(rank(q))).alias(f"{p}_high"))])
    part = lambda q: rank(q) - F.floor(rank(q))
    return ends.select(*keys, *[(F.col(f"{p}_low") + part(q) * (F.col(f"{p}_high") - F.col(f"{p}_low"))).alias(p) for p, q in points.items()])


@query("w18_average_rank", f"WITH {CELLS_SQL}, r AS (SELECT image, quality, rank() OVER (PARTITION BY image ORDER BY quality) + (count(*) OVER (PARTITION BY image, quality) - 1) / 2.0 AS r FROM cells) SELECT image, quality, count(*) AS n, avg(r) AS rank FROM r GROUP BY ALL")
def average_rank(spark, sf_dir):
    """Rank of each value of an image, the mean one for equal values."""
    n = F.col("n")
    return _counted(spark, sf_dir, "quality").select("image", "quality", "n", (F.col("upto") - n + (n + 1) / 2).alias("rank"))


_SIGNED = "CASE WHEN n < 3 OR n * sxx = sx * sx OR n * syy = sy * sy THEN NULL ELSE round((n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 8) END"
_RHO = "CASE WHEN n < 3 OR n * sxx = sx * sx OR n * syy = sy * sy THEN 0.0 ELSE round(abs(n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 8) END"


@query(
    "g42_rank_correlation",
    f"""WITH {CELLS_SQL}, r AS (SELECT image, rank() OVER (PARTITION BY image ORDER BY bytes) + (count(*) OVER (PARTITION BY image, bytes) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY image ORDER BY quality) + (count(*) OVER (PARTITION BY image, quality) - 1) / 2.0 AS y FROM cells),
s AS (SELECT image, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM r GROUP BY image)
SELECT image, n, {_RHO} AS rho, {_SIGNED} AS signed FROM s""",
)
def rank_correlation(spark, sf_dir):
    """Rank correlation of bytes and quality for each image: absolute, 0 for fewer than three cells or a constant side; and signed,
    null there."""
    c = cells(spark, sf_dir).groupBy("image", "bytes", "quality").agg(F.count("*").alias("n"))

    def rank(value):
        w = Window.partitionBy("image").orderBy(value)
        peers = F.sum("n").over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - peers + (peers + 1) / 2

    r = c.withColumns({"x": rank("bytes"), "y": rank("quality")})
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    sums = {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    s = r.groupBy("image").agg(F.sum("n").alias("n"), *[F.sum(n * v).alias(k) for k, v in sums.items()])
    return s.select("image", "n", F.expr(_RHO).cast("double").alias("rho"), F.expr(_SIGNED).cast("double").alias("signed"))


@query("g41_linear_fit", f"WITH {CELLS_SQL} SELECT strategy, effort, count(*) AS n, round(regr_slope(bytes, distance), 4) AS slope, round(regr_intercept(bytes, distance), 3) AS intercept, round(regr_r2(bytes, distance), 8) AS r2 FROM cells GROUP BY ALL")
def linear_fit(spark, sf_dir):
    fit = lambda f, digits: F.round(f("bytes", "distance"), digits)
    return cells(spark, sf_dir).groupBy("strategy", "effort").agg(F.count("*").alias("n"), fit(F.regr_slope, 4).alias("slope"), fit(F.regr_intercept, 3).alias("intercept"), fit(F.regr_r2, 8).alias("r2"))


@query(
    "g39_trimmed_mean",
    f"""WITH {CELLS_SQL}, r AS (SELECT image, bytes, row_number() OVER (PARTITION BY image ORDER BY bytes) AS k, count(*) OVER (PARTITION BY image) AS n FROM cells)
SELECT image, round(avg(bytes), 6) AS mean FROM r WHERE k > n // 10 AND k <= n - n // 10 GROUP BY image""",
)
def trimmed_mean(spark, sf_dir):
    """Mean without the lowest and highest tenth of an image's cells."""
    cut = F.floor(F.col("total") / 10)
    inside = F.greatest(F.least("upto", F.col("total") - cut) - F.greatest(F.col("upto") - F.col("n"), cut), F.lit(0))
    c = _counted(spark, sf_dir, "bytes").withColumn("m", inside)
    return c.groupBy("image").agg(F.round(F.sum(F.col("bytes") * F.col("m")) / F.sum("m"), 6).alias("mean"))


@query(
    "g12_nearest_rank",
    f"""WITH {CELLS_SQL}, r AS (SELECT image, bytes, row_number() OVER (PARTITION BY image ORDER BY bytes) AS k, count(*) OVER (PARTITION BY image) AS n FROM cells)
SELECT image, bytes AS p95 FROM r WHERE k = (95 * n + 99) // 100""",
)
def nearest_rank(spark, sf_dir):
    """The smallest value that at least 95 % of an image's cells do not exceed."""
    c = _counted(spark, sf_dir, "bytes").filter("100 * upto >= 95 * total")
    return c.groupBy("image").agg(F.min("bytes").alias("p95"))


@query("g40_rate_quartiles", f"WITH {CELLS_SQL} SELECT image, round(quantile_cont(bytes / distance, 0.25), 6) AS p25, round(quantile_cont(bytes / distance, 0.5), 6) AS p50, round(quantile_cont(bytes / distance, 0.75), 6) AS p75, round(max(bytes / distance), 6) AS top FROM cells GROUP BY image")
def rate_quartiles(spark, sf_dir):
    """Quartiles and maximum of the bytes for each unit of distance."""
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "top": 1.0}
    q = quantiles(cells(spark, sf_dir), ["image"], F.col("bytes") / F.col("distance"), points)
    return q.select("image", *[F.round(p, 6).alias(p) for p in points])


@query(
    "j01_reference_match",
    f"""WITH {CELLS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY image, effort, strategy ORDER BY l_orderkey DESC, bytes DESC, distance DESC) AS k FROM cells)
SELECT a.image, a.effort, a.bytes AS bytes_a, r.bytes AS bytes_r, a.distance = r.distance AS matched FROM k a JOIN k r ON a.image = r.image AND a.effort = r.effort AND a.strategy = 'A' AND r.strategy = 'R' AND a.k = 1 AND r.k = 1""",
)
def reference_match(spark, sf_dir):
    """The last cell of strategy A beside that of R, and whether their distances agree; both sides come from one aggregation."""
    last = lambda s: F.max(F.when(F.col("strategy") == s, F.struct("l_orderkey", "bytes", "distance"))).alias(s)
    t = cells(spark, sf_dir).groupBy("image", "effort").agg(last("A"), last("R")).filter("A IS NOT NULL AND R IS NOT NULL")
    return t.select("image", "effort", F.col("A.bytes").alias("bytes_a"), F.col("R.bytes").alias("bytes_r"), (F.col("A.distance") == F.col("R.distance")).alias("matched"))


@query(
    "j02_key_difference",
    f"""WITH {CELLS_SQL}, a AS (SELECT DISTINCT image, effort, 1 AS a FROM cells WHERE strategy = 'A'), r AS (SELECT DISTINCT image, effort, 1 AS r FROM cells WHERE strategy = 'R')
SELECT effort, count(*) FILTER (a = 1 AND r = 1) AS common, count(*) FILTER (r IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_r FROM a FULL JOIN r USING (image, effort) GROUP BY effort""",
)
def key_difference(spark, sf_dir):
    """Keys of strategies A and R that both have, or one alone."""
    has = lambda s: F.bool_or(F.col("strategy") == s).alias(s)
    t = cells(spark, sf_dir).groupBy("image", "effort").agg(has("A"), has("R")).filter("A OR R")
    return t.groupBy("effort").agg(F.count_if(F.expr("A AND R")).alias("common"), F.count_if(F.expr("NOT R")).alias("only_a"), F.count_if(F.expr("NOT A")).alias("only_r"))


@query(
    "w20_top_bottom",
    f"""WITH {CELLS_SQL}, k AS (SELECT effort, image, bytes, row_number() OVER (PARTITION BY effort ORDER BY bytes DESC, image) AS t, row_number() OVER (PARTITION BY effort ORDER BY bytes, image) AS b FROM cells)
SELECT 'top' AS side, CAST(t AS INT) AS k, effort, image, bytes FROM k WHERE t <= 5 UNION ALL SELECT 'bottom', CAST(b AS INT), effort, image, bytes FROM k WHERE b <= 5""",
)
def top_bottom(spark, sf_dir):
    """The five cells with most and with fewest bytes of each effort: a report of top and bottom five."""

    def first(side, *order):
        k = F.row_number().over(Window.partitionBy("effort").orderBy(*order))
        return cells(spark, sf_dir).select("effort", "image", "bytes").withColumn("k", k).filter("k <= 5").select(F.lit(side).alias("side"), "k", "effort", "image", "bytes")

    return first("top", F.desc("bytes"), "image").unionByName(first("bottom", "bytes", "image"))


@query("w22_latest_nearest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 100), event_id DESC) AS k FROM events WHERE isfinite(value)) WHERE k = 1")
def latest_nearest(spark, sf_dir):
    """Of each user the event nearest to the target of 100; of equally near ones the latest."""
    e = table(spark, sf_dir, "events").filter("NOT isnan(value) AND abs(value) < double('Infinity')")
    best = F.min(F.struct(F.abs(F.col("value") - 100).alias("d"), (-F.col("event_id")).alias("k"))).alias("x")
    return e.groupBy("user_id").agg(best).select("user_id", (-F.col("x.k")).alias("event_id"))


@query("u02_first_of_fingerprint", f"WITH {CELLS_SQL} SELECT fp, image, l_orderkey FROM (SELECT fp, image, l_orderkey, row_number() OVER (PARTITION BY fp ORDER BY image, l_orderkey) AS k FROM (SELECT sha256(concat_ws('|', effort, strategy, params)) AS fp, image, l_orderkey FROM cells)) WHERE k = 1")
def first_of_fingerprint(spark, sf_dir):
    """Of cells with one effective configuration, the first."""
    fp = F.sha2(F.concat_ws("|", "effort", "strategy", "params"), 256).alias("fp")
    return cells(spark, sf_dir).groupBy(fp).agg(F.min(F.struct("image", "l_orderkey")).alias("x")).select("fp", "x.image", "x.l_orderkey")


@query("u08_front_minima", f"WITH {CELLS_SQL} SELECT DISTINCT image, distance, bytes FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.image = a.image AND b.bytes <= a.bytes AND b.distance <= a.distance AND (b.bytes < a.bytes OR b.distance < a.distance))")
def front_minima(spark, sf_dir):
    """Front of an image where both bytes and distance are to be small."""
    best = cells(spark, sf_dir).groupBy("image", "distance").agg(F.min("bytes").alias("bytes"))
    before = Window.partitionBy("image").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("b", F.min("bytes").over(before)).filter("b IS NULL OR bytes < b").select("image", "distance", "bytes")


@query(
    "u11_dominated_cells",
    f"""WITH {CELLS_SQL} SELECT image, count(*) AS n, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM cells b WHERE b.image = a.image AND b.bytes <= a.bytes
AND b.quality >= a.quality AND (b.bytes < a.bytes OR b.quality > a.quality)) THEN 1 ELSE 0 END) AS BIGINT) AS dominated FROM cells a GROUP BY image""",
)
def dominated_cells(spark, sf_dir):
    """Cells of an image that another beats: better quality at equal bytes, or as good at fewer."""
    c = cells(spark, sf_dir).groupBy("image", "bytes", "quality").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image").orderBy("bytes")
    best = lambda lo, hi: F.max("quality").over(w.rangeBetween(lo, hi))
    c = c.withColumns({"same": best(0, 0), "fewer": best(Window.unboundedPreceding, -1)})
    beaten = F.expr("same > quality OR coalesce(fewer >= quality, false)")
    return c.groupBy("image").agg(F.sum("n").alias("n"), F.sum(F.when(beaten, F.col("n")).otherwise(0)).alias("dominated"))


@query(
    "a22_threshold_curve",
    f"""WITH {CELLS_SQL}, t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS t)
SELECT t, count(*) FILTER (quality / 100 >= t) AS blocked, count(*) FILTER (quality / 100 >= t AND strategy = 'R') AS bad, count(*) FILTER (quality / 100 >= t AND strategy <> 'R') AS good,
round(count(*) FILTER (quality / 100 >= t AND strategy = 'R') / nullif(count(*) FILTER (quality / 100 >= t), 0), 8) AS precision FROM cells, t GROUP BY t""",
)
def threshold_curve(spark, sf_dir):
    """What each threshold of a score blocks. Cells are counted by score before they meet the thresholds."""
    c = cells(spark, sf_dir).groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("strategy") == "R").alias("bad"))
    c = c.select((F.col("quality") / 100).alias("s"), "n", "bad", F.explode(F.array(*map(F.lit, (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95)))).alias("t"))
    over = lambda x: F.sum(F.when(F.col("s") >= F.col("t"), F.col(x)).otherwise(0))
    c = c.groupBy("t").agg(over("n").alias("blocked"), over("bad").alias("bad"))
    return c.select("t", "blocked", "bad", (F.col("blocked") - F.col("bad")).alias("good"), F.round(F.try_divide("bad", "blocked"), 8).alias("precision"))


@query(
    "g33_variance_shares",
    f"""WITH {CELLS_SQL}, t AS (SELECT sum(bytes::DOUBLE * bytes) - sum(bytes)::DOUBLE * sum(bytes)::DOUBLE / count(*) AS total, sum(bytes)::DOUBLE * sum(bytes)::DOUBLE / count(*) AS base FROM cells),
e AS (SELECT 'effort' AS factor, sum(s * s / n) AS b FROM (SELECT sum(bytes)::DOUBLE AS s, count(*) AS n FROM cells GROUP BY effort)),
g AS (SELECT 'strategy' AS factor, sum(s * s / n) AS b FROM (SELECT sum(bytes)::DOUBLE AS s, count(*) AS n FROM cells GROUP BY strategy))
SELECT factor, round((b - base) / total, 9) AS share FROM (SELECT * FROM e UNION ALL SELECT * FROM g), t""",
)
def variance_shares(spark, sf_dir):
    """Share of the variance of bytes that lies between the levels of each factor. One pass gives sums of all levels."""
    c = cells(spark, sf_dir).groupBy("effort", "strategy").agg(F.count("*").alias("n"), F.sum("bytes").cast("double").alias("s"), F.sum(F.col("bytes").cast("double") * F.col("bytes")).alias("q"))
    level = c.cube("effort", "strategy").agg(F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    between = lambda g: F.sum(F.when(F.col("g") == g, F.col("s") * F.col("s") / F.col("n")))
    t = level.agg(between(1).alias("effort"), between(2).alias("strategy"), between(3).alias("base"), F.max(F.when(F.col("g") == 3, F.col("q"))).alias("q"))
    t = t.select("base", (F.col("q") - F.col("base")).alias("total"), F.explode(F.create_map(F.lit("effort"), "effort", F.lit("strategy"), "strategy")).alias("factor", "b"))
    return t.select("factor", F.round((F.col("b") - F.col("base")) / F.col("total"), 9).alias("share"))


@query(
    "g34_mutual_information",
    f"""WITH {CELLS_SQL}, c AS (SELECT effort, strategy, count(*) AS n FROM cells GROUP BY ALL),
w AS (SELECT n, sum(n) OVER (PARTITION BY effort) AS e, sum(n) OVER (PARTITION BY strategy) AS s, sum(n) OVER () AS total FROM c)
SELECT round(sum(n / total * log2(n * total / (e * s))), 9) AS bits FROM w""",
)
def mutual_information(spark, sf_dir):
    """Mutual information of effort and strategy, from the counts of cells, margins and the total."""
    c = cells(spark, sf_dir).groupBy("effort", "strategy").agg(F.count("*").alias("n"))
    level = c.cube("effort", "strategy").agg(F.grouping_id().alias("g"), F.sum("n").cast("double").alias("n"))
    sign = F.when(F.col("g").isin(0, 3), 1).otherwise(-1)
    total = F.max(F.when(F.col("g") == 3, F.col("n")))
    return level.agg(F.round(F.sum(sign * F.col("n") * F.log2("n")) / total, 9).alias("bits"))


def pooled(rows):
    """Non-decreasing least-squares fit of (image, distance, y) in that order: neighbours of an image that fall are pooled. Yields
    the rows of each image with their fit."""
    image, held, pools = None, [], []

    def fits():
        return zip([image] * len(held), held, [s / n for s, n in pools for _ in range(n)], strict=True)

    for i, x, y in rows:
        if i != image:
            yield from fits()
            image, held, pools = i, [], []
        held.append(x)
        pools.append([y, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n]
    yield from fits()


@query(
    "w17_isotonic",
    f"""WITH {CELLS_SQL}, c AS (SELECT image, distance, avg(bytes) AS y FROM cells GROUP BY ALL),
k AS (SELECT *, row_number() OVER w AS i, sum(y) OVER w AS upto FROM c WINDOW w AS (PARTITION BY image ORDER BY distance)),
seg AS (SELECT a.image, a.i AS a, b.i AS b, (b.upto - a.upto + a.y) / (b.i - a.i + 1) AS m FROM k a JOIN k b ON a.image = b.image AND a.i <= b.i),
low AS (SELECT k.image, k.distance, seg.a, min(m) AS m FROM k JOIN seg ON k.image = seg.image AND seg.a <= k.i AND seg.b >= k.i GROUP BY ALL)
SELECT image, distance, round(max(m), 7) AS fit FROM low GROUP BY ALL""",
)
def isotonic_curves(spark, sf_dir):
    """Non-decreasing fit of each image's mean bytes by distance. Partitions hold whole images, in order, and are read as a
    stream, so that a worker holds the distinct distances of one image."""
    c = cells(spark, sf_dir).groupBy("image", "distance").agg(F.avg("bytes").alias("y"))

    def run(batches):
        rows = (r for batch in batches for r in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        found = pooled(rows)
        while own := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*own, strict=True)], names=["image", "distance", "fit"])

    return c.repartition("image").sortWithinPartitions("image", "distance").mapInArrow(run, "image long, distance double, fit double").withColumn("fit", F.round("fit", 7))


@query("a26_cell_summary", f"WITH {CELLS_SQL} SELECT image, effort, count(*) AS n, min(distance) AS least, round(median(bytes), 4) AS median_bytes, round(median(butter), 6) AS median_butter FROM cells GROUP BY ALL")
def cell_summary(spark, sf_dir):
    """Cells, least distance and medians by image and effort."""
    c, keys = cells(spark, sf_dir), ["image", "effort"]
    t = c.groupBy(*keys).agg(F.count("*").alias("n"), F.min("distance").alias("least"))
    for name, digits in (("bytes", 4), ("butter", 6)):
        q = quantiles(c, keys, F.col(name), {f"median_{name}": 0.5})
        t = t.join(q.withColumn(f"median_{name}", F.round(f"median_{name}", digits)), keys, "left")
    return t


@query(
    "a06_prepared_columns",
    f"""WITH {CELLS_SQL}, m AS (SELECT image, effort, avg(bytes) AS mean FROM cells GROUP BY ALL)
SELECT l_orderkey, image, effort, CASE WHEN distance < 1 THEN 'low' WHEN distance < 2.5 THEN 'mid' ELSE 'high' END AS band,
round(ln(greatest(bytes, 1)), 8) AS log_bytes, round(ln(greatest(butter, 0.000001)), 8) AS log_butter, round(bytes - mean, 6) AS residual FROM cells JOIN m USING (image, effort)""",
)
def prepared_columns(spark, sf_dir):
    """Columns for the analyses of cells: distance band, logarithms with a floor, and bytes less their group's mean."""
    c = cells(spark, sf_dir)
    m = c.groupBy("image", "effort").agg(F.avg("bytes").alias("mean"))
    band = F.when(F.col("distance") < 1, "low").when(F.col("distance") < 2.5, "mid").otherwise("high")
    log = lambda x, least: F.round(F.log(F.greatest(F.col(x), F.lit(least))), 8)
    return c.join(m, ["image", "effort"]).select("l_orderkey", "image", "effort", band.alias("band"), log("bytes", 1).alias("log_bytes"), log("butter", 0.000001).alias("log_butter"), F.round(F.col("bytes") - F.col("mean"), 6).alias("residual"))
