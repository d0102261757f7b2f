"""Reports over paired cells: verdicts by axes with tie bands, front wins by backend, run-time ratios, matched sizes, coverage of a
front. Both sides of a pair come from one aggregation, so no report joins cells with cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registered import query
from ..sources.tables import CELLS_SQL, cells
from .statistics import quantiles

# Tie bands of the axes. Bytes in per cent; the two metrics absolute, or relative with a floor.
BYTES_TIE, NEAR, HIGHER_TIE, LOWER_RELATIVE, LOWER_FLOOR = 0.1, 2.0, 0.25, 0.02, 0.005

_PAIRS_SQL = f"""{CELLS_SQL}, pairs AS (SELECT image, effort, avg(bytes) FILTER (strategy = 'A') AS ours, avg(bytes) FILTER (strategy = 'R') AS theirs, avg(quality) FILTER (strategy = 'A') AS our_q,
avg(quality) FILTER (strategy = 'R') AS their_q, avg(butter) FILTER (strategy = 'A') AS our_b, avg(butter) FILTER (strategy = 'R') AS their_b FROM cells GROUP BY image, effort HAVING ours IS NOT NULL AND theirs IS NOT NULL)"""


def pairs(spark, sf_dir):
    """Strategy A ("ours") beside R ("theirs") of each image and effort that has both. Means are added up in the order of the table's rows:
    doubles add up to another last bit in another order, and on that bit hang the ties of the axes."""
    side = lambda c, s: F.avg(F.when(F.col("strategy") == s, F.col(c)))
    group = Window.partitionBy("image", "effort").orderBy("file", "row")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    means = {"ours": side("bytes", "A"), "theirs": side("bytes", "R"), "our_q": side("quality", "A"), "their_q": side("quality", "R"), "our_b": side("butter", "A"), "their_b": side("butter", "R")}
    t = cells(spark, sf_dir, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).filter("strategy IN ('A', 'R')")
    t = t.select("image", "effort", *[m.over(whole).alias(k) for k, m in means.items()], F.row_number().over(group).alias("place"))
    return t.filter("place = 1 AND ours IS NOT NULL AND theirs IS NOT NULL").drop("place")


#: Axes of a pair, in SQL that both engines read.
DELTA = "(ours - theirs) / theirs * 100"
BYTES_AXIS = f"CASE WHEN abs({DELTA}) < {BYTES_TIE} THEN 'TIE' WHEN ours < theirs THEN 'OURS' ELSE 'THEIRS' END"
LOWER_AXIS = f"CASE WHEN abs(our_b - their_b) <= greatest(abs(their_b) * {LOWER_RELATIVE}, {LOWER_FLOOR}) THEN 'TIE' WHEN our_b < their_b THEN 'OURS' ELSE 'THEIRS' END"
HIGHER_AXIS = f"CASE WHEN abs(our_q - their_q) <= {HIGHER_TIE} THEN 'TIE' WHEN our_q > their_q THEN 'OURS' ELSE 'THEIRS' END"
AGREED = "CASE WHEN low = high OR high = 'TIE' THEN low WHEN low = 'TIE' THEN high ELSE 'TIE' END"
VERDICT = "CASE WHEN 'OURS' IN (size, quality) AND 'THEIRS' IN (size, quality) THEN 'MIXED' WHEN 'THEIRS' IN (size, quality) THEN 'THEY-DOMINATE' WHEN 'OURS' IN (size, quality) THEN 'WE-DOMINATE' ELSE 'TIE' END"
CALIBRATED = f"CASE WHEN 'OURS' IN (low, high) AND delta > 0 AND NOT 'THEIRS' IN (low, high) THEN 'TRADEOFF' WHEN abs(delta) < {NEAR} AND NOT 'THEIRS' IN (low, high) THEN 'NEAR_TIE' ELSE 'REAL_LOSS' END"
_AXES_SQL = f"""{_PAIRS_SQL}, x AS (SELECT image, effort, {DELTA} AS delta, {BYTES_AXIS} AS size, {LOWER_AXIS} AS low, {HIGHER_AXIS} AS high FROM pairs),
y AS (SELECT *, {AGREED} AS quality, low <> high AND low <> 'TIE' AND high <> 'TIE' AS conflict FROM x), z AS (SELECT *, {VERDICT} AS verdict FROM y)"""


def axes(spark, sf_dir):
    """Pairs with the direction of every axis, the one that the metrics agree on, whether they conflict, and the verdict."""
    x = pairs(spark, sf_dir).selectExpr("image", "effort", f"{DELTA} AS delta", f"{BYTES_AXIS} AS size", f"{LOWER_AXIS} AS low", f"{HIGHER_AXIS} AS high")
    y = x.selectExpr("*", f"{AGREED} AS quality", "low <> high AND low <> 'TIE' AND high <> 'TIE' AS conflict")
    return y.selectExpr("*", f"{VERDICT} AS verdict")


@query("f18_axes", f"WITH {_AXES_SQL} SELECT image, effort, round(delta, 6) AS delta, size, low, high, quality, conflict, verdict FROM z")
def axis_directions(spark, sf_dir):
    """Directions by axis with the tie bands, the agreed quality axis, and the verdict (F17 to F21)."""
    return axes(spark, sf_dir).withColumn("delta", F.round("delta", 6))


@query("f22_calibrated", f"WITH {_AXES_SQL} SELECT image, effort, {CALIBRATED} AS calibrated FROM z WHERE verdict IN ('THEY-DOMINATE', 'MIXED')")
def calibrated(spark, sf_dir):
    """Lost and mixed pairs: a real loss, a trade of bytes for quality, or a near tie."""
    return axes(spark, sf_dir).filter("verdict IN ('THEY-DOMINATE', 'MIXED')").selectExpr("image", "effort", f"{CALIBRATED} AS calibrated")


_COUNTS = {"we_dominate": "WE-DOMINATE", "tie": "TIE", "mixed": "MIXED", "they_dominate": "THEY-DOMINATE"}


@query("g37_verdict_counts", f"WITH {_AXES_SQL} SELECT effort, {', '.join(f'''count(*) FILTER (verdict = '{v}') AS {k}''' for k, v in _COUNTS.items())}, count(*) AS n FROM z GROUP BY effort")
def verdict_counts(spark, sf_dir):
    """Verdicts by family (here the effort)."""
    return axes(spark, sf_dir).groupBy("effort").agg(*[F.count_if(F.col("verdict") == v).alias(k) for k, v in _COUNTS.items()], F.count("*").alias("n"))


_BACKENDS_SQL = f"""{CELLS_SQL}, b AS (SELECT image % 4 AS corpus, image, effort, strategy, round(avg(bytes), 6) AS bytes, round(avg(quality), 9) AS higher, round(avg(butter), 9) AS lower FROM cells GROUP BY ALL),
m AS (SELECT corpus, image, effort, strategy, bytes, unnest(['higher', 'lower']) AS metric, unnest([higher, -lower]) AS score FROM b),
w AS (SELECT *, NOT EXISTS (SELECT 1 FROM m o WHERE o.image = m.image AND o.effort = m.effort AND o.metric = m.metric AND o.bytes <= m.bytes AND o.score >= m.score AND (o.bytes < m.bytes OR o.score > m.score)) AS wins,
count(*) OVER (PARTITION BY image, effort, metric) AS n FROM m),
t AS (SELECT corpus, metric, strategy, count(*) FILTER (wins) AS wins FROM w WHERE n > 1 GROUP BY ALL), c AS (SELECT corpus, metric, count(DISTINCT (image, effort)) AS scored FROM w WHERE n > 1 GROUP BY ALL)"""


@query("j04_front_wins", f"WITH {_BACKENDS_SQL} SELECT corpus, metric, strategy, scored, wins, round(100.0 * wins / scored, 2) AS pct FROM t JOIN c USING (corpus, metric)")
def front_wins(spark, sf_dir):
    """How often a backend (strategy) is on the front of its cell, by corpus and metric, over cells with two backends or more.
    A cell's backends are as few as there are backends, and are compared within one row."""
    b = cells(spark, sf_dir).groupBy("image", "effort", "strategy").agg(F.round(F.avg("bytes"), 6).alias("bytes"), F.round(F.avg("quality"), 9).alias("higher"), (-F.round(F.avg("butter"), 9)).alias("lower"))
    cell = b.groupBy("image", "effort").agg(F.collect_list(F.struct("strategy", "bytes", "higher", "lower")).alias("all")).filter(F.size("all") > 1)

    def on_front(metric):
        beats = lambda o, m: (o["bytes"] <= m["bytes"]) & (o[metric] >= m[metric]) & ((o["bytes"] < m["bytes"]) | (o[metric] > m[metric]))
        return F.transform("all", lambda m: F.struct(F.lit(metric).alias("metric"), m["strategy"].alias("strategy"), (~F.exists("all", lambda o: beats(o, m))).alias("wins")))

    won = cell.select((F.col("image") % 4).alias("corpus"), F.explode(F.concat(on_front("higher"), on_front("lower"))).alias("w")).select("corpus", "w.*")
    t = won.groupBy("corpus", "metric", "strategy").agg(F.count_if("wins").alias("wins"))
    scored = cell.groupBy((F.col("image") % 4).alias("corpus")).agg(F.count("*").alias("scored"))
    return t.join(F.broadcast(scored), "corpus").select("corpus", "metric", "strategy", "scored", "wins", F.round(100.0 * F.col("wins") / F.col("scored"), 2).alias("pct"))


@query(
    "g35_backend_report",
    f"""WITH {CELLS_SQL}, r AS (SELECT strategy, distance, bytes, row_number() OVER (PARTITION BY strategy ORDER BY distance) - 1 AS k, count(*) OVER (PARTITION BY strategy) AS n FROM cells)
SELECT strategy, max(n) AS cells, max(distance) FILTER (k = n // 2) AS p50, max(distance) FILTER (k = CAST(floor(0.95 * (n - 1)) AS BIGINT)) AS p95, round(avg(distance), 6) AS mean, CAST(sum(bytes) AS BIGINT) AS total, round(avg(bytes), 4) AS average FROM r GROUP BY strategy""",
)
def backend_report(spark, sf_dir):
    """Cells, median and 95th percentile by index, mean, and bytes of each backend. Values are counted before they are ordered."""
    c = cells(spark, sf_dir).groupBy("strategy", "distance").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    by = Window.partitionBy("strategy")
    c = c.withColumns({"upto": F.sum("n").over(by.orderBy("distance")), "total": F.sum("n").over(by)})
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("distance")))
    r = c.groupBy("strategy").agg(F.max("total").alias("cells"), at(F.floor(F.col("total") / 2)).alias("p50"), at(F.floor(F.lit(0.95) * (F.col("total") - 1))).alias("p95"), (F.sum(F.col("distance") * F.col("n")) / F.max("total")).alias("mean"), F.sum("bytes").alias("total_bytes"))
    return r.select("strategy", "cells", "p50", "p95", F.round("mean", 6).alias("mean"), F.col("total_bytes").alias("total"), F.round(F.col("total_bytes") / F.col("cells"), 4).alias("average"))


@query(
    "a16_time_ratios",
    f"WITH {CELLS_SQL} SELECT effort, round(median(distance) FILTER (strategy = 'A'), 6) AS ours, round(median(distance) FILTER (strategy = 'R'), 6) AS theirs, round(median(distance) FILTER (strategy = 'A') / median(distance) FILTER (strategy = 'R'), 6) AS ratio, CAST(median(distance) FILTER (strategy = 'A') / median(distance) FILTER (strategy = 'R') <= 1.2 AS INT) AS within, min(distance) FILTER (strategy = 'A') AS our_least, min(distance) FILTER (strategy = 'R') AS their_least, count(*) AS n FROM cells GROUP BY effort",
)
def time_ratios(spark, sf_dir):
    """Median of either side, their ratio, whether it keeps within the budget of 1.2, and the least of either side."""
    c = cells(spark, sf_dir)
    side = lambda s: F.when(F.col("strategy") == s, F.col("distance"))
    t = c.groupBy("effort").agg(F.min(side("A")).alias("our_least"), F.min(side("R")).alias("their_least"), F.count("*").alias("n"))
    for name, s in (("o", "A"), ("t", "R")):
        t = t.join(quantiles(c, ["effort"], side(s), {name: 0.5}), "effort", "left")
    ratio = F.col("o") / F.col("t")
    return t.select("effort", F.round("o", 6).alias("ours"), F.round("t", 6).alias("theirs"), F.round(ratio, 6).alias("ratio"), (ratio <= 1.2).cast("int").alias("within"), "our_least", "their_least", "n")


_MATCH = 0.035


@query(
    "j05_matched_bytes",
    f"""WITH {CELLS_SQL}, c AS (SELECT image, butter, min(bytes) AS b FROM cells GROUP BY ALL), l AS (SELECT *, lead(butter) OVER w AS x2, lead(b) OVER w AS b2 FROM c WINDOW w AS (PARTITION BY image ORDER BY butter)),
k AS (SELECT image, max(CASE WHEN butter <= {_MATCH} AND x2 IS NULL THEN b WHEN butter <= {_MATCH} AND x2 > {_MATCH} THEN b + ({_MATCH}::DOUBLE - butter) / (x2 - butter) * (b2 - b) END) AS v FROM l GROUP BY image) SELECT image, round(v, 4) AS bytes FROM k""",
)
def matched_bytes(spark, sf_dir):
    """Bytes of every image's curve where its error meets the target: null below the curve's least error, flat beyond its
    greatest; of equal errors the fewest bytes."""
    c = cells(spark, sf_dir).groupBy("image", "butter").agg(F.min("bytes").alias("b"))
    w = Window.partitionBy("image").orderBy("butter")
    c = c.withColumns({"x2": F.lead("butter").over(w), "b2": F.lead("b").over(w)})
    below = F.col("butter") <= _MATCH
    between = F.col("b") + (F.lit(_MATCH) - F.col("butter")) / (F.col("x2") - F.col("butter")) * (F.col("b2") - F.col("b"))
    v = F.when(below & F.col("x2").isNull(), F.col("b").cast("double")).when(below & (F.col("x2") > _MATCH), between)
    return c.groupBy("image").agg(F.round(F.max(v), 4).alias("bytes"))


@query(
    "u09_front_coverage",
    f"""WITH {CELLS_SQL}, p AS (SELECT DISTINCT image, strategy, quality AS q, ln(bytes) AS b FROM cells), f AS (SELECT image, q, b FROM (SELECT DISTINCT image, q, b FROM p) p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.image = p.image AND o.b <= p.b AND o.q >= p.q AND (o.b < p.b OR o.q > p.q))),
d AS (SELECT f.image, f.q, f.b, greatest(0, f.q - p.q) AS dq, greatest(0, p.b - f.b) AS db FROM f JOIN p ON p.image = f.image AND p.strategy = 'A'),
k AS (SELECT image, dq, db, row_number() OVER (PARTITION BY image, q, b ORDER BY round(dq + 10 * db, 9), round(db, 9)) AS r FROM d)
SELECT image, round(max(dq), 6) AS most_quality, round((exp(max(db)) - 1) * 100, 5) AS most_pct, round(avg(dq), 6) AS mean_quality, round((exp(avg(db)) - 1) * 100, 5) AS mean_pct FROM k WHERE r = 1 GROUP BY image""",
)
def front_coverage(spark, sf_dir):
    """How far the nearest cell of strategy A falls short of each point of an image's front, in quality and in log bytes at
    a weight of 10: the most and the mean. A's own front is enough to find the nearest, so two fronts meet, not all cells."""
    p = cells(spark, sf_dir).select("image", "strategy", F.col("quality").alias("q"), F.log("bytes").alias("b"))

    def front(points):
        best = points.groupBy("image", "b").agg(F.max("q").alias("q"))
        before = Window.partitionBy("image").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        return best.withColumn("m", F.max("q").over(before)).filter("m IS NULL OR q > m").select("image", "q", "b")

    own = front(p.filter("strategy = 'A'")).groupBy("image").agg(F.collect_list(F.struct("q", "b")).alias("own"))
    zero = F.lit(0.0)

    def short(k):
        dq, db = F.greatest(zero, F.col("q") - k["q"]), F.greatest(zero, k["b"] - F.col("b"))
        return F.struct(F.round(dq + 10 * db, 9).alias("total"), F.round(db, 9).alias("r"), db.alias("db"), dq.alias("dq"))

    d = front(p).join(own, "image").select("image", F.array_min(F.transform("own", short)).alias("s")).select("image", "s.dq", "s.db")
    pct = lambda x: F.round((F.exp(x) - 1) * 100, 5)
    return d.groupBy("image").agg(F.round(F.max("dq"), 6).alias("most_quality"), pct(F.max("db")).alias("most_pct"), F.round(F.avg("dq"), 6).alias("mean_quality"), pct(F.avg("db")).alias("mean_pct"))
