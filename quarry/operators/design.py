"""Design tables and decision rules over experiment cells: hypercubes, grids, truth tables, rule scores, labels and twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registered import query
from ..sources.tables import CELLS_SQL, cells, table

# Lowest, default and highest setting of the six parameters.
KNOB_RANGES = ((40.0, 85.0, 200.0), (75.0, 95.0, 110.0), (1.0, 4.0, 8.0), (1.5, 3.5, 5.5), (1.0, 2.0, 4.0), (1.5, 3.0, 5.5))
_LO, _HI = [r[0] for r in KNOB_RANGES], [r[2] for r in KNOB_RANGES]


def _numbers(n: int):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


@query(
    "a01_latin_hypercube",
    f"""WITH s AS (SELECT i, d, md5('7:' || d || ':' || i) AS h FROM range(500) t(i), range(6) k(d)),
r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY h, i) - 1 AS stratum FROM s)
SELECT i AS sample, d AS knob, stratum, round({_LO}[d + 1] + (stratum + ('0x' || substr(h, 1, 8))::BIGINT / 4294967296.0::DOUBLE) / 500 * ({_HI}[d + 1] - {_LO}[d + 1]), 9) AS v FROM r""",
)
def latin_hypercube(spark, sf_dir, n: int = 500, seed: int = 7):
    """n samples of the six parameters, each in another of n strata of every parameter; the order and the place within a stratum
    come from a digest of seed, parameter and sample, so that the design is the same on any cluster."""
    one = spark.range(n).select(F.col("id").alias("sample"), F.explode(_numbers(6)).alias("knob"))
    h = one.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "knob", "sample")))
    ranked = h.withColumn("stratum", F.row_number().over(Window.partitionBy("knob").orderBy("h", "sample")).cast("long") - 1)
    low, high = (F.get(F.array(*map(F.lit, x)), F.col("knob").cast("int")) for x in (_LO, _HI))
    within = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return ranked.select("sample", "knob", "stratum", F.round(low + (F.col("stratum") + within) / n * (high - low), 9).alias("v"))


def _levels(r):
    low, default, high = r
    return [low, (default + low) / 2, default, (default + high) / 2, high]


_DEFAULTS, _GRID = [r[1] for r in KNOB_RANGES], [_levels(r) for r in KNOB_RANGES]


@query("a03_pair_grids", f"SELECT i, j, a, b, [CASE WHEN k = i THEN {_GRID}[k + 1][a + 1] WHEN k = j THEN {_GRID}[k + 1][b + 1] ELSE {_DEFAULTS}[k + 1] END for k in range(6)]::DOUBLE[]::VARCHAR AS knobs FROM range(6) x(i), range(6) y(j), range(5) p(a), range(5) q(b) WHERE i < j")
def pair_grids(spark, sf_dir):
    """Grids of five by five levels for each pair of parameters, the others at their defaults."""
    pairs = spark.range(6).select(F.col("id").alias("i"), F.explode(_numbers(6)).alias("j")).filter("i < j")
    grid = pairs.select("*", F.explode(_numbers(5)).alias("a")).select("*", F.explode(_numbers(5)).alias("b"))
    level = lambda k, at: F.get(F.array(*map(F.lit, _GRID[k])), F.col(at).cast("int"))
    knobs = [F.when(F.col("i") == k, level(k, "a")).when(F.col("j") == k, level(k, "b")).otherwise(F.lit(_DEFAULTS[k])) for k in range(6)]
    return grid.select("i", "j", "a", "b", F.concat(F.lit("["), F.concat_ws(", ", *[x.cast("string") for x in knobs]), F.lit("]")).alias("knobs"))


# The ridges of the first two parameters, and how much of a setting beyond 1 the others take.
RIDGES, BEYOND = (192.86, 108.15), (0.7, 0.8)


def _beyond(x: str, share: float) -> str:
    return f"(CASE WHEN {x} <= 1 THEN {x} ELSE 1 + ({x} - 1) * {share} END)"


_KNOB_SQL = {f"p{k + 1}": f"least(greatest({d} + ({r} - {d}) * (1 - 2 * s), greatest(0, 2 * {d} - {r})), {r})" for k, (d, r) in enumerate(zip((85.0, 95.0), RIDGES, strict=True))}
_KNOB_SQL |= {"p3": f"4 * {_beyond('a', BEYOND[0])}", "p4": "d", "p5": f"2 * {_beyond('k', BEYOND[1])}", "p6": f"greatest(0, 3 * {_beyond('a', BEYOND[0])} + 3 * {_beyond('k', BEYOND[1])} - 3)"}
_KNOB_SQL = [f"round(CAST({v} AS DOUBLE), 7) AS {k}" for k, v in _KNOB_SQL.items()]
_SETTINGS = ["least(greatest(l_discount * 12 - 0.1, 0), 1) AS s", "least(greatest(l_tax * 30 - 0.2, 0), 2) AS a", "least(greatest(l_quantity / 20, 0.5), 2) AS k", "least(greatest(l_quantity / 8, 1.5), 5.5) AS d"]


@query("f24_knob_settings", f"SELECT l_orderkey, l_linenumber, {', '.join(_KNOB_SQL)} FROM (SELECT l_orderkey, l_linenumber, {', '.join(_SETTINGS)} FROM lineitem)")
def knob_settings(spark, sf_dir):
    """Four settings, kept in their ranges, as the six parameters that they stand for."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_SETTINGS).selectExpr("l_orderkey", "l_linenumber", *_KNOB_SQL)


@query("u05_combinations", f"WITH {CELLS_SQL} SELECT count(DISTINCT effort) * count(DISTINCT strategy) * count(DISTINCT params) AS cells FROM cells")
def combinations(spark, sf_dir):
    """Number of cells of the full design: the product of the axes' sizes."""
    axes = cells(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in ("effort", "strategy", "params")])).alias("x"))
    return axes.select("x.*").distinct().groupBy("axis").count().agg(F.round(F.product("count")).cast("long").alias("cells"))


# Fixed value: share of bytes that the smaller form must save.
WIN_MARGIN = 0.02
_TRUTH_SQL = f"""truth AS (SELECT l_orderkey, image, effort, distance, bytes, butter, best, need, need IS NOT NULL AS reachable, need / bytes::DOUBLE AS ratio, coalesce(need / bytes::DOUBLE < 1 - {WIN_MARGIN}::DOUBLE, false) AS admissible
FROM (SELECT *, (SELECT min(b.bytes) FROM cells b WHERE b.strategy <> 'N' AND b.image = a.image AND b.effort = a.effort AND b.butter <= a.butter) AS need, (SELECT min(b.butter) FROM cells b WHERE b.strategy <> 'N' AND b.image = a.image AND b.effort = a.effort) AS best FROM cells a WHERE strategy = 'N') WHERE best IS NOT NULL)"""


def truth(spark, sf_dir):
    """For each cell of full size: the least bytes of the smaller form at no larger distance, from one ordered pass over a group."""
    group = Window.partitionBy("image", "effort")
    upto = group.orderBy("butter").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    small = F.col("strategy") != "N"
    x = cells(spark, sf_dir).filter("strategy IS NOT NULL AND butter IS NOT NULL")
    x = x.withColumn("need", F.min(F.when(small, F.col("bytes"))).over(upto)).withColumn("best", F.min(F.when(small, F.col("butter"))).over(group))
    x = x.filter(~small & F.col("best").isNotNull()).withColumn("ratio", F.col("need") / F.col("bytes").cast("double"))
    return x.select("l_orderkey", "image", "effort", "distance", "bytes", "butter", "best", "need", F.col("need").isNotNull().alias("reachable"), "ratio", F.coalesce(F.col("ratio") < F.lit(1 - WIN_MARGIN), F.lit(False)).alias("admissible"))


@query("a17_admission_truth", f"WITH {CELLS_SQL}, {_TRUTH_SQL} SELECT l_orderkey, image, effort, distance, bytes, butter, best, need, reachable, round(ratio, 9) AS ratio, admissible FROM truth")
def admission_truth(spark, sf_dir):
    return truth(spark, sf_dir).withColumn("ratio", F.round("ratio", 9))


RULES = (1.0, 2.0, 3.0, 4.0, 4.9, 9.0)
_RULE_SQL = "count(*) FILTER (WHERE distance >= t)"


@query(
    "a18_rule_scores",
    f"""WITH {CELLS_SQL}, {_TRUTH_SQL} SELECT t, {_RULE_SQL} AS n, round({_RULE_SQL} / count(*)::DOUBLE, 9) AS cov, round(avg(ratio) FILTER (WHERE distance >= t), 9) AS mean_r, round(max(ratio) FILTER (WHERE distance >= t), 9) AS worst_r,
count(*) FILTER (WHERE distance >= t AND NOT reachable) AS unreach, round(count(*) FILTER (WHERE distance >= t AND admissible) / nullif({_RULE_SQL}, 0)::DOUBLE, 9) AS prec, round(coalesce(sum(1 - ratio) FILTER (WHERE distance >= t), 0), 6) AS saved
FROM truth, (SELECT unnest({list(RULES)})::DOUBLE AS t) GROUP BY t""",
)
def rule_scores(spark, sf_dir):
    """Decision rules (distance at least t) against the truth: all rules in one aggregation, reduced before the shuffle."""
    x = truth(spark, sf_dir).withColumn("t", F.explode(F.array(*map(F.lit, RULES))))
    taken = F.col("distance") >= F.col("t")
    n = F.count(F.when(taken, 1))
    return x.groupBy("t").agg(
        n.alias("n"), F.round(n / F.count("*"), 9).alias("cov"), F.round(F.avg(F.when(taken, F.col("ratio"))), 9).alias("mean_r"), F.round(F.max(F.when(taken, F.col("ratio"))), 9).alias("worst_r"),
        F.count(F.when(taken & ~F.col("reachable"), 1)).alias("unreach"), F.round(F.count(F.when(taken & F.col("admissible"), 1)) / F.nullif(n, F.lit(0)), 9).alias("prec"), F.round(F.coalesce(F.sum(F.when(taken, 1 - F.col("ratio"))), F.lit(0.0)), 6).alias("saved"),
    )


_LAST_SQL = "last AS (SELECT image, effort, strategy, max(struct_pack(l_orderkey, bytes, quality, params)) AS x FROM cells GROUP BY ALL)"


def arms(spark, sf_dir, *names: str):
    """image, effort and the last cell (l_orderkey, bytes, quality, params) of each named arm: one aggregation, no join of arms."""
    last = F.struct("l_orderkey", "bytes", "quality", "params")
    return cells(spark, sf_dir).groupBy("image", "effort").agg(*[F.max(F.when(F.col("strategy") == n, last)).alias(n) for n in names])


@query("a21_image_labels", f"WITH {CELLS_SQL}, {_LAST_SQL} SELECT a.image, bool_and(a.x.quality >= r.x.quality AND a.x.bytes <= r.x.bytes) AS good FROM last a JOIN last n USING (image, effort) JOIN last r USING (image, effort) WHERE a.strategy = 'A' AND n.strategy = 'N' AND r.strategy = 'R' AND a.x.bytes <> n.x.bytes GROUP BY a.image")
def image_labels(spark, sf_dir):
    """Whether all cells of an image whose output changed are no worse and no larger than the reference's."""
    fired = arms(spark, sf_dir, "A", "N", "R").filter("A.bytes <> N.bytes AND R IS NOT NULL")
    return fired.groupBy("image").agg(F.bool_and(F.expr("A.quality >= R.quality AND A.bytes <= R.bytes")).alias("good"))


_HASH = "CASE WHEN {a}.params % 3 > 0 THEN md5(CAST({a}.params AS {s})) END"


@query("a23_changed_outputs", f"WITH {CELLS_SQL}, {_LAST_SQL}, b AS (SELECT image, effort, a.x AS p, r.x AS q FROM last a JOIN last r USING (image, effort) WHERE a.strategy = 'A' AND r.strategy = 'R') SELECT image, effort, coalesce({_HASH.format(a='p', s='VARCHAR')} <> {_HASH.format(a='q', s='VARCHAR')}, p.bytes <> q.bytes) AS changed FROM b")
def changed_outputs(spark, sf_dir):
    """Whether two arms differ: by their hashes if both have one, else by their bytes."""
    hashed = [_HASH.format(a=a, s="STRING") for a in "AR"]
    return arms(spark, sf_dir, "A", "R").filter("A IS NOT NULL AND R IS NOT NULL").select("image", "effort", F.expr(f"coalesce({hashed[0]} <> {hashed[1]}, A.bytes <> R.bytes)").alias("changed"))


@query("j03_paired_keys", f"WITH {CELLS_SQL}, k AS (SELECT image, effort, bool_or(strategy = 'A') AS a, bool_or(strategy = 'R') AS r FROM cells GROUP BY ALL) SELECT count(*) FILTER (WHERE a AND r) AS paired, count(*) FILTER (WHERE a AND NOT r) AS only_a, count(*) FILTER (WHERE r AND NOT a) AS only_r FROM k")
def paired_keys(spark, sf_dir):
    """Whether two arms hold the same keys: those in both, and those missing in either."""
    k = arms(spark, sf_dir, "A", "R").select(F.col("A").isNotNull().alias("a"), F.col("R").isNotNull().alias("r"))
    return k.agg(F.count_if(F.expr("a AND r")).alias("paired"), F.count_if(F.expr("a AND NOT r")).alias("only_a"), F.count_if(F.expr("r AND NOT a")).alias("only_r"))


@query(
    "j06_twins",
    f"""WITH {CELLS_SQL}, c AS (SELECT image, effort, strategy, l_orderkey, distance, bytes // 10000 AS size, params % 4 AS sha FROM cells),
t AS (SELECT image, effort, strategy, round(distance, 4) AS d, max(struct_pack(l_orderkey, size, sha)) AS x FROM c WHERE strategy <> 'A' GROUP BY ALL)
SELECT CASE WHEN s.x.size = a.size AND s.x.sha = a.sha THEN 'smaller' WHEN f.x.size = a.size AND f.x.sha = a.sha THEN 'full' ELSE 'neither' END AS twin, count(*) AS n FROM c a
LEFT JOIN t s ON s.strategy = 'R' AND s.image = a.image AND s.effort = a.effort AND s.d = round(a.distance * 0.25 + 0.25, 4)
LEFT JOIN t f ON f.strategy = 'N' AND f.image = a.image AND f.effort = a.effort AND f.d = round(a.distance, 4) WHERE a.strategy = 'A' GROUP BY 1""",
)
def twins(spark, sf_dir):
    """Cells of the automatic mode by the cell that they repeat: the smaller form at its inner distance, the full form, or neither."""
    c = cells(spark, sf_dir).select("image", "effort", "strategy", "l_orderkey", "distance", F.expr("bytes div 10000").alias("size"), (F.col("params") % 4).alias("sha"))
    last = c.filter("strategy IN ('N', 'R')").groupBy("image", "effort", "strategy", F.round("distance", 4).alias("d")).agg(F.max(F.struct("l_orderkey", "size", "sha")).alias("x"))
    side = lambda s, at, name: last.filter(F.col("strategy") == s).select("image", "effort", F.col("d").alias(at), F.col("x").alias(name))
    auto = c.filter("strategy = 'A'").withColumn("inner_d", F.round(F.col("distance") * 0.25 + 0.25, 4)).withColumn("own_d", F.round("distance", 4))
    met = auto.join(side("R", "inner_d", "s"), ["image", "effort", "inner_d"], "left").join(side("N", "own_d", "f"), ["image", "effort", "own_d"], "left")
    kind = F.when(F.expr("s.size = size AND s.sha = sha"), "smaller").when(F.expr("f.size = size AND f.sha = sha"), "full").otherwise("neither")
    return met.groupBy(kind.alias("twin")).agg(F.count("*").alias("n"))


_TURN = "{x} - floor({x} / (2 * pi())) * 2 * pi()"
_SIDE = f"floor(({_TURN.format(x='(-atan2(cy - my, cx - mx) + 5 * pi() / 4)')}) * 2 / pi())"
_ANGLE = _TURN.format(x="(atan2(gy - my, gx - mx) + pi() / 4 + side * pi() / 2)")


@query(
    "t05_centre_first",
    f"""WITH i AS (SELECT p_partkey AS image, p_size % 4 + 1 AS xs, p_size // 4 % 4 + 1 AS ys FROM part), c AS (SELECT *, (xs * 256 - image % 200) // 2 AS cx, (ys * 256 - image % 130) // 2 AS cy FROM i),
m AS (SELECT *, cx // 256 * 256 + 128 AS mx, cy // 256 * 256 + 128 AS my FROM c), s AS (SELECT *, {_SIDE} AS side, unnest(range(xs * ys)) AS g FROM m), p AS (SELECT *, g % xs * 256 + 128 AS gx, g // xs * 256 + 128 AS gy FROM s)
SELECT image, g, row_number() OVER (PARTITION BY image ORDER BY greatest(abs(gx - mx), abs(gy - my)), {_ANGLE}, g) - 1 AS place FROM p""",
)
def centre_first(spark, sf_dir):
    """The groups of 256 by 256 samples of an image, by rings around its centre's group, each ring by angle from the centre's side."""
    x = table(spark, sf_dir, "part").selectExpr("p_partkey AS image", "p_size % 4 + 1 AS xs", "p_size div 4 % 4 + 1 AS ys")
    x = x.selectExpr("*", "(xs * 256 - image % 200) div 2 AS cx", "(ys * 256 - image % 130) div 2 AS cy").selectExpr("*", "cx div 256 * 256 + 128 AS mx", "cy div 256 * 256 + 128 AS my")
    x = x.selectExpr("*", f"{_SIDE} AS side", "explode(sequence(0L, CAST(xs * ys - 1 AS BIGINT))) AS g").selectExpr("*", "g % xs * 256 + 128 AS gx", "g div xs * 256 + 128 AS gy")
    place = F.row_number().over(Window.partitionBy("image").orderBy(F.expr("greatest(abs(gx - mx), abs(gy - my))"), F.expr(_ANGLE), "g"))
    return x.select("image", "g", (place - 1).cast("long").alias("place"))
