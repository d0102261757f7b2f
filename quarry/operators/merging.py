"""Merging of batches with their own schemas, configurations that come to the same, and the search for a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registered import query
from ..sources.tables import CELLS_SQL, cells

#: The parts of a cell's key.
KEY = ("image", "effort", "band", "strategy", "params")


def batches(spark, sf_dir) -> list[DataFrame]:
    """Cells in three batches: the first has no metric, the second writes bytes as text, the third has them as whole doubles and a note."""
    c = cells(spark, sf_dir).withColumns({"band": F.floor("distance").cast("int"), "params": (F.col("params") % 3).cast("long")})
    part = lambda k: c.filter(F.col("l_orderkey") % 3 == k).withColumn("batch", F.lit(k))
    keep = [*KEY, "l_orderkey", "batch", "bytes"]
    return [part(0).select(*keep), part(1).select(*keep, "butter").withColumn("bytes", F.col("bytes").cast("string")), part(2).select(*keep, "butter", F.lit("late").alias("note")).withColumn("bytes", F.col("bytes").cast("double"))]


def promoted(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames; columns that a frame lacks are null in its rows, and a column whose types differ has the widest: whole numbers, doubles, else text
    (read as numbers where a frame has numbers)."""
    types: dict[str, set] = {}
    for f in frames:
        for name, kind in f.dtypes:
            types.setdefault(name, set()).add(kind)
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def widest(kinds: set) -> str:
        if len(kinds) == 1:
            return next(iter(kinds))
        found = [k for k in numbers if k in kinds]
        return ("double" if {"float", "double"} & kinds or kinds - set(numbers) else found[-1]) if found else "string"

    wide = {name: widest(kinds) for name, kinds in types.items()}
    out = None
    for f in frames:
        own = f.select(*[F.expr(f"try_cast(`{c}` AS {wide[c]})").alias(c) for c in f.columns])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


_FIVE = ", ".join(KEY)
_BATCH_SQL = f"""{CELLS_SQL}, k AS (SELECT image, effort, CAST(floor(distance) AS INT) AS band, strategy, CAST(params % 3 AS BIGINT) AS params, l_orderkey, CAST(l_orderkey % 3 AS INT) AS batch, CAST(bytes AS DOUBLE) AS bytes,
CASE WHEN l_orderkey % 3 > 0 THEN butter END AS butter, CASE WHEN l_orderkey % 3 = 2 THEN 'late' END AS note FROM cells)"""


@query("u01_merged_batches", f"WITH {_BATCH_SQL} SELECT {_FIVE}, batch, bytes, butter, note FROM (SELECT *, row_number() OVER (PARTITION BY {_FIVE} ORDER BY batch DESC, l_orderkey DESC, bytes DESC, butter DESC) AS r FROM k) WHERE r = 1")
def merged_batches(spark, sf_dir):
    """Batches as one table: of rows with one five-part key the one of the last batch (then the largest order key) stays. A maximum, so rows are
    reduced before the shuffle."""
    rows = promoted(batches(spark, sf_dir))
    last = F.max(F.struct("batch", "l_orderkey", "bytes", F.coalesce("butter", F.lit(float("-inf"))).alias("b"), "butter", "note")).alias("x")
    return rows.groupBy(*KEY).agg(last).select(*KEY, "x.batch", "x.bytes", "x.butter", "x.note")


@query(
    "u01_key_variance",
    f"""WITH {_BATCH_SQL}, g AS (SELECT {_FIVE}, count(*) AS n, count(DISTINCT bytes) AS distinct_bytes, max(bytes) - min(bytes) AS spread, avg(bytes) AS mean FROM k GROUP BY ALL)
SELECT strategy, count(*) AS keys, CAST(sum(n) AS BIGINT) AS cells, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (distinct_bytes > 1) AS differing, round(coalesce(max(100 * spread / mean) FILTER (n > 1), 0), 6) AS worst_pct FROM g GROUP BY strategy""",
)
def key_variance(spark, sf_dir):
    """Check of merged batches: keys with several cells, those whose bytes differ, and by how much of their mean at most."""
    g = promoted(batches(spark, sf_dir)).groupBy(*KEY).agg(F.count("*").alias("n"), F.min("bytes").alias("lo"), F.max("bytes").alias("hi"), F.avg("bytes").alias("mean"))
    off = F.max(F.when(F.col("n") > 1, 100 * (F.col("hi") - F.col("lo")) / F.col("mean")))
    return g.groupBy("strategy").agg(F.count("*").alias("keys"), F.sum("n").alias("cells"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("hi") > F.col("lo")).alias("differing"), F.round(F.coalesce(off, F.lit(0.0)), 6).alias("worst_pct"))


# ---------------------------------------------------------------- effective configurations

#: A candidate's overrides of four settings: null where it leaves one alone. SQL that both engines read.
_GIVEN = {
    "iters": "CASE WHEN params % 4 > 0 THEN params % 3 END",
    "tree": "CASE WHEN params % 5 > 1 THEN params % 5 END",
    "filter": "CASE WHEN params % 2 = 0 THEN params % 7 % 2 END",
    "seed": "CASE WHEN params % 11 = 0 THEN params % 3 END",
}
#: What a setting comes to where none is given, by effort; and what makes it idle: a setting that is not used is 0.
_LOSSY = {"iters": "CASE WHEN effort >= 7 THEN 2 ELSE 1 END", "tree": "2", "filter": "CASE WHEN effort >= 5 THEN 1 ELSE 0 END", "seed": "0"}
_LOSSY_USED = {"iters": "effort >= 5", "tree": "effort >= 4", "filter": "TRUE", "seed": "effort >= 8"}
_LOSSLESS = {"iters": "0", "tree": "CASE WHEN effort >= 8 THEN 4 ELSE 3 END", "filter": "0", "seed": "1"}
_LOSSLESS_USED = {"iters": "FALSE", "tree": "TRUE", "filter": "FALSE", "seed": "effort >= 6"}


def _effective(defaults: dict, used: dict) -> dict[str, str]:
    return {k: f"CASE WHEN {used[k]} THEN CAST(coalesce({_GIVEN[k]}, {defaults[k]}) AS BIGINT) ELSE 0 END" for k in _GIVEN}


def _configs_sql(defaults: dict, used: dict) -> str:
    e = _effective(defaults, used)
    text = " || ';' || ".join(["'effort=' || CAST(effort AS VARCHAR)", *[f"'{k}=' || CAST({k} AS VARCHAR)" for k in e]])
    return f"""WITH {CELLS_SQL}, e AS (SELECT l_orderkey, params, effort, {', '.join(f'{v} AS {k}' for k, v in e.items())} FROM cells), f AS (SELECT *, sha256({text}) AS fingerprint FROM e)
SELECT effort, {', '.join(e)}, fingerprint, min(params) AS first_params, count(*) AS candidates, count(DISTINCT params) AS distinct_params FROM f GROUP BY effort, {', '.join(e)}, fingerprint"""


def _configs(spark, sf_dir, defaults: dict, used: dict) -> DataFrame:
    e = _effective(defaults, used)
    c = cells(spark, sf_dir).select("effort", "params", *[F.expr(v).alias(k) for k, v in e.items()])
    # candidates are reduced before their settings are hashed
    found = c.groupBy("effort", *e, "params").agg(F.count("*").alias("n")).groupBy("effort", *e).agg(F.min("params").alias("first_params"), F.sum("n").alias("candidates"), F.count("*").alias("distinct_params"))
    text = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in ("effort", *e)])
    return found.select("effort", *e, F.sha2(text, 256).alias("fingerprint"), "first_params", "candidates", "distinct_params")


@query("u02_lossy_configurations", _configs_sql(_LOSSY, _LOSSY_USED))
def lossy_configurations(spark, sf_dir):
    """Configurations that lossy candidates come to: overrides over an effort's defaults, idle settings left out; the fingerprint of each, and its first candidate."""
    return _configs(spark, sf_dir, _LOSSY, _LOSSY_USED)


@query("u03_lossless_configurations", _configs_sql(_LOSSLESS, _LOSSLESS_USED))
def lossless_configurations(spark, sf_dir):
    """The same for lossless candidates, which use other settings."""
    return _configs(spark, sf_dir, _LOSSLESS, _LOSSLESS_USED)


# ---------------------------------------------------------------- search for a gate

#: Least leaves that are tried; what a gate may cost in bytes, at most and in the mean (percent).
LEAVES, BYTES_MOST, BYTES_MEAN = (0, 32, 64, 128, 192, 256, 384, 512, 768, 1024), 2000.0, 120.0
_LEAVES = "image * 37 % 1100"


@query(
    "a19_gate_search",
    f"""WITH {CELLS_SQL}, l AS (SELECT image, effort, strategy, max(struct_pack(k := l_orderkey, b := bytes, d := distance)) AS x FROM cells GROUP BY ALL),
p AS (SELECT n.image, n.effort, a.strategy AS arm, {_LEAVES.replace('image', 'n.image')} AS leaves, 100 * (a.x.b / CAST(n.x.b AS DOUBLE) - 1) AS b, 100 * (a.x.d / CAST(n.x.d AS DOUBLE) - 1) AS w FROM l n JOIN l a USING (image, effort) WHERE n.strategy = 'N' AND a.strategy IN ('A', 'R')),
s AS (SELECT arm, least_leaves, count(*) AS n, count(*) FILTER (leaves >= least_leaves) AS fired, avg(CASE WHEN leaves >= least_leaves THEN b ELSE 0 END) AS b_mean, max(CASE WHEN leaves >= least_leaves THEN b ELSE 0 END) AS b_max, avg(CASE WHEN leaves >= least_leaves THEN w ELSE 0 END) AS w_mean
FROM p, (SELECT unnest({list(LEAVES)}) AS least_leaves) GROUP BY ALL), o AS (SELECT *, b_max <= {BYTES_MOST} AND b_mean <= {BYTES_MEAN} AS ok FROM s)
SELECT arm, CAST(least_leaves AS INT) AS least_leaves, n, fired, round(b_mean, 6) AS b_mean, round(b_max, 6) AS b_max, round(w_mean, 6) AS w_mean, ok, ok AND row_number() OVER (PARTITION BY ok ORDER BY round(w_mean, 6), least_leaves, arm) = 1 AS chosen FROM o""",
)
def gate_search(spark, sf_dir):
    """Every gate (an arm, from so many leaves on; else the default arm): how often it fires, bytes and time against the default. Of those that keep within the bounds the one
    of least time is chosen (ties: fewer leaves, then the arm). All gates are one aggregation."""
    last = F.struct("l_orderkey", "bytes", "distance")
    c = cells(spark, sf_dir).groupBy("image", "effort").agg(*[F.max(F.when(F.col("strategy") == s, last)).alias(s) for s in "ANR"]).filter("N IS NOT NULL")
    pct = lambda a, x: (100 * (F.col(f"{a}.{x}") / F.col(f"N.{x}").cast("double") - 1))
    sides = [F.when(F.col(a).isNotNull(), F.struct(F.lit(a).alias("arm"), pct(a, "bytes").alias("b"), pct(a, "distance").alias("w"))) for a in "AR"]
    p = c.select(F.expr(_LEAVES).alias("leaves"), F.explode(F.array(*sides)).alias("s")).filter("s IS NOT NULL").select("leaves", "s.*")
    p = p.withColumn("least_leaves", F.explode(F.array(*map(F.lit, LEAVES))))
    fires = F.col("leaves") >= F.col("least_leaves")
    own = lambda x: F.when(fires, F.col(x)).otherwise(0.0)
    s = p.groupBy("arm", "least_leaves").agg(F.count("*").alias("n"), F.count_if(fires).alias("fired"), F.avg(own("b")).alias("b_mean"), F.max(own("b")).alias("b_max"), F.avg(own("w")).alias("w_mean"))
    s = s.withColumn("ok", (F.col("b_max") <= BYTES_MOST) & (F.col("b_mean") <= BYTES_MEAN)).withColumns({x: F.round(x, 6) for x in ("b_mean", "b_max", "w_mean")})
    first = Window.partitionBy("ok").orderBy("w_mean", "least_leaves", "arm")  # as many rows as gates
    return s.withColumn("chosen", F.col("ok") & (F.row_number().over(first) == 1))
