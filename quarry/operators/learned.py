"""Stages with learned models over all experiment cells: boosted trees with folds, dependence surfaces, a low-rank basis of gradients,
and shares of variance by nested least squares."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boosting
from ..functions.boosting import BINS, Model
from ..registered import query
from ..sources import tables
from ..sources.tables import CELLS_SQL, table

#: Columns of a cell: two axes, then four parameters.
COLUMNS = ("distance", "effort", "p1", "p2", "p3", "p4")
AXES, PARAMETERS = (0, 1), (2, 3, 4, 5)
OUTCOMES = ("log_bytes", "log_charge")
BANDS = ("low", "mid", "high", "very_high")
FOLDS = 3


def cells(spark, sf_dir) -> DataFrame:
    """Cells from lineitem with columns, outcomes (of the price, and of quantity with discount and tax), band of the distance, fold (by a hash of the row's keys) and key. Rows with a null are left out."""
    t = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice").cast("double")
    distance = F.col("l_quantity").cast("double") / 10
    out = t.select(
        distance.alias("distance"), (F.col("l_linenumber") + 2).cast("double").alias("effort"), F.col("l_tax").cast("double").alias("p1"), F.col("l_discount").cast("double").alias("p2"),
        (F.col("l_partkey") % 1000).cast("double").alias("p3"), (F.floor(F.col("l_partkey") / 10) % 20001).cast("double").alias("p4"),
        F.log(F.greatest(price, F.lit(1.0))).alias("log_bytes"), F.log(F.greatest(F.col("l_quantity").cast("double"), F.lit(1.0)) * (1 - F.col("l_discount").cast("double")) * (1 + F.col("l_tax").cast("double"))).alias("log_charge"),
        F.when(distance < 1, "low").when(distance < 2, "mid").when(distance < 3.5, "high").otherwise("very_high").alias("band"),
        (F.crc32(F.encode(F.concat_ws("-", "l_orderkey", "l_linenumber"), "UTF-8")) % FOLDS).cast("int").alias("fold"), "l_orderkey", "l_linenumber",
    )
    return out.dropna()


def binned(t: DataFrame) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Cells with x0, x1, ... (equal bins between the extremes), y0, y1, flags (bit f: not in fold f; 8 + f: in fold f; 16: all; 20 + b: in band b); and
    the extremes of each column."""
    ends = t.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(COLUMNS) for n, f in (("a", F.min), ("b", F.max))]).first()
    ends = [(float(ends[f"a{i}"] or 0.0), float(ends[f"b{i}"] or 0.0)) for i in range(len(COLUMNS))]
    place = lambda c, a, b: F.least(F.floor((F.col(c) - F.lit(a)) / F.lit((b - a) or 1.0) * BINS), F.lit(BINS - 1)).cast("int")
    of_fold = [(1 << 16) + sum(1 << (8 + g if f == g else g) for g in range(FOLDS)) for f in range(FOLDS)]
    of_band = F.element_at(F.create_map(*[F.lit(x) for b, name in enumerate(BANDS) for x in (name, 1 << 20 + b)]), F.col("band"))
    flags = F.get(F.array(*[F.lit(x) for x in of_fold]), F.col("fold")).cast("long") + of_band.cast("long")  # one use of a fold, which is a hash
    n = t.sparkSession.sparkContext.defaultParallelism
    t = t.repartition(n) if t.rdd.getNumPartitions() < n else t
    out = t.select(*[place(c, a, b).alias(f"x{i}") for i, (c, (a, b)) in enumerate(zip(COLUMNS, ends, strict=True))], *[F.col(c).alias(f"y{i}") for i, c in enumerate(OUTCOMES)], flags.alias("flags"))
    return out, ends


def _fitted(spark, sf_dir, models: list[Model]):
    data, ends = binned(cells(spark, sf_dir))
    return data, ends, boosting.fit(data, models, len(COLUMNS), len(OUTCOMES))


@query("a07_boosted_fits")
def boosted_fits(spark, sf_dir):
    """R² of boosted trees on the rows they are fitted to and on the held-out fold: with all columns (each fold held out once) and with the
    parameters alone (first fold)."""
    every = tuple(range(len(COLUMNS)))
    models = [Model(f"all/{f}", o, f, every) for o in range(2) for f in range(FOLDS)] + [Model("parameters/0", o, 0, PARAMETERS) for o in range(2)]
    data, _, models = _fitted(spark, sf_dir, models)
    rows = []
    for r in boosting.scores(data, models, [8 + m.flag for m in models], len(COLUMNS), len(OUTCOMES)):
        m, spread_ = models[r["m"]], r["ss"] - r["s"] ** 2 / r["n"] if r["n"] else 0.0
        rows.append((m.name.split("/")[0], OUTCOMES[m.outcome], int(m.name.split("/")[1]), bool(r["held_out"]), int(r["n"]), round(1 - r["e"] / spread_, 6) if spread_ > 0 else None))
    return spark.createDataFrame(rows, "inputs string, outcome string, fold int, held_out boolean, n long, r2 double")


def _surfaces(models: list[Model], ends) -> list[tuple]:
    rows = []
    for m in models:
        for one, two in combinations(PARAMETERS, 2):
            s = boosting.dependence(m, (one, two))
            middle = lambda c: ends[c][0] + (np.arange(BINS) + 0.5) * (ends[c][1] - ends[c][0]) / BINS
            kind, added, times, gating, twist = boosting.surface_class(s, middle(one), middle(two))
            rows.append((m.name, OUTCOMES[m.outcome], COLUMNS[one], COLUMNS[two], kind, float(s.min()), float(s.max()), added, times, gating, twist))
    return [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]


_SURFACE = "model string, outcome string, one string, two string, class string, low double, high double, additive_left double, multiplicative_left double, gating double, twist double"


@query("a09_dependence")
def dependence(spark, sf_dir):
    """Surfaces of a model's mean prediction by every two parameters: extremes and class."""
    data, ends, models = _fitted(spark, sf_dir, [Model("all", o, 16, tuple(range(len(COLUMNS)))) for o in range(2)])
    return spark.createDataFrame(_surfaces(models, ends), _SURFACE)


@query("a11_band_dependence")
def band_dependence(spark, sf_dir):
    """The same with a model for each band of the distance."""
    models = [Model(name, 0, 20 + b, tuple(range(len(COLUMNS)))) for b, name in enumerate(BANDS)]
    data, ends, models = _fitted(spark, sf_dir, models)
    return spark.createDataFrame(_surfaces([m for m in models if m.trees[0].rows[0]], ends), _SURFACE)


@query("a12_gradient_basis")
def gradient_basis(spark, sf_dir):
    """Singular values of the models' gradients by the parameters: taken at one cell for each band and effort (that with the least keys), its
    parameters in the middle, by central differences of two bins; a row of an outcome is over that outcome's mean square."""
    t = cells(spark, sf_dir)
    data, ends, models = _fitted(spark, sf_dir, [Model("all", o, 16, tuple(range(len(COLUMNS)))) for o in range(2)])
    at = t.groupBy("band", "effort").agg(F.min_by(F.struct(*COLUMNS[:2]), F.struct("l_orderkey", "l_linenumber")).alias("c")).select("c.*").collect()  # bands by efforts
    if not at:
        return spark.createDataFrame([], "component int, singular double, share double, cumulative double, anchors int")
    place = lambda c, x: min(int((x - ends[c][0]) / ((ends[c][1] - ends[c][0]) or 1.0) * BINS), BINS - 1)
    base = np.array([[place(0, r["distance"]), place(1, r["effort"]), *[BINS // 2] * len(PARAMETERS)] for r in sorted(at)]).T
    blocks = []
    for m in models:
        g = np.empty((base.shape[1], len(PARAMETERS)))
        for k, c in enumerate(PARAMETERS):
            up, down = base.copy(), base.copy()
            up[c] += 2
            down[c] -= 2
            g[:, k] = (m.predict(up) - m.predict(down)) / 4
        size = np.sqrt((g**2).mean())
        blocks.append(g / size if size > 0 else g)
    values = np.linalg.svd(np.concatenate(blocks), compute_uv=False)
    share = values**2 / max((values**2).sum(), 1e-300) * 100
    return spark.createDataFrame([(k + 1, round(float(v), 6), round(float(s), 6), round(float(c), 6), base.shape[1]) for k, (v, s, c) in enumerate(zip(values, share, np.cumsum(share), strict=True))], "component int, singular double, share double, cumulative double, anchors int")


# ---------------------------------------------------------------- nested least squares


def gram(t: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of all products of two columns (doubles without nulls): each task adds up its rows, and Spark the tasks' matrices."""
    n = len(columns)

    def run(batches):
        total = np.zeros((n, n))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in columns])
            total += x @ x.T
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((n, n))
    for r in t.select(*columns).mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # columns by columns
        out[r["i"], r["j"]] = r["v"]
    return out


def left_over(g: np.ndarray, use: list[int], y: int) -> float:
    """Sum of squares of column y that a least-squares fit of the columns `use` leaves, from the products alone. Columns that depend on others are harmless."""
    if not use:
        return float(g[y, y])
    a, b = g[np.ix_(use, use)], g[use, y]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    solved = np.linalg.lstsq(a / scale[:, None] / scale, b / scale, rcond=1e-12)[0] / scale
    return float(g[y, y] - b @ solved)


def type_two(g: np.ndarray, terms: dict[tuple[str, ...], list[int]], y: int) -> dict[tuple[str, ...], float]:
    """What each term explains beyond all terms that do not hold it. terms: the columns of a term, by the names of its factors; () is the constant."""
    out = {}
    for term in terms:
        if not term:
            continue
        others = [k for t, own in terms.items() if not set(term) <= set(t) for k in own]
        out[term] = left_over(g, others, y) - left_over(g, others + terms[term], y)
    return out


@query("t01_variance_by_terms")
def variance_by_terms(spark, sf_dir):
    """Type II sums of squares of the outcomes by effort (as a class), distance, parameters and their products, as shares of all that
    is explained or left; one matrix of products serves all models."""
    own = cells(spark, sf_dir)
    efforts = sorted(r[0] for r in own.select("effort").distinct().collect())  # seven
    mean = own.agg(*[f(c).alias(f"{n}_{c}") for c in (*COLUMNS, *OUTCOMES) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = lambda c: (F.col(c) - F.lit(mean[f"m_{c}"] or 0.0)) / F.lit(mean[f"s_{c}"] or 1.0)
    made, terms = [F.lit(1.0).alias("one")], {(): [0]}

    def add(term, columns):
        terms[term] = list(range(len(made), len(made) + len(columns)))
        made.extend([c.alias(f"c{k}") for c, k in zip(columns, terms[term], strict=True)])

    is_effort = [F.when(F.col("effort") == e, 1.0).otherwise(0.0) for e in efforts[1:]]
    add(("effort",), is_effort)
    add(("distance",), [z("distance")])
    names = [COLUMNS[c] for c in PARAMETERS]
    for p in names:
        add((p,), [z(p)])
    for a, b in combinations(names, 2):
        add((a, b), [z(a) * z(b)])
    for p in names:
        add((p, "effort"), [z(p) * e for e in is_effort])
    first = len(made)
    made.extend((F.col(c) - F.lit(mean[f"m_{c}"] or 0.0)).alias(c) for c in OUTCOMES)
    columns = ["one", *[f"c{k}" for k in range(1, first)], *OUTCOMES]
    g = gram(own.select(*made), columns)
    rows = []
    for k, outcome in enumerate(OUTCOMES):
        rest = left_over(g, list(range(first)), first + k)
        shares = {**type_two(g, terms, first + k), ("residual",): rest}
        whole = sum(shares.values()) or 1.0
        rows += [(outcome, ":".join(t), len(terms.get(t, [])), round(v, 4), round(100 * v / whole, 4)) for t, v in shares.items()]
    return spark.createDataFrame(rows, "outcome string, term string, columns int, sum_sq double, pct double")


@query(
    "g33_two_factors",
    f"""WITH {CELLS_SQL}, c AS (SELECT strategy, CAST(effort AS DOUBLE) AS a, CAST(distance AS DOUBLE) AS b, ln(CAST(bytes AS DOUBLE)) AS y FROM cells WHERE bytes > 0),
s AS (SELECT strategy, count(*) AS n, covar_pop(a, a) * count(*) AS saa, covar_pop(b, b) * count(*) AS sbb, covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby, covar_pop(y, y) * count(*) AS syy FROM c GROUP BY strategy),
t AS (SELECT strategy, n, (say - sby * sab / sbb) ** 2 / (saa - sab * sab / sbb) AS effort_sq, (sby - say * sab / saa) ** 2 / (sbb - sab * sab / saa) AS distance_sq, syy - (say * say * sbb - 2 * say * sby * sab + sby * sby * saa) / (saa * sbb - sab * sab) AS residual_sq FROM s)
SELECT strategy, n, round(effort_sq, 4) AS effort_sq, round(distance_sq, 4) AS distance_sq, round(residual_sq, 4) AS residual_sq FROM t""",
)
def two_factors(spark, sf_dir):
    """Type II sums of squares of two factors by strategy, from its products alone: one pass, one sum."""
    c = tables.cells(spark, sf_dir).filter("bytes > 0").select("strategy", F.col("effort").cast("double").alias("a"), F.col("distance").cast("double").alias("b"), F.log(F.col("bytes").cast("double")).alias("y"))
    product = lambda x, y: (F.covar_pop(x, y) * F.count("*")).alias(f"s{x}{y}")
    s = c.groupBy("strategy").agg(F.count("*").alias("n"), *[product(x, y) for x, y in ("aa", "bb", "ab", "ay", "by", "yy")])
    saa, sbb, sab, say, sby, syy = (F.col(k) for k in ("saa", "sbb", "sab", "say", "sby", "syy"))
    effort = F.pow(say - sby * sab / sbb, 2) / (saa - sab * sab / sbb)
    distance = F.pow(sby - say * sab / saa, 2) / (sbb - sab * sab / saa)
    residual = syy - (say * say * sbb - 2 * say * sby * sab + sby * sby * saa) / (saa * sbb - sab * sab)
    return s.select("strategy", "n", F.round(effort, 4).alias("effort_sq"), F.round(distance, 4).alias("distance_sq"), F.round(residual, 4).alias("residual_sq"))
