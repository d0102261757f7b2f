"""Boosted trees, dependence surfaces and nested least squares against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quarry import registry
from quarry.functions import boosting
from quarry.functions.boosting import BINS, Model, Tree
from quarry.operators import learned

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def brute_fit(x, y, columns, trees, depth, rate, ridge, least):
    """Row by row, in fractions of 2 ** -20; a tree is nested tuples."""
    unit = 1 << 20
    base = sum(round(v * unit) for v in y) / len(y) / unit
    made, now = [], [base] * len(y)

    def grow(rows, g, level):
        total, n = sum(g[i] for i in rows), len(rows)
        value = rate * total / unit / (n + ridge)
        best = None
        if level < depth:
            for c in columns:
                for b in range(BINS - 1):
                    low = [i for i in rows if x[c][i] <= b]
                    if len(low) < least or n - len(low) < least:
                        continue
                    gl = sum(g[i] for i in low)
                    gain = float(gl) ** 2 / (len(low) + ridge) + float(total - gl) ** 2 / (n - len(low) + ridge) - float(total) ** 2 / (n + ridge)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, c, b)
        if best is None:
            return value
        _, c, b = best
        return c, b, grow([i for i in rows if x[c][i] <= b], g, level + 1), grow([i for i in rows if x[c][i] > b], g, level + 1)

    def predict(tree, i):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]][i] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        g = [round(v * unit) - round(p * unit) for v, p in zip(y, now, strict=True)]
        made.append(grow(list(range(len(y))), g, 0))
        now = [p + predict(made[-1], i) for i, p in enumerate(now)]
    return base, made


def nested(t: Tree, at=0):
    if t.column[at] < 0:
        return float(t.value[at])
    return int(t.column[at]), int(t.cut[at]), nested(t, 2 * at + 1), nested(t, 2 * at + 2)


def close(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    return a[:2] == b[:2] and close(a[2], b[2]) and close(a[3], b[3]) if isinstance(a, tuple) else math.isclose(a, b, abs_tol=1e-9)


def test_trees_equal_a_plain_learner(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = rng.integers(0, BINS, (3, n))
    x[2] = rng.integers(0, 3, n)
    y = np.stack([np.where(x[0] > 11, 2.0, -1.0) + 0.1 * x[1] + rng.normal(0, 0.2, n), rng.normal(0, 1, n)])
    y[0, 5], flags = np.nan, rng.integers(0, 2, n) + 2
    rows = [(*map(int, x[:, i]), *map(float, y[:, i]), int(flags[i])) for i in range(n)]
    frame = spark.createDataFrame(rows, "x0 int, x1 int, x2 int, y0 double, y1 double, flags long").repartition(5)
    models = [Model("a", 0, 0, (0, 1, 2)), Model("b", 0, 1, (0, 1, 2)), Model("c", 1, 1, (1, 2)), Model("none", 1, 7, (0,))]
    fitted = boosting.fit(frame, models, 3, 2, trees=4, depth=3, least=15)
    for m in fitted[:3]:
        own = [i for i in range(n) if flags[i] >> m.flag & 1 and np.isfinite(y[m.outcome, i])]
        base, trees = brute_fit([[int(x[c, i]) for i in own] for c in range(3)], [float(y[m.outcome, i]) for i in own], m.columns, 4, 3, 0.3, 1.0, 15)
        assert math.isclose(m.base, base) and all(close(nested(t), want) for t, want in zip(m.trees, trees, strict=True)), m.name
        assert int(m.trees[0].rows[0]) == len(own)
    assert fitted[3].base == 0 and not fitted[3].predict(x).any()
    got = {(r["m"], r["held_out"]): r for r in boosting.scores(frame, fitted, [1, 0, 0, 0], 3, 2)}
    own = [i for i in range(n) if flags[i] & 1 and np.isfinite(y[0, i])]
    error = ((y[0, own] - fitted[0].predict(x[:, own])) ** 2).sum()
    assert got[0, 0]["n"] == len(own) and math.isclose(got[0, 0]["e"], error) and 1 - error / ((y[0, own] - y[0, own].mean()) ** 2).sum() > 0.7


def test_dependence_counts_other_branches_by_rows():
    t = Tree.empty(2)
    t.column[:3], t.cut[:3], t.rows[:7], t.value[3:7] = (0, 2, 1), (4, 9, 20), (100, 30, 70, 10, 20, 35, 35), (1.0, 4.0, -2.0, 6.0)
    s = boosting.dependence(Model("m", 0, 0, (0, 1, 2), 0.5, [t]), (0, 1))
    for i in range(BINS):
        for j in range(BINS):
            want = (10 * 1.0 + 20 * 4.0) / 30 if i <= 4 else (-2.0 if j <= 20 else 6.0)
            assert math.isclose(s[i, j], 0.5 + want)
    assert (boosting.dependence(Model("m", 0, 0, (0,), 0.5, [t]), (1, 0)) == s.T).all()


def test_surface_classes():
    a, b = np.linspace(1, 3, 9), np.linspace(1, 5, 9)
    kind = lambda f: boosting.surface_class(f(a[:, None], b[None, :]), a, b)[0]
    assert kind(lambda x, y: 0 * x * y + 2) == "FLAT" and kind(lambda x, y: x + y**2) == "ADDITIVE" and kind(lambda x, y: np.exp(x) * y**2) == "MULTIPLICATIVE"
    assert kind(lambda x, y: np.where(y > 3, x, 0.01 * x) - 1) == "GATED"
    assert kind(lambda x, y: (x - 2) * (y - 3)) == "SYNERGISTIC" and kind(lambda x, y: -(x - 2) * (y - 3)) == "SUPPRESSIVE"
    assert kind(lambda x, y: (x - 2) ** 3 * (y - 3) ** 3 * 0.01 + 0 * x) == "WEAKLY_COUPLED"


def test_type_two_equals_dense_solves(spark):
    rng = np.random.default_rng(9)
    n = 300
    a, b, c = rng.integers(0, 3, n), rng.normal(0, 1, n), rng.normal(0, 1, n)
    b += 0.5 * a  # unbalanced
    dummies = np.stack([a == 1, a == 2]).astype(float)
    terms = {(): [0], ("a",): [1, 2], ("b",): [3], ("c",): [4], ("b", "c"): [5], ("a", "b"): [6, 7], ("twin",): [8]}
    x = np.stack([np.ones(n), *dummies, b, c, b * c, *(b * d for d in dummies), 2 * c])
    y = 1 + a + 0.3 * b - c + 0.8 * b * c + rng.normal(0, 0.3, n)
    names = [f"x{k}" for k in range(9)] + ["y"]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in np.vstack([x, y]).T], ", ".join(f"{k} double" for k in names)).repartition(4)
    g = learned.gram(frame, names)
    assert np.allclose(g, np.vstack([x, y]) @ np.vstack([x, y]).T)
    rss = lambda use: float(((y - x[use].T @ np.linalg.lstsq(x[use].T, y, rcond=None)[0]) ** 2).sum())
    for term, got in learned.type_two(g, terms, 9).items():
        others = [k for t, own in terms.items() if not set(term) <= set(t) for k in own]
        assert math.isclose(got, rss(others) - rss(others + terms[term]), abs_tol=1e-6), term
    assert abs(learned.type_two(g, terms, 9)["twin",]) < 1e-6


def test_queries(spark):
    fits = registry.QUERIES["a07_boosted_fits"](spark, DIR).collect()
    r2 = {(r["inputs"], r["outcome"], r["fold"], r["held_out"]): r["r2"] for r in fits}
    n = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert len(fits) == 16 and min(r2["all", "log_charge", f, True] for f in range(3)) > 0.9 > 0.2 > r2["parameters", "log_charge", 0, True]
    assert sum(r["n"] for r in fits if r["held_out"] and r["inputs"] == "all" and r["outcome"] == "log_bytes") == n
    again = registry.QUERIES["a07_boosted_fits"](spark, DIR).collect()
    assert sorted(map(str, fits)) == sorted(map(str, again))
    surfaces = registry.QUERIES["a09_dependence"](spark, DIR).collect()
    assert len(surfaces) == 12 and all(r["low"] <= r["high"] for r in surfaces)
    assert {r["model"] for r in registry.QUERIES["a11_band_dependence"](spark, DIR).collect()} == set(learned.BANDS)
    basis = sorted(registry.QUERIES["a12_gradient_basis"](spark, DIR).collect())
    assert [r["component"] for r in basis] == [1, 2, 3, 4] and math.isclose(basis[-1]["cumulative"], 100, abs_tol=1e-4)
    shares = registry.QUERIES["t01_variance_by_terms"](spark, DIR).collect()
    for outcome in learned.OUTCOMES:
        own = {r["term"]: r for r in shares if r["outcome"] == outcome}
        assert math.isclose(sum(r["pct"] for r in own.values()), 100, abs_tol=0.01) and min(r["sum_sq"] for r in own.values()) > -1e-3
    assert max(shares, key=lambda r: r["pct"] if r["outcome"] == "log_charge" and r["term"] != "residual" else -1)["term"] == "distance"


def test_rows_meet_in_slabs(spark):
    """What a pass over the rows reads is bounded by the bins that occur, and holds all that the rows do."""
    rng = np.random.default_rng(4)
    n = 30_000
    x = np.stack([rng.integers(0, k, n) for k in (2, 3, 2)])
    y = rng.normal(size=n)
    y[:5] = (np.nan, np.inf, -np.inf, np.nan, np.nan)
    flags = rng.integers(0, 4, n)
    frame = spark.createDataFrame([(*x[:, i].tolist(), None if i == 0 else float(y[i]), int(flags[i])) for i in range(n)], "x0 int, x1 int, x2 int, y0 double, flags long").repartition(4)
    table, codes = boosting.slabs(frame, 1, 3, 1)
    rows = table.collect()
    assert len(rows) * codes.size <= 2 * 3 * 2
    own = (flags & 1 == 1) & np.isfinite(y)
    assert sum(int(np.frombuffer(r["n0"], "<u4").sum()) for r in rows) == own.sum()
    assert sum(int(np.frombuffer(r["s0"], "<f8").sum()) for r in rows) == boosting.whole(y[own]).sum()
    table.unpersist()
