"""Curves, ranks, fronts, medoids and the absolute-error fit against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quarry import registry
from quarry.functions import curves
from quarry.operators import curves as operators

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def test_risen_curves():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 30):
        s, w = rng.normal(0, 1, n) + np.arange(n) * 0.1, rng.integers(1, 5, n).astype(float)
        mean = lambda i, j: (s[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()  # noqa: B023, E731
        want = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.allclose(curves.risen(s, w), want)


def test_settings_and_searches():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(4, 30))
        q = np.sort(rng.choice(np.arange(1, 101), n, replace=False)).astype(float)
        s = np.sort(rng.random(n) * 100)
        if rng.random() < 0.3:
            s[1:] = np.where(rng.random(n - 1) < 0.4, s[:-1], s[1:])
            s = np.maximum.accumulate(s)
        t = float(rng.integers(5, 100))
        exact = curves.setting_for(q, s, t)
        if exact is None:
            assert s[-1] < t
        else:
            assert np.interp(exact, q, s) >= t - 1e-9
            grid = np.linspace(q[0], q[-1], 4001)
            lower = grid[grid < exact - 1e-9]
            assert (np.interp(lower, q, s) < t).all()
        asked = []
        at, score, reached, steps = curves.search(q, s, t, float(rng.random() * 120 - 10))
        assert 1 <= steps <= 8 and 1 <= at <= 100 and math.isclose(score, np.interp(at, q, s))
        assert reached == (score >= t - 0.5) or not reached
        if reached and exact is not None:
            assert at >= exact - 1 - (0.5 / max(np.diff(s).max(), 1e-9)) * 100 or score >= t - 0.5
        del asked
    assert curves.search(np.array([1.0, 100]), np.array([1.0, 100]), 50, 50) == (50, 50, True, 1)
    assert curves.search(np.array([1.0, 100]), np.array([1.0, 100]), 50, 20)[:3] == (50, 50, True)
    assert not curves.search(np.array([1.0, 100]), np.array([1.0, 30]), 90, 50)[2]
    assert curves.first_guess(0) == 40 and curves.first_guess(200) == 100


def test_panel():
    rng = np.random.default_rng(3)
    for n in (2, 3, 17, 64, 101):
        x, y = rng.integers(0, 9, n).astype(float), rng.integers(0, 5, n).astype(float)
        pairs = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(n) for j in range(i)]
        s, a, b = sum(p * q for p, q in pairs), sum(p != 0 for p, _ in pairs), sum(q != 0 for _, q in pairs)
        got = curves.panel(x, y)
        if not a or not b:
            assert got == (None, None, None)
            continue
        rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
        assert np.allclose(got, (np.corrcoef(x, y)[0, 1], np.corrcoef(rank(x), rank(y))[0, 1], s / math.sqrt(a * b)))
        assert curves.inversions(y) == sum(y[j] > y[i] for i in range(n) for j in range(i))


def test_fronts():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a = rng.integers(0, 12, (int(rng.integers(1, 30)), 2)).astype(float)
        b = rng.integers(0, 12, (int(rng.integers(1, 30)), 2)).astype(float)
        own = [tuple(r) for r in a[curves.front(a[:, 0], a[:, 1])]]
        want = {tuple(p) for p in a if not any(o[0] <= p[0] and o[1] >= p[1] and tuple(o) != tuple(p) for o in a)}
        assert len(own) == len(set(own)) and set(own) == want
        a, b = a[np.argsort(a[:, 0])], b[np.argsort(b[:, 0])]
        assert math.isclose(curves.farthest_nearest(a, b), max(min(math.dist(p, o) for o in b) for p in a))


def plain_kmeans(x, ids, k, rounds):
    order = np.argsort(ids)
    centres = x[order[:1]]
    for _ in range(k - 1):
        d = ((x[:, None] - centres) ** 2).sum(2).min(1)
        i = min(range(len(x)), key=lambda i: (-d[i], ids[i]))
        if d[i] <= 0:
            break
        centres = np.vstack([centres, x[i]])
    for _ in range(rounds):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        moved = np.array([x[own == c].mean(0) for c in range(len(centres)) if (own == c).any()])
        if moved.shape == centres.shape and np.allclose(moved, centres, atol=1e-7):
            break
        centres = moved
    d = ((x[:, None] - centres) ** 2).sum(2)
    own = d.argmin(1)
    out = set()
    for c in range(len(centres)):
        mine = np.flatnonzero(own == c)
        best = min(mine, key=lambda i: (round(float(d[i, c]), 9), ids[i]))
        out.add((len(mine), int(ids[best]), round(float(d[best, c]) ** 0.5, 5)))
    return out


def test_medoids(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.3, (40, 3)) for m in ((0, 0, 0), (4, 0, 0), (0, 5, 1))])
    x[7] = x[8]
    ids = rng.permutation(1000)[: len(x)]
    frame = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids, x, strict=True)], "vec_id long, x array<double>").repartition(5)
    for k in (1, 3, 5):
        got = {(r["size"], r["medoid"], round(r["distance"], 5)) for r in operators.medoids(frame, k).collect()}
        assert got == plain_kmeans(x, ids, k, 20)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in (5, 3, 9)], "vec_id long, x array<double>")
    assert [tuple(r) for r in operators.medoids(same, 4).collect()] == [(0, 3, 3, 0.0)]
    assert operators.medoids(same.limit(0)).count() == 0
    t = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    got = {(r["size"], r["medoid"], round(r["distance"], 5)) for r in registry.QUERIES["j17_medoids"](spark, DIR).collect()}
    assert got == plain_kmeans(np.array([r["embedding"] for r in t], float), np.array([r["vec_id"] for r in t]), 8, 20)


def test_l1_fit(spark):
    rng = np.random.default_rng(6)
    n = 400
    a, w = rng.normal(0, 1, n), rng.random(n) + 0.5
    y = 2 - 3 * a + rng.laplace(0, 0.1, n)
    y[:60] += 25  # a mean would follow these
    frame = spark.createDataFrame([(1.0, float(p), float(q), float(r)) for p, q, r in zip(a, y, w, strict=True)], "one double, a double, y double, w double").repartition(4)
    beta = operators.l1_fit(frame, ["one", "a"])
    assert abs(beta[0] - 2) < 0.1 and abs(beta[1] + 3) < 0.1
    x, ww, b = np.stack([np.ones(n), a]), w.copy(), None
    for _ in range(30):
        b = np.linalg.solve((x * ww) @ x.T + 1e-3 * np.eye(2), (x * ww) @ y)
        ww = w / np.maximum(np.abs(y - b @ x), 1e-2)
    assert np.allclose(beta, b)
    loss = lambda c: (w * np.abs(y - c @ x)).sum()
    assert all(loss(beta) <= loss(beta + d) + 0.05 for d in ([0.05, 0], [-0.05, 0], [0, 0.05], [0, -0.05]))


def test_search_query(spark):
    got = registry.QUERIES["l12_searches"](spark, DIR).collect()
    rows = {}
    for r in operators.quality_curves(spark, DIR).collect():
        rows.setdefault(r["image"], []).append((r["q"], r["s"], r["n"]))
    rows = {k: sorted(v) for k, v in rows.items() if len(v) >= 4}
    assert {r["image"] for r in got} == set(rows) and len(got) == 11 * len(rows)
    for r in got[::37]:
        q, s, n = (np.array(c, float) for c in zip(*rows[r["image"]], strict=True))
        s = curves.risen(s, n)
        assert math.isclose(r["score"], np.interp(r["setting"], q, s), abs_tol=1e-5)
        assert (r["exact"] is None) == (s[-1] < r["target"]) and r["reached"] == (r["score"] >= r["target"] - 0.5 - 1e-6)
    fit = registry.QUERIES["l14_l1_fit"](spark, DIR).collect()
    assert {r["n"] for r in fit} == {sum(r["exact"] is not None for r in got)} and all(math.isfinite(r["coefficient"]) for r in fit)
