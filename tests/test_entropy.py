"""Code building, clustering of histograms and the weighted predictor against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quarry import registry
from quarry.functions import coding, weighted
from quarry.functions.rasters import Slice

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def texts(spark):
    return [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang", "text").collect() if r[2]]


def brute_bits(counts):
    """Least total bits of a prefix code without a limit: join the two smallest, again and again."""
    left, bits = sorted(c for c in counts if c), 0
    if len(left) == 1:
        return left[0]
    while len(left) > 1:
        both = left[0] + left[1]
        bits += both
        left = sorted([*left[2:], both])
    return bits


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = rng.integers(0, 40, rng.integers(1, 60)) ** rng.integers(1, 3)
        lengths = coding.code_lengths(counts)
        assert ((lengths > 0) == (counts > 0)).all()
        assert (counts * lengths).sum() == brute_bits(counts.tolist())
        if np.count_nonzero(counts) > 1:
            assert sum(2.0**-x for x in lengths if x) == 1
    steep = np.array([2**k for k in range(30)])
    lengths = coding.code_lengths(steep)
    assert lengths.max() <= 15 and sum(2.0**-x for x in lengths) <= 1
    assert coding.code_lengths(np.array([3, 3])).tolist() == [1, 1] and coding.code_lengths(np.zeros(4, int)).tolist() == [0] * 4
    assert coding.code_lengths(np.array([1, 1, 1])).tolist() == [1, 2, 2]  # of equal counts the larger symbols are joined first
    assert coding.code_lengths(np.array([1, 1, 2])).tolist() == [2, 2, 1]  # a symbol before a node of its weight


def test_canonical_codes():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = coding.code_lengths(rng.integers(0, 50, 40))
        code, last = 0, 0
        want = np.zeros(40, int)
        for size, k in sorted((int(x), k) for k, x in enumerate(lengths) if x):
            code <<= size - last
            want[k] = int(format(code, f"0{size}b")[::-1], 2)
            code, last = code + 1, size
        assert coding.canonical_codes(lengths).tolist() == want.tolist()


def test_normalised():
    assert coding.normalised(np.array([0, 5, 5])).tolist() == [0, 2048, 2048]
    assert coding.normalised(np.array([1, 1, 1])).tolist() == [1365, 1365, 1366]
    assert coding.normalised(np.array([10**9, 1, 0])).tolist() == [4095, 1, 0]
    assert coding.normalised(np.zeros(3, int)).tolist() == [0, 0, 0]


def brute_merge(label, clusters, cost):
    """All pairs looked at again in every round."""
    h = {k: c.copy() for k, c in enumerate(clusters)}
    into = {k: k for k in h}
    while True:
        gains = sorted((cost(h[a] + h[b]) - cost(h[a]) - cost(h[b]), a, b) for a in h for b in h if a < b)
        if not gains or gains[0][0] >= 0:
            return [into[x] for x in label], h
        _, a, b = gains[0]
        h[a] += h.pop(b)
        into = {k: a if v == b else v for k, v in into.items()}


def entropy(h):
    n = sum(h)
    return -sum(c * math.log2(c / n) for c in h if c)


def brute_spread(h, most, near):
    label = [0 if not sum(r) else None for r in h]
    away = [0.0 if not sum(r) else math.inf for r in h]
    distance = lambda a, b: entropy([x + y for x, y in zip(a, b, strict=True)]) - entropy(a) - entropy(b)
    seeds, at = [], max(range(len(h)), key=lambda i: (sum(h[i]), -i))
    while len(seeds) < most:
        label[at], away[at] = len(seeds), 0.0
        seeds.append(list(h[at]))
        away = [min(d, distance(r, h[at])) if d else 0.0 for d, r in zip(away, h, strict=True)]
        at = max(range(len(h)), key=lambda i: (away[i], -i))
        if away[at] < near:
            break
    for i, r in enumerate(h):
        if label[i] is None:
            best = min(range(len(seeds)), key=lambda k: (distance(r, seeds[k]), k))
            seeds[best] = [x + y for x, y in zip(seeds[best], r, strict=True)]
            label[i] = best
    return label, seeds


@pytest.mark.parametrize("cost", [coding.prefix_population, coding.table_population])
def test_clusters_equal_a_greedy_merge(cost):
    rng = np.random.default_rng(3)
    for _ in range(12):
        kinds = rng.integers(1, 60, (3, 12)) * (rng.random((3, 12)) < 0.6)
        h = np.stack([rng.poisson(kinds[rng.integers(3)] * rng.random() * 3) for _ in range(14)] + [np.zeros(12, int)])
        seeded, clusters = coding.spread(h, 9, 20.0)
        want, seeds = brute_spread(h.tolist(), 9, 20.0)
        assert seeded.tolist() == want and clusters.tolist() == seeds
        label, left = coding.merged(seeded, clusters, cost)
        want, h_left = brute_merge(seeded.tolist(), clusters, cost)
        assert label.tolist() == want and [x.tolist() for x in left] == [h_left[k].tolist() for k in sorted(h_left)]
        assert sum(map(cost, left)) <= sum(map(cost, clusters)) + 1e-9
    assert coding.renumbered(np.array([4, 2, 4, 0])).tolist() == [0, 1, 0, 2]


def test_fixed_clusters():
    fixed = np.array([[10, 10, 0], [0, 0, 9]])
    h = np.array([[5, 5, 0], [0, 0, 3], [400, 0, 400], [0, 0, 0], [401, 0, 400]])
    label, clusters = coding.spread(h, 2, 48.0, fixed=fixed)
    assert label.tolist() == [0, 1, 2, 0, 2] and clusters[:2].tolist() == fixed.tolist() and clusters[2].tolist() == [801, 0, 800]


def scalar_weighted(v, parameters):
    """Sample by sample, over one raster of width 32."""
    width, p = 32, parameters
    rows = -(-len(v) // width)
    missed = [[[0] * 4 for _ in range(width + 2)] for _ in range(rows + 1)]  # row 0 stands above the raster
    error = [[0] * (width + 2) for _ in range(rows + 1)]
    out = []
    for i, actual in enumerate(v):
        x, y = i % width, i // width
        get = lambda a, b: v[b * width + a]
        w = get(x - 1, y) if x else (get(x, y - 1) if y else 0)
        n = get(x, y - 1) if y else w
        nw = get(x - 1, y - 1) if x and y else w
        ne = get(x + 1, y - 1) if x + 1 < width and y else n
        nn = get(x, y - 2) if y > 1 else n
        right, left = (x + 1 if x < width - 1 else x), (x - 1 if x else x)
        up, weight = missed[y], []
        for k in range(4):
            seen = up[x][k] + up[right][k] + up[left][k]
            shift = max(0, (seen + 1).bit_length() - 1 - 5)
            weight.append(4 + ((p[7 + k] * ((1 << 24) // (((seen >> shift) & 63) + 1))) >> shift))
        down = sum(weight).bit_length() - 1 - 4
        weight = [x >> down for x in weight]
        e_w, e_n, e_nw, e_ne = (error[y + 1][x - 1] if x else 0), error[y][x], error[y][left], error[y][right]
        big = e_w
        for e in (e_n, e_nw, e_ne):
            if abs(e) > abs(big):
                big = e
        N, W, NW, NE, NN = n * 8, w * 8, nw * 8, ne * 8, nn * 8
        guess = [W + NE - N, N - ((e_n + e_w + e_ne) * p[0] >> 5), W - ((e_n + e_w + e_nw) * p[1] >> 5), N - ((e_nw * p[2] + e_n * p[3] + e_ne * p[4] + (NN - N) * p[5] + (NW - W) * p[6]) >> 5)]
        mean = (sum(g * k for g, k in zip(guess, weight, strict=True)) + (sum(weight) >> 1) - 1) * ((1 << 24) // sum(weight)) >> 24
        if ((e_n ^ e_w) | (e_n ^ e_nw)) <= 0:
            mean = min(max(mean, min(W, NE, N)), max(W, NE, N))
        out.append(((mean + 3) >> 3, mean - actual * 8, big))
        error[y + 1][x] = mean - actual * 8
        wrong = [(abs(g - actual * 8) + 3) >> 3 for g in guess]
        missed[y + 1][x] = wrong
        up[x + 1] = [a + b for a, b in zip(up[x + 1], wrong, strict=True)]
    return out


def test_weighted_predictor_equals_a_scalar_loop():
    rng = np.random.default_rng(4)
    rasters = [rng.integers(0, 256, n) for n in (1, 5, 31, 32, 33, 64, 95, 500, 1203)] + [np.full(200, 7), np.arange(300) % 256]
    s = Slice(np.concatenate(rasters), np.array([len(r) for r in rasters]))
    for p in weighted.PARAMETERS:
        want = [x for r in rasters for x in scalar_weighted(r.tolist(), p)]
        assert list(zip(*(x.tolist() for x in weighted.weighted(s, p)), strict=True)) == want
    seen = np.concatenate([s.start[o] + y * 32 + x for o, x, y in weighted.waves(s)])
    assert sorted(seen.tolist()) == list(range(len(s.v)))


def test_weighted_query(spark):
    got = {r["doc_id"]: r for r in registry.QUERIES["w04_weighted_prediction"](spark, DIR).collect()}
    best = {r["doc_id"]: r for r in registry.QUERIES["w03_with_weighted"](spark, DIR).collect()}
    assert len(got) == len(best) == len(texts(spark))
    for doc_id, _, text in texts(spark)[::9]:
        v = [ord(c) & 255 for c in text]
        out = scalar_weighted(v, weighted.PARAMETERS[0])
        digest = lambda k: sum(x[k] * (i % 97 + 1) for i, x in enumerate(out))
        cost = sum(abs(a - x[0]) for a, x in zip(v, out, strict=True))
        assert tuple(got[doc_id])[1:] == (len(v), cost, digest(0), digest(1), digest(2))
        assert best[doc_id]["weighted"] == cost


def test_code_query(spark):
    rows = registry.QUERIES["n07_code_lengths"](spark, DIR).collect()
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    assert len(of) == len(texts(spark))
    for own in of.values():
        counts = np.zeros(64, int)
        for r in own:
            counts[r["token"]] = r["n"]
        assert sum(r["n"] * r["length"] for r in own) == brute_bits(counts.tolist())  # the limit is not reached
        spelt = sorted(format(r["code"], f"0{r['length']}b")[::-1] for r in own)
        assert all(not b.startswith(a) for a, b in zip(spelt, spelt[1:], strict=False))


def test_cluster_queries(spark):
    counts = registry.QUERIES["g07_context_counts"](spark, DIR).collect()
    whole = {}
    for r in counts:
        whole.setdefault(r["lang"], {}).setdefault(r["context"], Counter())[r["token"]] += r["n"]
    got = {}
    for r in registry.QUERIES["n06_context_clusters"](spark, DIR).collect():
        got.setdefault(r["lang"], []).append(r)
    assert set(got) == set(whole)
    for lang, own in got.items():
        names = sorted(whole[lang])
        h = np.array([[whole[lang][c][t] for t in range(64)] for c in names])
        label, seeds = brute_spread(h.tolist(), 16, 48.0)
        want, left = brute_merge(label, np.array(seeds), coding.prefix_population)
        rows = sorted(own, key=lambda r: r["context"])
        assert [r["context"] for r in rows] == names and [r["n"] for r in rows] == h.sum(1).tolist()
        assert [r["cluster"] for r in rows] == coding.renumbered(np.array(want)).tolist()
        assert math.isclose(rows[0]["total_bits"], sum(coding.prefix_population(x) for x in left.values()), abs_tol=1e-3)
    for name in ("n18_small_clusters", "j08_clusters_with_fixed"):
        rows = registry.QUERIES[name](spark, DIR).collect()
        assert len(rows) == sum(map(len, whole.values()))
        assert {(r["lang"], r["context"], r["n"]) for r in rows} == {(k, c, sum(x.values())) for k, v in whole.items() for c, x in v.items()}
        assert max(r["cluster"] for r in rows) < 12
