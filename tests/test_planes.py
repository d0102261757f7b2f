"""Plane filters, ridges and blobs against loops over samples."""

import math

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quarry import registry
from quarry.functions import planes
from quarry.functions.rasters import Slice
from quarry.operators import planes as operators

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def test_planes_fill_their_last_row():
    sizes = [1, 32, 33, 70, 64, 31]
    v = np.arange(sum(sizes)) % 251
    s = Slice(v, np.array(sizes))
    seen = {}
    for own, p in planes.planes(s):
        for k, plane in zip(own.tolist(), p, strict=True):
            seen[k] = plane
    for k, n in enumerate(sizes):
        own = v[s.start[k] : s.start[k] + n] / 255
        assert seen[k].shape == (-(-n // 32), 32) and np.array_equal(seen[k].ravel()[:n], own) and (seen[k].ravel()[n:] == own[-1]).all()


def test_mirrored_borders():
    p = np.arange(6.0).reshape(1, 2, 3)
    wide = planes.padded(p, 2, "symmetric")
    assert wide[0].tolist() == np.pad(p[0], 2, mode="symmetric").tolist()
    one = planes.padded(np.full((1, 1, 4), 7.0) + np.arange(4), 3, "symmetric")
    assert one.shape == (1, 7, 10) and (one[0] == one[0, 0]).all() and one[0, 0].tolist() == [9, 8, 7, 7, 8, 9, 10, 10, 9, 8]


def scalar_ridges(p, least, ratio):
    h, w = p.shape
    gx, gy = np.zeros((h, w)), np.zeros((h, w))
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            a = p[y - 1 : y + 2, x - 1 : x + 2]
            gx[y, x] = (a[0, 2] + 2 * a[1, 2] + a[2, 2]) - (a[0, 0] + 2 * a[1, 0] + a[2, 0])
            gy[y, x] = (a[2, 0] + 2 * a[2, 1] + a[2, 2]) - (a[0, 0] + 2 * a[0, 1] + a[0, 2])
    m = np.sqrt(gx * gx + gy * gy)
    top, ridge = set(), set()
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            g = m[y, x]
            if g < least:
                continue
            if abs(gx[y, x]) > 2 * abs(gy[y, x]):
                a, b = m[y, x - 1], m[y, x + 1]
            elif abs(gy[y, x]) > 2 * abs(gx[y, x]):
                a, b = m[y - 1, x], m[y + 1, x]
            elif math.copysign(1, gx[y, x]) == math.copysign(1, gy[y, x]):
                a, b = m[y - 1, x - 1], m[y + 1, x + 1]
            else:
                a, b = m[y - 1, x + 1], m[y + 1, x - 1]
            if g < a or g < b:
                continue
            top.add((y, x))
            xx, yy = p[y, x + 1] - 2 * p[y, x] + p[y, x - 1], p[y + 1, x] - 2 * p[y, x] + p[y - 1, x]
            xy = 0.25 * (p[y + 1, x + 1] - p[y + 1, x - 1] - p[y - 1, x + 1] + p[y - 1, x - 1])
            disc = ((xx + yy) / 2) ** 2 - (xx * yy - xy * xy)
            if disc < 0:
                continue
            small, big = sorted(abs((xx + yy) / 2 + s * math.sqrt(disc)) for s in (1, -1))
            if big >= least and small * ratio <= big:
                ridge.add((y, x))
    return top, ridge


def test_ridges_equal_a_loop():
    rng = np.random.default_rng(6)
    p = rng.random((3, 12, 32)) * 0.1
    p[0, 3:9, 10] += 0.6
    p[1, np.arange(11), np.arange(11) + 5] += 0.5
    p[2] = 0.3
    across, down, length = planes.gradients(p)
    top = planes.maxima(across, down, length, 0.15)
    ridge = planes.ridges(p, top, 0.15, 2.0)
    found = 0
    for k in range(3):
        want = scalar_ridges(p[k], 0.15, 2.0)
        assert set(map(tuple, np.argwhere(top[k]).tolist())) == want[0] and set(map(tuple, np.argwhere(ridge[k]).tolist())) == want[1]
        found += len(want[1])
    assert found and not top[2].any()


def flood(e, low, high):
    """Components by merging labels until nothing changes; of those above low the ones with a sample above high."""
    label = {(y, x): (y, x) for y, x in np.argwhere((e > low)).tolist()}
    changed = True
    while changed:
        changed = False
        for y, x in label:
            least = min(label.get((y + a, x + b), label[y, x]) for a in (-1, 0, 1) for b in (-1, 0, 1))
            if least < label[y, x]:
                label[y, x], changed = least, True
    groups = {}
    for at, k in label.items():
        groups.setdefault(k, set()).add(at)
    return [g for g in groups.values() if any(e[at] > high for at in g)]


def test_components_equal_a_flood_fill():
    rng = np.random.default_rng(7)
    for _ in range(6):
        e = rng.random((14, 32)) ** 4
        got = [set(map(tuple, c.tolist())) for c in planes.components(e, 0.2, 0.6)]
        want = flood(e, 0.2, 0.6)
        assert sorted(map(sorted, got)) == sorted(map(sorted, want))
    assert planes.components(np.ones((40, 32)), 0.5, 0.9) == []  # too large


def test_a_planted_blob_is_found():
    y, x = np.mgrid[0:24, 0:32]
    spot = 0.9 * np.exp(-0.5 * ((x - 15.0) ** 2 / 1.4 + (y - 11.0) ** 2 / 0.5))
    p = np.array([0.05 + spot, np.full((24, 32), 0.4)])
    e, smooth = planes.energy(p)
    found = planes.components(e[0], operators.LOW, operators.HIGH)
    assert len(found) == 1 and not planes.components(e[1], operators.LOW, operators.HIGH)
    stats = planes.component_stats(e[0], found[0])
    assert (stats["mode_y"], stats["mode_x"]) == (11, 15) and stats["score"] > 1
    near = e[0][max(stats["top"] - 4, 0) : stats["top"] + stats["height"] + 4, max(stats["left"] - 4, 0) : stats["left"] + stats["width"] + 4]
    inside = e[0][stats["top"] : stats["top"] + stats["height"], stats["left"] : stats["left"] + stats["width"]]
    assert math.isclose(stats["mean"], inside.mean()) and math.isclose(stats["ground"], (near.sum() - inside.sum()) / (near.size - inside.size))
    cx, cy, large, small, angle, intensity, loss = planes.ellipse(p[0], smooth[0], (11, 15))
    assert abs(cx - 15) < 0.05 and abs(cy - 11) < 0.05 and large > small and intensity > 0 and loss < 0.05 and min(abs(angle), abs(abs(angle) - math.pi)) < 0.1


def test_ridge_and_blob_queries(spark):
    got = {r["doc_id"]: r for r in registry.QUERIES["v59_ridges"](spark, DIR).collect()}
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect() if r[1]]
    assert len(got) == len(docs) and sum(r["maxima"] for r in got.values()) > 1000
    boxes = {}
    for r in registry.QUERIES["v52_blobs"](spark, DIR).collect():
        boxes.setdefault(r["doc_id"], set()).add((r["top"], r["left"], r["height"], r["width"], r["pixels"]))
    for i, text in sorted(docs, key=lambda d: len(d[1]))[5:60:6]:
        v = np.array([ord(c) & 255 for c in text])
        (_, p), *_ = planes.planes(Slice(v, np.array([len(v)])))
        top, ridge = scalar_ridges(p[0], operators.LEAST, operators.RATIO)
        assert (got[i]["maxima"], got[i]["ridges"]) == (len(top), len(ridge))
        e = planes.energy(p)[0][0]
        want = set()
        for g in flood(e, operators.LOW, operators.HIGH):
            own = np.array(sorted(g))
            stats = planes.component_stats(e, own)
            size = own.max(0) - own.min(0) + 1
            if len(g) <= 1000 and size.max() < 5 and stats["score"] >= operators.SCORE:
                want.add((*own.min(0).tolist(), *size.tolist(), len(g)))
        assert boxes.get(i, set()) == want
