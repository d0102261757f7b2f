"""Schedules, scan orders, coders and separated text against round trips and loops."""

import math

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quarry import registry
from quarry.functions import planes
from quarry.functions.rasters import Slice
from quarry.operators import regions
from quarry.sources import separated

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def test_schedules():
    assert regions.schedule(8, 8) == [] and regions.schedule(32, 1) == [True, True] and regions.schedule(5, 40) == [False] * 3
    assert regions.schedule(32, 32) == [False, True, False, True] and regions.schedule(33, 32) == [True, False, True, False, True]
    for w in range(1, 70, 7):
        for h in range(1, 70, 9):
            a, b = w, h
            for along in regions.schedule(w, h):
                a, b = ((a + 1) // 2, b) if along else (a, (b + 1) // 2)
            assert max(a, b) <= 8


def test_squeezes_come_back():
    rng = np.random.default_rng(1)
    for h, w in ((1, 32), (2, 32), (9, 32), (33, 32), (40, 17), (64, 32)):
        v = rng.integers(0, 256, (3, h, w))
        steps = regions.schedule(w, h)
        low, left = regions.squeezed(v, steps)
        assert max(low.shape[1:]) <= 8 and np.array_equal(regions.unsqueezed(low, left, steps), v)
        flat = np.full((1, h, w), 77)
        low, left = regions.squeezed(flat, steps)
        assert (low == 77).all() and not any(r.any() for r in left)


def test_natural_order():
    assert regions.natural_order(1, 1)[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and regions.natural_order(1, 1)[-3:] == [55, 62, 63]
    for wide, high in ((1, 1), (2, 1), (2, 2), (4, 1), (4, 2), (4, 4)):
        order, side, ratio = regions.natural_order(wide, high), 8 * wide, wide // high
        assert sorted(order) == list(range(wide * high * 64))
        assert order[: wide * high] == [y * side + x for y in range(high) for x in range(wide)]
        diagonals = [p % side + p // side * ratio for p in order[wide * high :]]
        assert diagonals == sorted(diagonals)
        for d in set(diagonals):  # a diagonal is walked without a turn
            xs = [p % side for p in order[wide * high :] if p % side + p // side * ratio == d]
            assert xs == sorted(xs) or xs == sorted(xs, reverse=True)


def test_coders_are_reversible():
    u = np.arange(0, 5000)
    for first, upper, lower in regions.CODERS:
        token, raw = regions.coded(u, first, upper, lower)
        value = {}
        for x, t, n in zip(u.tolist(), token.tolist(), raw.tolist(), strict=True):
            value.setdefault(t, []).append(x)
            assert n >= 0
        for t, own in value.items():
            n = int(raw[own[0]])
            assert len({int(raw[x]) for x in own}) == 1 and len(own) <= 1 << n or t == max(value)
        assert token[: 1 << first].tolist() == list(range(1 << first))


def test_moved_to_front():
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 9, 200)
    moved, front, back = regions.moved_to_front(labels), list(range(int(labels.max()) + 1)), []
    for k in moved.tolist():
        back.append(front[k])
        front.insert(0, front.pop(k))
    assert back == labels.tolist() and not len(regions.moved_to_front(labels[:0])) and regions.moved_to_front(np.array([2, 2, 0])).tolist() == [2, 0, 1]


def test_separated_text(spark, tmp_path):
    rows = [("a", 1, 2.5, "x y"), (None, None, None, None), ("c", 3, float("nan"), ""), ("d", -4, math.inf, "é")]
    t = spark.createDataFrame(rows, "k string, n long, v double, s string").repartition(3)
    path = separated.write(t, f"file://{tmp_path}/t", ",", "first\nsecond")
    got = separated.read(spark, path, "s string, n bigint, v double, more double", ",").collect()
    assert len(got) == 4 and {r["n"] for r in got} == {1, 3, -4, None} and {r["v"] for r in got} == {2.5, math.inf, None} and {r["more"] for r in got} == {None}
    (tmp_path / "odd.tsv").write_text("# note\nn\tv\n1\tNA\nx\t2.5\n\t\nn\tv\n7\tnan\n# end\n")
    got = sorted(((r["n"], r["v"]) for r in separated.read(spark, f"file://{tmp_path}/odd.tsv", "n int, v double").collect()), key=str)
    assert got == sorted([(1, None), (None, 2.5), (7, None)] + [(None, None)] * (len(got) - 3), key=str) and len(got) in (3, 4)
    (tmp_path / "none.tsv").write_text("# only a note\n")
    assert separated.read(spark, f"file://{tmp_path}/none.tsv", "n int").count() == 0


def test_queries(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect() if r[1]]
    got = {r["doc_id"]: r for r in registry.QUERIES["d12_squeeze_levels"](spark, DIR).collect()}
    assert len(got) == len(docs)
    for i, text in docs[::17]:
        v = np.array([ord(c) & 255 for c in text])
        (_, p), *_ = planes.planes(Slice(v, np.array([len(v)])))
        whole = np.rint(p * 255).astype(int)
        steps = regions.schedule(32, whole.shape[1])
        low, left = regions.squeezed(whole, steps)
        flat = low.ravel()
        assert (got[i]["steps"], got[i]["low"]) == (len(steps), int((flat * (np.arange(len(flat)) % 97 + 1)).sum()))
        assert got[i]["magnitude"] == sum(int(np.abs(r).sum()) for r in left) and (got[i]["loss"] > 0) == bool(left[0].any())
    moved = {}
    for r in registry.QUERIES["w12_moved_labels"](spark, DIR).collect():
        moved.setdefault(r["lang"], []).append((r["context"], r["cluster"], r["moved"]))
    for own in moved.values():
        _, labels, places = zip(*sorted(own), strict=True)
        assert list(places) == regions.moved_to_front(np.array(labels)).tolist()
