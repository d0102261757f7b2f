"""Residual trees against a learner that goes sample by sample."""

import math

import numpy as np
import pytest
from pyspark.sql import SparkSession

from quarry.functions import trees
from quarry.functions.rasters import Slice
from quarry.operators import trees as operators
from quarry.functions.trees import CHOICES, PROPERTIES, Node

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def samples(text):
    """Properties, and token with raw bits for each choice, of every sample of a text."""
    v, out, width = [ord(c) & 255 for c in text], [], 32
    before = 0
    for i, actual in enumerate(v):
        x, y = i % width, i // width
        at = lambda a, b: v[b * width + a]
        w = at(x - 1, y) if x else (at(x, y - 1) if y else 0)
        n = at(x, y - 1) if y else w
        nw = at(x - 1, y - 1) if x and y else w
        ne = at(x + 1, y - 1) if x + 1 < width and y else n
        ww = at(x - 2, y) if x > 1 else w
        nn = at(x, y - 2) if y > 1 else n
        if not x:
            before = 0
        gradient = w + n - nw
        p = [min(y, 512), x, abs(n), abs(w), n, w, w - before, gradient, w - nw, nw - n, n - ne, n - nn, w - ww]
        before = gradient
        guess = {"gradient": min(max(gradient, min(n, w)), max(n, w)), "west": w, "north": n, "average0": (w + n) // 2}
        tokens = []
        for name in CHOICES:
            r = actual - guess[name]
            u = 2 * r if r >= 0 else -2 * r - 1
            if u < 16:
                tokens.append((u, 0))
            else:
                e = u.bit_length() - 1
                tokens.append((16 + (e - 4) * 8 + ((u >> (e - 1)) & 1) * 4 + (u & 3), e - 3))
        out.append((p, tokens))
    return out


def bits(tokens):
    counts = {}
    for t, _ in tokens:
        counts[t] = counts.get(t, 0) + 1
    n = len(tokens)
    return sum(b for _, b in tokens) + (0 if len(counts) < 2 else sum(-c * math.log2(max(c / n, 1 / 4096)) for c in counts.values()))


def brute_tree(own, ends, predictor, path, depth, saves, out):
    base = bits([t[predictor] for _, t in own])
    best = None
    if base > saves and len(path) < depth:
        for q in range(len(PROPERTIES)):
            place = [int(np.searchsorted(ends[q], p[q], "left")) for p, _ in own]
            for b in sorted(set(place))[:-1]:
                sides = []
                for side in ([t for (_, t), k in zip(own, place, strict=True) if k <= b], [t for (_, t), k in zip(own, place, strict=True) if k > b]):
                    costs = [bits([t[c] for t in side]) for c in range(len(CHOICES))]
                    sides.append(min((x + (c != predictor) * 800 / (100 + saves), c, x) for c, x in enumerate(costs)))
                cost = sides[0][2] + sides[1][2]
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, q, b, sides[0][1], sides[1][1])
    if best is None or best[0] + saves >= base:
        out[path] = (None, None, predictor, len(own), round(base, 3))
        return
    _, q, b, low, high = best
    out[path] = (q, int(ends[q][b]), predictor, len(own), round(base, 3))
    inside = lambda p: int(np.searchsorted(ends[q], p[q], "left")) <= b
    brute_tree([s for s in own if inside(s[0])], ends, low, path + "0", depth, saves, out)
    brute_tree([s for s in own if not inside(s[0])], ends, high, path + "1", depth, saves, out)


def test_trees_equal_brute_force(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("lang", "text").collect() if r["text"]]
    rows = [(k, t[:300]) for k, t in rows[:24]] + [(None, "a row without a language, " * 9), ("en", ""), ("en", None), ("xx", "z")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    ends = operators.bin_ends(docs)
    forest = operators.grow(docs, 3, 60.0)
    assert set(forest) == {k for k, t in rows if t}
    deep = 0
    for lang, tree in forest.items():
        own = [s for k, t in rows if k == lang and t for s in samples(t)]
        want = {}
        brute_tree(own, ends, 0, "", 3, 60.0, want)
        got = {p: (x.prop, x.threshold if x.prop is not None else None, x.predictor, x.n, round(x.bits, 3)) for p, x in tree.items()}
        assert got == want, lang
        deep = max(deep, *map(len, tree))
    assert deep == 3
    assert operators.grow(docs.limit(0)) == {}


def test_properties_and_tokens():
    rng = np.random.default_rng(7)
    text = "".join(chr(int(c)) for c in rng.integers(32, 250, 400))
    s = Slice(np.array([ord(c) & 255 for c in text]), np.array([400]))
    a = s.neighbours()
    want = samples(text)
    assert trees.properties(s, a).T.tolist() == [p for p, _ in want]
    assert trees.residual_tokens(s, a).T.tolist() == [[t for t, _ in x] for _, x in want]
    assert trees.token_bits(trees.residual_tokens(s, a)).T.tolist() == [[b for _, b in x] for _, x in want]


def test_thresholds_are_equal_shares():
    counts = np.zeros(1025, int)
    assert trees.thresholds(counts).tolist() == []
    counts[512 + np.arange(10)] = 4
    assert trees.thresholds(counts, 5).tolist() == [1, 3, 5, 7]
    counts[512] = 1000  # one value fills several shares
    assert trees.thresholds(counts, 5).tolist() == [0]


def test_limits_and_numbers():
    leaf = lambda p: Node(p, 1, 0.0)
    split = lambda q: Node(0, 1, 0.0, q, 0, 0)
    tree = {"": split(3), "0": split(4), "1": leaf(1), "00": split(5), "01": leaf(2), "000": leaf(3), "001": leaf(0)}
    assert [(p, c) for p, _, c in trees.numbered(tree)] == [("", None), ("0", None), ("1", 0), ("00", None), ("01", 1), ("000", 2), ("001", 3)]
    cut = trees.capped(tree, 1)
    assert set(cut) == {"", "0", "1"} and cut["0"].prop is None and cut["0"].predictor == 3
    assert trees.capped(tree, 9) == tree and set(trees.capped(tree, 0)) == {""}
    both = trees.joined([tree, {"": leaf(1)}, {"": leaf(2)}], 13)
    assert both[""].prop == 13 and both[""].threshold == 0 and both["1"].threshold == 1
    assert both["0"] == tree[""] and both["000"] == tree["00"] and both["10"].predictor == 1 and both["11"].predictor == 2
    assert trees.joined([tree], 13) == tree


def test_joined_query(spark):
    one = operators.residual_trees(spark, DIR).collect()
    got = operators.joined_tree(spark, DIR).collect()
    langs = sorted({r["lang"] for r in one})
    assert max(len(r["path"]) for r in got) <= 4
    leaves = [r for r in got if r["property"] is None]
    assert [r["context"] for r in sorted(leaves, key=lambda r: r["node"])] == list(range(len(leaves)))
    assert sum(r["n"] for r in leaves) == sum(r["n"] for r in one if r["path"] == "")
    assert {r["threshold"] for r in got if r["property"] == "lang"} == set(range(len(langs) - 1))
    for r in one:  # a split saves what it says: its children's bits and the saving make up its own
        if r["property"] is not None:
            kids = [k for k in one if k["lang"] == r["lang"] and k["path"] in (r["path"] + "0", r["path"] + "1")]
            assert math.isclose(r["bits"] - r["saved"], sum(k["bits"] for k in kids), abs_tol=0.01) and r["saved"] > operators.SAVES


def test_counting_a_level_takes_little_per_table(monkeypatch):
    """A level's counts are gathered predictor by predictor and property by property in tables of the open nodes alone: none spans all of them."""
    got = {}
    monkeypatch.setattr(operators, "count_stage", lambda docs, f, key: got.setdefault("f", f))
    ends = [np.arange(1, trees.BINS) * 64 - 512] * len(trees.PROPERTIES)
    operators._level(None, ends, {"en": {"": trees.Node(0, 0, 0.0)}}, {"en": [""]})
    sizes, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: sizes.append(k.get("minlength", 0)) or count(x, *a, **k))
    v = np.random.default_rng(1).integers(0, 256, 3000)
    s = Slice(v, np.array([1000, 2000]))
    out = got["f"](s, np.zeros(2, int), ["en"])
    assert max(sizes) <= trees.BINS * trees.TOKENS and (out.reshape(len(trees.CHOICES) * len(trees.PROPERTIES), -1).sum(1) == 3000).all()
