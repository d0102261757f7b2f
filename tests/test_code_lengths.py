"""Lengths and codes of whole texts, row by row, against the rules told sample by sample and node by node."""

import random
from collections import Counter

import pytest
from pyspark.sql import SparkSession

from quarry import registry
from quarry.sources.tables import WIDTH
from tests.test_edges import TEXTS

DIR = "/root/testdata/sf0.001"
LIMIT = 15


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def guess(v, i):
    """The clamped gradient of the samples before place i."""
    x, y = i % WIDTH, i // WIDTH
    w = v[i - 1] if x else v[i - WIDTH] if y else 0
    n = v[i - WIDTH] if y else w
    nw = v[i - WIDTH - 1] if x and y else w
    return max(min(n, w), min(max(n, w), n + w - nw))


def token(r):
    u = 2 * r if r >= 0 else -2 * r - 1
    e = u.bit_length() - 1
    return u if u < 16 else 16 + 4 * (e - 4) + ((u >> (e - 2)) & 3)


def tokens(text):
    v = [ord(c) & 255 for c in text]
    return Counter(token(s - guess(v, i)) for i, s in enumerate(v))


def depths(counts):
    """Length of each symbol, and how often the least count was raised."""
    raised = 0
    while True:
        pool = sorted(([max(n, 2**raised - 1), s, None] for s, n in counts.items()), key=lambda p: (p[0], -p[1]))
        leaves, nodes = pool[:], []
        while len(leaves) + len(nodes) > 1:
            pair = [(leaves if leaves and (not nodes or leaves[0][0] <= nodes[0][0]) else nodes).pop(0) for _ in range(2)]
            nodes.append([pair[0][0] + pair[1][0], None, pair])
        out, todo = {}, [((leaves + nodes)[0], 0)]
        while todo:
            (_, s, pair), deep = todo.pop()
            if pair:
                todo += [(p, deep + 1) for p in pair]
            else:
                out[s] = max(deep, 1)
        if max(out.values()) <= LIMIT:
            return out, raised
        raised += 1


def rows_of(doc_id, text):
    counts = tokens(text)
    lengths, _ = depths(counts)
    code, last = 0, 0
    for size, s in sorted((size, s) for s, size in lengths.items()):
        code, last = code << (size - last), size
        yield doc_id, s, counts[s], size, int(format(code, f"0{size}b")[::-1], 2)
        code += 1


def steep(symbols, least, seed):
    """A text whose residuals occur so often as each two before it together, from the least on; small steps are the frequent ones."""
    rng, some = random.Random(seed), list(least)
    while len(some) < symbols:
        some.append(some[-1] + some[-2])
    steps = [0, 1, -1, 2, -2, 3, -3, 4, -4, 5, -5, 6, -6, 7, -7, -8, 8, 10, 12, 14, 16, 20, 24, 28][:symbols]
    left, v = dict(zip(steps, reversed(some), strict=True)), []
    while left:
        p = guess(v + [0], len(v))
        fits = [r for r in left if 0 <= p + r <= 255]
        if not fits:
            break
        # back to the middle, where every step fits
        towards = [r for r in fits if (r > 0) == (p < 128)] if not 64 <= p < 192 else fits
        r = rng.choices(towards or fits, [left[r] for r in towards or fits])[0]
        left[r] -= 1
        if not left[r]:
            del left[r]
        v.append(p + r)
    return "".join(map(chr, v))


def check(spark, path):
    texts = [(r[0], r[1]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["n07_code_lengths"](spark, path).select("doc_id", "token", "n", "length", "code").collect()
    assert Counter(map(tuple, got)) == Counter(row for doc_id, text in texts if text for row in rows_of(doc_id, text))


def test_every_row(spark):
    check(spark, DIR)


def test_odd_and_limited_texts(spark, tmp_path):
    limited = [steep(symbols, least, seed) for symbols, least in ((17, (1, 1)), (18, (1, 1)), (19, (1, 1, 1, 1, 4)), (19, (1, 1, 1, 2, 4))) for seed in range(2)]
    assert sum(depths(tokens(x))[1] > 0 for x in limited) >= 6
    rows = [*enumerate([*TEXTS, *limited], 1), (3, "a"), (4, "another text"), (None, "no id"), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path))
