"""Regions and schedules: sharpened planes, multi-level squeezes, grid cells, boxes, scan orders, coders' settings, labels moved to the front, and
tables as separated text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import planes, rasters
from ..functions.planes import digest, plane_stage
from ..functions.rasters import raster_stage, residuals, zigzag
from ..registered import query
from ..sources import separated
from ..sources.shared import shared_path
from ..sources.tables import CELLS_SQL, RASTER_SQL, RESIDUAL_SQL, cells, table
from .entropy import context_clusters
from .planes import PLANE_SQL, _at, _digest_sql, _mapped

# ---------------------------------------------------------------- sharpening

#: Weights against the centre of the sides, the corners, the second sides, the knight's moves and the second corners.
SHARPEN = (-0.09495815671340026, -0.041031725066768575, 0.013710004822696948, 0.006510206083837737, -0.0014789063378272242)
_OF = {1: 0, 2: 1, 4: 2, 5: 3, 8: 4}  # by the square of the distance
_SUM = 1 + 4 * (SHARPEN[0] + SHARPEN[1] + SHARPEN[2] + SHARPEN[4] + 2 * SHARPEN[3])
_PLACES = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dy or dx]


@query("v20_sharpened", f"WITH {PLANE_SQL}, s AS (SELECT doc_id, {_mapped('(' + _at(0, 0) + ' + ' + ' + '.join(f'{SHARPEN[_OF[y * y + x * x]]!r}::DOUBLE * {_at(y, x)}' for y, x in _PLACES) + f') / {_SUM!r}::DOUBLE')} AS s FROM pl) SELECT doc_id, {_digest_sql('s')} AS digest FROM s")
def sharpened(spark, sf_dir):
    """Planes after the 5 by 5 filter that undoes the smoothing, the edge repeated."""

    def f(p):
        at = planes.around(p, 2)
        return None, digest((p + sum(SHARPEN[_OF[y * y + x * x]] * at(y, x) for y, x in _PLACES)) / _SUM)

    return plane_stage(table(spark, sf_dir, "documents"), f, "digest long")


# ---------------------------------------------------------------- squeeze schedules

#: Side up to which a channel is squeezed.
PREVIEW = 8


def schedule(width: int, height: int) -> list[bool]:
    """Steps of the default squeeze, true along rows: by turns until both sides are small, along columns first unless the channel is wider than high."""
    out = []
    if width <= height and height > PREVIEW:
        out.append(False)
        height = (height + 1) // 2
    while width > PREVIEW or height > PREVIEW:
        if width > PREVIEW:
            out.append(True)
            width = (width + 1) // 2
        if height > PREVIEW:
            out.append(False)
            height = (height + 1) // 2
    return out


def squeezed(p: np.ndarray, steps: list[bool]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Averages of the last step, and the residuals of each step; p: planes of whole numbers."""
    left = []
    for along in steps:
        q = p if along else p.transpose(0, 2, 1)
        n, lines, size = q.shape
        a, r = rasters.squeeze(np.pad(q.reshape(n * lines, size), ((0, 0), (0, size % 2))), np.full(n * lines, size))
        a, r = a[:, : (size + 1) // 2].reshape(n, lines, -1), r[:, : size // 2].reshape(n, lines, -1)
        p = a if along else a.transpose(0, 2, 1)
        left.append(r if along else r.transpose(0, 2, 1))
    return p, left


def unsqueezed(p: np.ndarray, left: list[np.ndarray], steps: list[bool]) -> np.ndarray:
    for along, r in zip(reversed(steps), reversed(left), strict=True):
        q, r = (p, r) if along else (p.transpose(0, 2, 1), r.transpose(0, 2, 1))
        n, lines, half = q.shape
        size = half + r.shape[2]
        a = np.concatenate([q.reshape(n * lines, half), np.zeros((n * lines, r.shape[2] + 1 - half), np.int64)], 1) if r.shape[2] + 1 > half else q.reshape(n * lines, half)
        out = rasters.unsqueeze(a, r.reshape(n * lines, -1), np.full(n * lines, size))[:, :size].reshape(n, lines, size)
        p = out if along else out.transpose(0, 2, 1)
    return p


def _whole(p: np.ndarray) -> np.ndarray:
    return np.rint(p * 255).astype(np.int64)


def _sum(x: np.ndarray) -> np.ndarray:
    x = x.reshape(len(x), -1)
    return (x * (np.arange(x.shape[1]) % 97 + 1)).sum(1)


@query("d12_squeeze_levels")
def squeeze_levels(spark, sf_dir):
    """The default squeeze of each plane: steps, digest of what is left at the end, size of the residuals; and digest of the plane without its first step's
    residuals."""

    def f(p):
        v = _whole(p)
        steps = schedule(v.shape[2], v.shape[1])
        low, left = squeezed(v, steps)
        rough = unsqueezed(low, [np.zeros_like(left[0]), *left[1:]], steps)
        magnitude = sum(np.abs(r).sum((1, 2)) for r in left)
        return None, np.full(len(v), len(steps)), _sum(low), magnitude, _sum(rough), np.abs(rough - v).sum((1, 2))

    return plane_stage(table(spark, sf_dir, "documents"), f, "steps long, low long, magnitude long, rough long, loss long")


@query("f06_squeeze_fits", f"WITH {RASTER_SQL}, s AS (SELECT doc_id, v * (1 << (doc_id % 24)) AS v FROM px) SELECT doc_id, bool_and(v BETWEEN -134217728 AND 134217728) AS fits, max(v) AS top FROM s GROUP BY doc_id")
def squeeze_fits(spark, sf_dir):
    """Whether all samples of a raster, shifted by some bits, are small enough for a squeeze."""
    top = raster_stage(table(spark, sf_dir, "documents"), lambda s: (None, np.maximum.reduceat(s.v, s.start)), "top long")
    t = top.withColumn("top", F.col("top") * F.expr("shiftleft(1L, CAST(doc_id % 24 AS INT))"))
    return t.select("doc_id", (F.col("top") <= 1 << 27).alias("fits"), "top")


GRID = 12


@query(
    "d05_grid_cells",
    f"""WITH {RASTER_SQL}, c AS (SELECT doc_id, p // 32 // {GRID} AS gy, p % 32 // {GRID} AS gx, p % 32 % {GRID} AS x, p // 32 % {GRID} AS y, v FROM px)
SELECT doc_id, CAST(gy AS BIGINT) AS gy, CAST(gx AS BIGINT) AS gx, max(x) + 1 AS width, max(y) + 1 AS height, count(*) AS n, CAST(sum(v * (y * {GRID} + x + 1)) AS BIGINT) AS digest FROM c GROUP BY doc_id, gy, gx""",
)
def grid_cells(spark, sf_dir):
    """Rasters cut into cells of 12 by 12 samples, clipped at the edge: their sides, samples and digest."""

    def f(s):
        across = -(-32 // GRID)
        cells_ = -(-(-(-s.size // 32)) // GRID) * across
        first = np.cumsum(cells_) - cells_
        at = first[s.row] + s.y // GRID * across + s.x // GRID
        x, y = s.x % GRID, s.y % GRID
        key, back = np.unique(at, return_inverse=True)
        wide, high = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        np.maximum.at(wide, back, x + 1)
        np.maximum.at(high, back, y + 1)
        of = np.searchsorted(first, key, "right") - 1
        place = key - first[of]
        total = np.zeros(len(key), np.int64)
        np.add.at(total, back, s.v * (y * GRID + x + 1))
        return of, place // across, place % across, wide, high, np.bincount(back), total

    return raster_stage(table(spark, sf_dir, "documents"), f, "gy long, gx long, width long, height long, n long, digest long")


# ---------------------------------------------------------------- boxes

_BOX = {"a": ("effort - 3", "effort - 3 + params % 4"), "b": ("image % 5", "image % 5 + bytes % 4"), "c": ("params % 5", "params % 5 + 1 + image % 4"), "d": ("bytes % 6", "bytes % 6 + 1 + effort % 3")}
_APART = "c0 >= a1 OR c1 <= a0 OR d0 >= b1 OR d1 <= b0"
_IN_A, _IN_B = "c0 <= a0 AND c1 >= a1", "d0 <= b0 AND d1 >= b1"
_CUT_A, _CUT_B = "CASE WHEN c0 > a0 AND c0 < a1 THEN c0 - 1 ELSE c1 - 1 END", "CASE WHEN d0 > b0 AND d0 < b1 THEN d0 - 1 ELSE d1 - 1 END"
_BOX_COLUMNS = [f"CAST({x} AS BIGINT) AS {k}{i}" for k, own in _BOX.items() for i, x in enumerate(own)]
_KIND = f"CASE WHEN {_APART} THEN 'none' WHEN {_IN_A} AND {_IN_B} THEN 'inside' ELSE 'partial' END"
_AXIS = f"CASE WHEN {_APART} THEN 0 WHEN NOT ({_IN_B}) THEN 1 ELSE 0 END"
_CUT = f"CASE WHEN {_APART} THEN 0 WHEN NOT ({_IN_B}) THEN {_CUT_B} WHEN NOT ({_IN_A}) THEN {_CUT_A} ELSE 0 END"


@query("f08_box_meetings", f"WITH {CELLS_SQL}, b AS (SELECT {', '.join(_BOX_COLUMNS)} FROM cells) SELECT a0, a1, b0, b1, c0, c1, d0, d1, {_KIND} AS kind, {_AXIS} AS axis, {_CUT} AS cut, count(*) AS n FROM b GROUP BY ALL")
def box_meetings(spark, sf_dir):
    """How a half-open box of two sides (a, b) lies to another (c, d): apart, inside it, or partly; then the last side that is cut, and the last value below the cut."""
    sides = [f"{k}{i}" for k in _BOX for i in (0, 1)]
    b = cells(spark, sf_dir).selectExpr(*_BOX_COLUMNS).groupBy(*sides).agg(F.count("*").alias("n"))
    return b.select(*sides, F.expr(_KIND).alias("kind"), F.expr(_AXIS).alias("axis"), F.expr(_CUT).alias("cut"), "n")


# ---------------------------------------------------------------- scan orders


def natural_order(wide: int, high: int) -> list[int]:
    """Places of a transform's coefficients (wide by high blocks of 8 by 8, wide at least high) in the order of their frequencies: the lowest wide times high first,
    row by row; then the diagonals of the square, upwards and downwards by turns, of which a flatter transform has every (wide/high)-th row."""
    side, ratio = 8 * wide, wide // high
    low = [(x, y) for y in range(high) for x in range(wide)]
    rest = []
    for d in range(2 * side - 1):
        line = [(d - k, k) for k in range(d + 1) if d - k < side and k < side]
        if d < side:
            line = line if d % 2 else line[::-1]
        else:
            line = line if (2 * side - 2 - d) % 2 else line[::-1]
        rest += [(x, y // ratio) for x, y in line if y % ratio == 0 and not (x < wide and y // ratio < high)]
    return [y * side + x for x, y in low + rest]


_ORDER = natural_order(2, 1)


@query(
    "v33_reordered",
    f"""WITH {PLANE_SQL}, b AS (SELECT doc_id, unnest(range(((h + 7) // 8) * 2)) AS k, h, l FROM pl),
o AS (SELECT doc_id, k, list_transform({_ORDER}, lambda c: l[1 + least(k // 2 * 8 + c // 16, h - 1) * 32 + k % 2 * 16 + c % 16]) AS o FROM b)
SELECT doc_id, count(*) AS blocks, CAST(sum(list_sum(list_transform(range(128), lambda i: CAST(floor(o[1 + i] * 1024 + 0.5) AS BIGINT) * ((k * 128 + i) % 97 + 1)))) AS BIGINT) AS digest FROM o GROUP BY doc_id""",
)
def reordered(spark, sf_dir):
    """Blocks of 16 by 8 samples in the order of their places in a transform of that shape: digest. Rows below the last repeat it."""

    def f(p):
        rows = np.minimum(np.arange(-(-p.shape[1] // 8) * 8), p.shape[1] - 1)
        b = p[:, rows].reshape(len(p), -1, 8, 2, 16).transpose(0, 1, 3, 2, 4).reshape(len(p), -1, 128)[:, :, _ORDER]
        return None, np.full(len(p), b.shape[1]), digest(b)

    return plane_stage(table(spark, sf_dir, "documents"), f, "blocks long, digest long")


# ---------------------------------------------------------------- coders' settings

#: Settings of a coder of whole numbers: values below 2 ** first are tokens themselves; a token holds so many of the next and of the last bits.
CODERS = ((4, 2, 0), (4, 1, 2), (4, 1, 0), (0, 0, 0), (2, 0, 1), (5, 2, 0))


def coded(u: np.ndarray, first: int, upper: int, lower: int) -> tuple[np.ndarray, np.ndarray]:
    """Token and raw bits of each value."""
    e = np.frexp(np.maximum(u, 1).astype(np.float64))[1] - 1
    rest = u - (1 << e)
    token = (1 << first) + ((e - first) << (upper + lower)) + ((rest >> np.maximum(e - upper, 0)) << lower) + (rest & ((1 << lower) - 1))
    return np.where(u < 1 << first, u, token), np.where(u < 1 << first, 0, e - upper - lower)


def _coder_sql() -> str:
    e = "CAST(floor(log2(greatest(u, 1))) AS BIGINT)"
    parts = []
    for k, (first, upper, lower) in enumerate(CODERS):
        rest = f"(u - (1 << {e}))"
        token = f"{1 << first} + (({e} - {first}) << {upper + lower}) + (({rest} >> greatest({e} - {upper}, 0)) << {lower}) + ({rest} & {(1 << lower) - 1})"
        parts.append(f"SELECT doc_id, {k} AS k, CASE WHEN u < {1 << first} THEN u ELSE {token} END AS token, CASE WHEN u < {1 << first} THEN 0 ELSE {e} - {upper + lower} END AS raw FROM tok")
    return " UNION ALL ".join(parts)


@query(
    "g32_coder_choice",
    f"""WITH {RASTER_SQL}, {RESIDUAL_SQL}, t AS ({_coder_sql()}), h AS (SELECT doc_id, k, token, count(*) AS c, sum(raw) AS raw FROM t GROUP BY ALL),
s AS (SELECT doc_id, k, round(sum(c) * log2(sum(c)) - sum(c * log2(c)) + sum(raw), 3) AS bits FROM h GROUP BY doc_id, k)
SELECT doc_id, {', '.join(f'max(bits) FILTER (k = {k}) AS bits{k}' for k in range(len(CODERS)))}, CAST(min_by(k, bits * 1000 + k / 100.0::DOUBLE) AS BIGINT) AS best FROM s GROUP BY doc_id""",
)
def coder_choice(spark, sf_dir):
    """Bits of a document's residuals under each setting (tokens by their entropy, and raw bits), and the cheapest (of equal ones the first)."""

    def f(s):
        u, n = zigzag(residuals(s)), s.size.astype(float)
        bits = []
        for setting in CODERS:
            token, raw = coded(u, *setting)
            of, _, c = s.counts(token, 2048)
            bits.append(np.round(n * np.log2(n) - np.bincount(of, c * np.log2(c.astype(float)), s.n) + s.total(raw), 3))
        return None, *bits, np.argmin(np.stack(bits), 0)

    return raster_stage(table(spark, sf_dir, "documents"), f, ", ".join(f"bits{k} double" for k in range(len(CODERS))) + ", best long")


def moved_to_front(labels: np.ndarray) -> np.ndarray:
    """Each label's place in a list to whose front it then moves; the list begins in order."""
    front = list(range(int(labels.max(initial=0)) + 1))
    out = []
    for x in labels.tolist():
        out.append(front.index(x))
        front.insert(0, front.pop(out[-1]))
    return np.array(out, np.int64)


@query("w12_moved_labels")
def moved_labels(spark, sf_dir):
    """The clusters of each language's contexts, in the order of contexts (64 at most), moved to the front."""
    import pyarrow as pa

    def run(t):
        t = t.sort_by("context")
        return pa.table([t.column("lang"), t.column("context"), t.column("cluster"), pa.array(moved_to_front(t.column("cluster").to_numpy()))], names=["lang", "context", "cluster", "moved"])

    return context_clusters(spark, sf_dir).select("lang", "context", "cluster").groupBy("lang").applyInArrow(run, "lang string, context long, cluster long, moved long")


# ---------------------------------------------------------------- separated text


@query(
    "s14_separated_cells",
    f"""WITH {CELLS_SQL} SELECT image, effort, strategy, count(*) AS n, CAST(sum(CASE WHEN l_orderkey % 5 > 0 THEN bytes END) AS BIGINT) AS bytes, count(*) FILTER (l_orderkey % 5 = 0) AS missing, round(sum(quality), 6) AS quality, count(*) FILTER (distance < 1) AS near FROM cells GROUP BY image, effort, strategy""",
)
def separated_cells(spark, sf_dir):
    """Cells written as separated text with comment lines and missing numbers, and read again with the columns that are wanted: sums by key."""
    c = cells(spark, sf_dir).withColumn("bytes", F.when(F.col("l_orderkey") % 5 > 0, F.col("bytes")))
    path = separated.write(c, shared_path(spark, "cells"), comment="cells of an experiment\n# one row a cell")
    t = separated.read(spark, path, "strategy string, image bigint, effort int, bytes bigint, quality double, distance double, absent double")
    return t.groupBy("image", "effort", "strategy").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes").isNull()).alias("missing"), F.round(F.sum("quality"), 6).alias("quality"), F.count_if(F.col("distance") < 1).alias("near"))
