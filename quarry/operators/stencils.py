"""Neighbourhood filters on blocks of 8 by 8 samples, and byte prediction over whole texts; nothing is shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.rasters import WIDTH, raster_stage, residuals, zigzag
from ..registered import query
from ..sources.tables import DIGEST, RASTER_SQL, RESIDUAL_SQL, table
from .blocks import AROUND_SQL, BLOCK_SQL, _blocks, block_stage
from .scalars import ONES, RECIPROCAL


def _padded(x: np.ndarray, by: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (by, by), (by, by)), mode="edge")


# Weights of the smoothing filter's sides and corners against its centre, before they are made to add up to 1.
SIDE, CORNER = 0.10469957 * 1.1, 0.05568054 * 1.1
_ALL = 1 + 4 * (SIDE + CORNER)


@query("v48_smoothed", f"WITH {BLOCK_SQL}, {AROUND_SQL} SELECT vec_id, CAST(p AS INT) AS k, round(sum(y * CASE w WHEN 0.25 THEN {1 / _ALL!r}::DOUBLE WHEN 0.125 THEN {SIDE / _ALL!r}::DOUBLE ELSE {CORNER / _ALL!r}::DOUBLE END), 6) AS v FROM around GROUP BY vec_id, p")
def smoothed(spark, sf_dir):
    """Samples after the 3 by 3 smoothing filter, the edge repeated."""

    def f(x):
        wide = _padded(x, 1)
        at = lambda dy, dx: wide[:, 1 + dy : 9 + dy, 1 + dx : 9 + dx]
        sides = at(0, 1) + at(0, -1) + at(1, 0) + at(-1, 0)
        corners = at(1, 1) + at(1, -1) + at(-1, 1) + at(-1, -1)
        return (x + SIDE * sides + CORNER * corners) / _ALL

    return block_stage(spark, sf_dir, f, "v")


_SOBEL_SQL = """g AS (SELECT a.vec_id, a.p, sum(b.x * dx * (2 - abs(dy))) AS gx, sum(b.x * dy * (2 - abs(dx))) AS gy FROM e a, (SELECT unnest([-1, 0, 1]) AS dy) v, (SELECT unnest([-1, 0, 1]) AS dx) h
JOIN e b ON b.vec_id = a.vec_id AND b.p = a.p + 8 * dy + dx WHERE a.p // 8 BETWEEN 1 AND 6 AND a.p % 8 BETWEEN 1 AND 6 GROUP BY ALL)"""


@query("v58_gradients", f"WITH {BLOCK_SQL}, {_SOBEL_SQL}, f AS (SELECT vec_id, p, coalesce(gx, 0) AS gx, coalesce(gy, 0) AS gy FROM e LEFT JOIN g USING (vec_id, p)) SELECT vec_id, CAST(3 * p + c AS INT) AS k, round(CASE c WHEN 0 THEN gx WHEN 1 THEN gy ELSE sqrt(gx * gx + gy * gy) END, 6) + 0.0 AS v FROM f, (SELECT unnest([0, 1, 2]) AS c)")
def gradients(spark, sf_dir):
    """Horizontal and vertical Sobel gradients and their length, three values a sample; 0 at the border."""

    def f(x):
        out = np.zeros((*x.shape, 3))
        across, down = x[:, :, 2:] - x[:, :, :-2], x[:, 2:, :] - x[:, :-2, :]
        out[:, 1:-1, 1:-1, 0] = across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:]
        out[:, 1:-1, 1:-1, 1] = down[:, :, :-2] + 2 * down[:, :, 1:-1] + down[:, :, 2:]
        out[..., 2] = np.hypot(out[..., 0], out[..., 1])
        return out

    return block_stage(spark, sf_dir, f, "v")


@query("v63_box_means", f"WITH {BLOCK_SQL} SELECT vec_id, CAST(p // 24 * 3 + p % 8 // 3 AS INT) AS k, round(avg(x), 6) + 0.0 AS v FROM e GROUP BY vec_id, p // 24 * 3 + p % 8 // 3")
def box_means(spark, sf_dir):
    """Means of boxes of 3 by 3 samples; boxes at the lower and right edge hold what is left."""
    at = np.arange(0, 8, 3)
    n = np.diff([*at, 8])
    return block_stage(spark, sf_dir, lambda x: np.add.reduceat(np.add.reduceat(x, at, 1), at, 2) / np.outer(n, n), "v")


@query("v72_tile_activity", f"WITH {BLOCK_SQL}, {AROUND_SQL}, l AS (SELECT vec_id, p, abs(4 * x - sum(CASE WHEN w = 0.125 THEN y ELSE 0 END)) AS d FROM around GROUP BY vec_id, p, x) SELECT vec_id, CAST(p // 32 * 2 + p % 8 // 4 AS INT) AS k, round(avg(d), 6) AS v FROM l GROUP BY vec_id, p // 32 * 2 + p % 8 // 4")
def tile_activity(spark, sf_dir):
    """Mean size of the four-neighbour Laplacian in tiles of 4 by 4 samples, the edge repeated."""

    def f(x):
        wide = _padded(x, 1)
        around = wide[:, :-2, 1:-1] + wide[:, 2:, 1:-1] + wide[:, 1:-1, :-2] + wide[:, 1:-1, 2:]
        return np.abs(4 * x - around).reshape(-1, 2, 4, 2, 4).mean((2, 4))

    return block_stage(spark, sf_dir, f, "v")


#: Centre, near and far tap of the blur, for a deviation of 1.2 samples.
TAPS = tuple(float(x) for x in np.exp(-np.arange(3) ** 2 / 2.88) / (np.exp(-np.arange(-2, 3) ** 2 / 2.88)).sum())


@query("l09_row_blur", f"WITH {BLOCK_SQL} SELECT a.vec_id, CAST(a.p AS INT) AS k, round(sum(b.x * CASE abs(dx) WHEN 0 THEN {TAPS[0]!r}::DOUBLE WHEN 1 THEN {TAPS[1]!r}::DOUBLE ELSE {TAPS[2]!r}::DOUBLE END), 6) + 0.0 AS v FROM e a, (SELECT unnest([-2, -1, 0, 1, 2]) AS dx) h JOIN e b ON b.vec_id = a.vec_id AND b.p = a.p // 8 * 8 + least(greatest(a.p % 8 + dx, 0), 7) GROUP BY a.vec_id, a.p")
def row_blur(spark, sf_dir):
    """Rows after a blur of five taps, the edge repeated."""

    def f(x):
        wide = _padded(x, 2)[:, 2:-2]
        return sum(TAPS[abs(k)] * wide[:, :, 2 + k : 10 + k] for k in range(-2, 3))

    return block_stage(spark, sf_dir, f, "v")


_QUANTISED = "round(x * 16)"


@query("v16_dequantised", f"WITH {BLOCK_SQL}, q AS (SELECT vec_id, p, {_QUANTISED} AS q FROM e) SELECT vec_id, CAST(p AS INT) AS k, round(CASE WHEN q = 0 THEN 0 WHEN abs(q) = 1 THEN q * CASE vec_id % 3 WHEN 0 THEN {ONES[0]!r}::DOUBLE WHEN 1 THEN {ONES[1]!r}::DOUBLE ELSE {ONES[2]!r}::DOUBLE END ELSE q - {RECIPROCAL}::DOUBLE / q END * (1 + p / 64.0::DOUBLE), 6) + 0.0 AS v FROM q")
def dequantised(spark, sf_dir):
    """Coefficients from quantised ones of three channels: moved towards zero, times the weight of their place."""
    x = _blocks(spark, sf_dir).select("vec_id", F.posexplode("x").alias("k", "x")).select("vec_id", "k", F.round(F.col("x") * 16).alias("q"))
    one = F.get(F.array(*map(F.lit, ONES)), (F.col("vec_id") % 3).cast("int"))
    y = F.when(F.col("q") == 0, 0.0).when(F.abs("q") == 1, F.col("q") * one).otherwise(F.col("q") - RECIPROCAL / F.col("q"))
    return x.filter("q IS NOT NULL").select("vec_id", "k", (F.round(y * (1 + F.col("k") / 64), 6) + 0.0).alias("v"))


@query("v35_nonzeros", f"WITH {BLOCK_SQL} SELECT vec_id, count(*) FILTER (p > 0 AND {_QUANTISED} <> 0) AS n FROM e GROUP BY vec_id")
def nonzeros(spark, sf_dir):
    """Coefficients of a block that do not quantise to zero, without the one of lowest frequency."""
    found = F.filter("x", lambda v, i: (i > 0) & (F.round(v * 16) != 0))
    return _blocks(spark, sf_dir).select("vec_id", F.size(found).cast("long").alias("n"))


def _texts(spark, sf_dir, f, fields):
    return raster_stage(table(spark, sf_dir, "documents"), f, fields)


@query("g04_alphabet_size", f"WITH {RASTER_SQL}, {RESIDUAL_SQL} SELECT doc_id, max(u) + 1 AS size FROM tok GROUP BY doc_id")
def alphabet_size(spark, sf_dir):
    """One more than the largest unsigned residual of a text."""
    return _texts(spark, sf_dir, lambda s: (None, np.maximum.reduceat(zigzag(residuals(s)), np.cumsum(s.size) - s.size) + 1), "size long")


@query("m24_unshuffled", f"WITH {RASTER_SQL}, h AS (SELECT doc_id, p, v, (count(*) OVER (PARTITION BY doc_id) + 3) // 4 AS h FROM px), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p % h, p // h) - 1 AS from_p FROM h) SELECT t.doc_id, {DIGEST.format('s.v').replace('p %', 't.p %')} AS digest FROM t JOIN px s ON s.doc_id = t.doc_id AND s.p = t.from_p GROUP BY t.doc_id")
def unshuffled(spark, sf_dir):
    """Samples dealt to four columns in turn, each column after the other, as a digest."""

    def f(s):
        p, height = s.y * WIDTH + s.x, (-(-s.size // 4))[s.row]
        out = np.empty_like(s.v)
        out[np.lexsort((p // height, p % height, s.row))] = s.v
        return None, s.digest(out)

    return _texts(spark, sf_dir, f, "digest long")


_BEFORE = ", ".join(f"lag(v, {4 * k}) OVER w AS b{k}" for k in (1, 2, 3))
_LINES = ("b1", "2 * b1 - b2", "3 * b1 - 3 * b2 + b3")


@query("m23_byte_prediction", f"WITH {RASTER_SQL}, b AS (SELECT doc_id, p, v, {_BEFORE} FROM px WINDOW w AS (PARTITION BY doc_id ORDER BY p)) SELECT doc_id, {', '.join(f'CAST(coalesce(sum(((v - ({g})) % 256 + 256) % 256 * (p % 97 + 1)) FILTER (p >= 12), 0) AS BIGINT) AS order{k}' for k, g in enumerate(_LINES))} FROM b GROUP BY doc_id")
def byte_prediction(spark, sf_dir):
    """Bytes less their prediction from every fourth byte before, by a constant, a line and a parabola, as digests."""

    def f(s):
        there = s.y * WIDTH + s.x >= 12
        b1, b2, b3 = (np.concatenate([np.zeros(min(4 * k, len(s.v)), np.int64), s.v[: -4 * k]]) for k in (1, 2, 3))
        return None, *(s.digest(np.where(there, (s.v - g) & 255, 0)) for g in (b1, 2 * b1 - b2, 3 * b1 - 3 * b2 + b3))

    return _texts(spark, sf_dir, f, "order0 long, order1 long, order2 long")
