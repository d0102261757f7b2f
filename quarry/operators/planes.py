"""Filters over whole planes of texts, across the edges of blocks and tiles; each plane in the task that reads its text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import planes
from ..functions.planes import digest, plane_stage
from ..registered import query
from ..sources.tables import table
from .stencils import CORNER, SIDE, TAPS

#: SQL for planes: doc_id, h (rows), l (samples from 0 to 1, row by row, 32 in each).
PLANE_SQL = """tx AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: (ascii(x) % 256) / 255.0::DOUBLE) AS c FROM documents WHERE length(text) > 0),
pl AS (SELECT doc_id, (len(c) + 31) // 32 AS h, list_transform(range((len(c) + 31) // 32 * 32), lambda i: c[1 + least(i, len(c) - 1)]) AS l FROM tx)"""


def _at(dy: int, dx: int, l: str = "l", h: str = "h", w: int = 32, i: str = "i") -> str:  # noqa: E741
    """SQL for the neighbour of sample i, the edge repeated."""
    y, x = f"{i} // {w}", f"{i} % {w}"
    y = f"greatest(0, least({h} - 1, {y} + {dy}))" if dy else y
    x = f"greatest(0, least({w - 1}, {x} + {dx}))" if dx else x
    return f"{l}[1 + ({y}) * {w} + ({x})]"


def _mapped(expr: str, n: str = "h * 32") -> str:
    return f"list_transform(range({n}), lambda i: {expr})"


def _digest_sql(lst: str) -> str:
    return f"CAST(list_sum(list_transform(range(len({lst})), lambda i: CAST(floor({lst}[1 + i] * 1024 + 0.5) AS BIGINT) * (i % 97 + 1))) AS BIGINT)"


def _stage(spark, sf_dir, f, fields):
    return plane_stage(table(spark, sf_dir, "documents"), f, fields)


_SMOOTH = f"({_at(0, 0)} + {SIDE!r}::DOUBLE * ({_at(0, -1)} + {_at(0, 1)} + {_at(-1, 0)} + {_at(1, 0)}) + {CORNER!r}::DOUBLE * ({_at(-1, -1)} + {_at(-1, 1)} + {_at(1, -1)} + {_at(1, 1)})) / {1 + 4 * (SIDE + CORNER)!r}::DOUBLE"


@query("v48_plane_smoothed", f"WITH {PLANE_SQL}, s AS (SELECT doc_id, h, {_mapped(_SMOOTH)} AS s FROM pl) SELECT doc_id, h AS height, {_digest_sql('s')} AS digest FROM s")
def plane_smoothed(spark, sf_dir):
    """Planes after the 3 by 3 smoothing filter."""
    return _stage(spark, sf_dir, lambda p: (None, np.full(len(p), p.shape[1]), digest(planes.smoothed(p, SIDE, CORNER))), "height long, digest long")


#: Least gradient and bend, and the ratio of bends, of a ridge.
LEAST, RATIO = 0.15, 5.0
_INNER = "i // 32 BETWEEN 1 AND h - 2 AND i % 32 BETWEEN 1 AND 30"
_GX = f"CASE WHEN {_INNER} THEN ({_at(-1, 1)} + 2 * {_at(0, 1)} + {_at(1, 1)}) - ({_at(-1, -1)} + 2 * {_at(0, -1)} + {_at(1, -1)}) ELSE 0 END"
_GY = f"CASE WHEN {_INNER} THEN ({_at(1, -1)} + 2 * {_at(1, 0)} + {_at(1, 1)}) - ({_at(-1, -1)} + 2 * {_at(-1, 0)} + {_at(-1, 1)}) ELSE 0 END"


@query(
    "v58_plane_gradients",
    f"""WITH {PLANE_SQL}, g AS (SELECT doc_id, h, {_mapped(_GX)} AS gx, {_mapped(_GY)} AS gy FROM pl),
m AS (SELECT *, {_mapped('sqrt(gx[1 + i] * gx[1 + i] + gy[1 + i] * gy[1 + i])')} AS m FROM g)
SELECT doc_id, {_digest_sql('gx')} AS across, {_digest_sql('gy')} AS down, {_digest_sql('m')} AS length FROM m""",
)
def plane_gradients(spark, sf_dir):
    """Sobel gradients of whole planes and their length."""
    return _stage(spark, sf_dir, lambda p: (None, *(digest(x) for x in planes.gradients(p))), "across long, down long, length long")


@query("v59_ridges")
def ridges(spark, sf_dir):
    """Samples whose gradient is a maximum along its direction, and those of them on a ridge: number and digest."""

    def f(p):
        across, down, length = planes.gradients(p)
        top = planes.maxima(across, down, length, LEAST)
        ridge = planes.ridges(p, top, LEAST, RATIO)
        return None, top.sum((1, 2)), digest(top), ridge.sum((1, 2)), digest(ridge)

    return _stage(spark, sf_dir, f, "maxima long, maxima_digest long, ridges long, ridges_digest long")


@query(
    "v63_plane_means",
    f"""WITH {PLANE_SQL}, s AS (SELECT doc_id, i // 32 // 5 AS y, i % 32 // 5 AS x, avg(v) AS v FROM (SELECT doc_id, unnest(range(h * 32)) AS i, unnest(l) AS v FROM pl) GROUP BY ALL)
SELECT doc_id, count(*) AS boxes, CAST(sum(CAST(floor(v * 1024 + 0.5) AS BIGINT) * ((y * 7 + x) % 97 + 1)) AS BIGINT) AS digest FROM s GROUP BY doc_id""",
)
def plane_means(spark, sf_dir):
    """Means of boxes of 5 by 5 samples."""

    def f(p):
        m = planes.box_means(p, 5)
        return None, np.full(len(p), m.shape[1] * m.shape[2]), digest(m)

    return _stage(spark, sf_dir, f, "boxes long, digest long")


_LAPLACIAN = f"4 * {_at(0, 0)} - {_at(-1, 0)} - {_at(1, 0)} - {_at(0, -1)} - {_at(0, 1)}"


@query(
    "v72_plane_activity",
    f"""WITH {PLANE_SQL}, a AS (SELECT doc_id, h, {_mapped(f'abs({_LAPLACIAN})')} AS a FROM pl), u AS (SELECT doc_id, unnest(range(h * 32)) AS i, unnest(a) AS v FROM a)
SELECT doc_id, CAST(i // 512 AS BIGINT) AS y, CAST(i % 32 // 16 AS BIGINT) AS x, round(avg(v), 9) AS activity FROM u GROUP BY doc_id, i // 512, i % 32 // 16""",
)
def plane_activity(spark, sf_dir):
    """Mean size of the four-neighbour Laplacian in tiles of 16 by 16 samples; neighbours are those of the plane."""

    def f(p):
        m = planes.box_means(np.abs(planes.laplacian(p)), 16)
        of, y, x = (a.ravel() for a in np.indices(m.shape))
        return of, y, x, m.ravel()

    return _stage(spark, sf_dir, f, "y long, x long, activity double").withColumn("activity", F.round("activity", 9))


@query(
    "l09_plane_blur",
    f"""WITH {PLANE_SQL}, r AS (SELECT doc_id, h, {_mapped(' + '.join(f'{TAPS[abs(k)]!r}::DOUBLE * {_at(0, k)}' for k in (0, -1, 1, -2, 2)))} AS l FROM pl),
b AS (SELECT doc_id, {_mapped(' + '.join(f'{TAPS[abs(k)]!r}::DOUBLE * {_at(k, 0)}' for k in (0, -1, 1, -2, 2)))} AS b FROM r) SELECT doc_id, {_digest_sql('b')} AS digest FROM b""",
)
def plane_blur(spark, sf_dir):
    """Planes after a blur of five taps along rows and columns."""
    return _stage(spark, sf_dir, lambda p: (None, digest(planes.blurred(p, TAPS))), "digest long")


def _level_sql(k: int, w: int) -> str:
    """SQL for a level of a pyramid: a plane l of h rows and w columns is blurred, halved, and compared with its repeated half."""
    row = " + ".join(f"{t} * {_at(0, dx, w=w)}" for t, dx in ((0.5, 0), (0.25, -1), (0.25, 1)))
    column = " + ".join(f"{t} * {_at(dy, 0, l='r', w=w)}" for t, dy in ((0.5, 0), (0.25, -1), (0.25, 1)))
    half = w // 2
    return f"""r{k} AS (SELECT doc_id, h, l, {_mapped(row, f'h * {w}')} AS r FROM p{k}), b{k} AS (SELECT doc_id, h, l, {_mapped(column, f'h * {w}')} AS b FROM r{k}),
d{k} AS (SELECT doc_id, h, l, (h + 1) // 2 AS k, {_mapped(f'b[1 + i // {half} * 2 * {w} + i % {half} * 2]', f'(h + 1) // 2 * {half}')} AS d FROM b{k}),
e{k} AS (SELECT doc_id, list_sum({_mapped(f"power(l[1 + i] - d[1 + (i // {w}) * k // h * {half} + (i % {w}) * {half} // {w}], 2)", f'h * {w}')}) AS e FROM d{k}), p{k + 1} AS (SELECT doc_id, k AS h, d AS l FROM d{k})"""


@query(
    "l07_pyramid",
    f"WITH {PLANE_SQL}, p0 AS (SELECT doc_id, h, l FROM pl), {_level_sql(0, 32)}, {_level_sql(1, 16)}, {_level_sql(2, 8)} SELECT doc_id, round(e0.e, 6) AS detail0, round(e1.e, 6) AS detail1, round(e2.e, 6) AS detail2, round(list_sum(list_transform(l, lambda x: x * x)), 6) AS rest FROM e0 JOIN e1 USING (doc_id) JOIN e2 USING (doc_id) JOIN p3 USING (doc_id)",
)
def pyramid(spark, sf_dir):
    """Energy of the details of three levels of a pyramid, and of what is left."""

    def f(p):
        details, rest = planes.pyramid(p, 3)
        return None, *((x**2).sum((1, 2)) for x in (*details, rest))

    names = ("detail0", "detail1", "detail2", "rest")
    return _stage(spark, sf_dir, f, ", ".join(f"{c} double" for c in names)).withColumns({c: F.round(c, 6) for c in names})


def _mirrored(dy: int, dx: int) -> str:
    """SQL for the neighbour of sample i, mirrored at the edge."""
    fold = lambda x, n: f"(CASE WHEN {x} < 0 THEN (-1 - ({x})) % (2 * {n}) ELSE ({x}) % (2 * {n}) END)"
    back = lambda x, n: f"(CASE WHEN {fold(x, n)} < {n} THEN {fold(x, n)} ELSE 2 * {n} - 1 - {fold(x, n)} END)"
    return f"l[1 + {back(f'(i // 32 + {dy})', 'h')} * 32 + {back(f'(i % 32 + {dx})', '32')}]"


_CROSS = ((0, 0), (-1, 0), (0, -1), (1, 0), (0, 1))
_BLOCK_OF = "1 + i // 256 * 4 + i % 32 // 8"


def _weight(dy: int, dx: int) -> str:
    apart = " + ".join(f"abs({_mirrored(y, x)} - {_mirrored(dy + y, dx + x)})" for y, x in _CROSS)
    return f"greatest(({apart}) * {planes.CHANNEL_SCALE}::DOUBLE * s[{_BLOCK_OF}] * {planes.STEP_SCALE}::DOUBLE * CASE WHEN i // 32 % 8 IN (0, 7) OR i % 8 IN (0, 7) THEN {planes.BORDER_SCALE!r}::DOUBLE ELSE 1 END + 1, 0)"


_SIDES = ((0, -1), (-1, 0), (1, 0), (0, 1))
#: Quantiser of a block: by how far apart its samples are; its sharpness: by its place.
_QUANT_SQL = "1 + CAST(floor((max(v) - min(v)) * 15 + 0.000001) AS BIGINT)"


@query(
    "v22_edge_preserved",
    f"""WITH {PLANE_SQL}, q AS (SELECT doc_id, i // 256 * 4 + i % 32 // 8 AS b, {_QUANT_SQL} AS q FROM (SELECT doc_id, unnest(range(h * 32)) AS i, unnest(l) AS v FROM pl) GROUP BY ALL),
z AS (SELECT doc_id, list(1.0::DOUBLE / least({planes.QUANT_SCALE}::DOUBLE / (0.5::DOUBLE * q * {planes.INVERSE_SCALE}::DOUBLE) * ((b % 8) / 7.0::DOUBLE), -0.0001::DOUBLE) ORDER BY b) AS s FROM q GROUP BY doc_id),
t AS (SELECT doc_id, h, l, s, {', '.join(f"{_mapped(_weight(*d))} AS w{k}" for k, d in enumerate(_SIDES))} FROM pl JOIN z USING (doc_id)),
o AS (SELECT doc_id, {_mapped(f"CASE WHEN s[{_BLOCK_OF}] < {planes.LEAST_INVERSE}::DOUBLE THEN l[1 + i] ELSE (l[1 + i] + " + ' + '.join(f'w{k}[1 + i] * {_mirrored(*d)}' for k, d in enumerate(_SIDES)) + ") / (1 + " + ' + '.join(f'w{k}[1 + i]' for k in range(4)) + ") END")} AS o, s FROM t)
SELECT doc_id, len(s) AS blocks, {_digest_sql('o')} AS digest FROM o""",
)
def edge_preserved(spark, sf_dir):
    """Planes after the edge-preserving filter; its strength follows each block's quantiser and sharpness."""

    def f(p):
        h = -(-p.shape[1] // 8)
        wide = np.concatenate([p, np.repeat(p[:, -1:], h * 8 - p.shape[1], 1)], 1).reshape(len(p), h, 8, 4, 8)
        quant = 1 + np.floor((wide.max((2, 4)) - wide.min((2, 4))) * 15 + 0.000001)
        inverse = planes.inverse_deviations(quant, np.arange(h * 4).reshape(h, 4) % 8, 0.5)
        return None, np.full(len(p), h * 4), digest(planes.edge_preserved(p, inverse))

    return _stage(spark, sf_dir, f, "blocks long, digest long")


#: A blob begins above HIGH and grows above LOW; it stands out by SCORE deviations, and its box is smaller than the window.
HIGH, LOW, SCORE = 0.04, 0.02, 1.0


@query("v52_blobs")
def blobs(spark, sf_dir):
    """Blobs of every plane: box, samples, place of most energy, score, and the ellipse of their moments. Those whose box is too large or that do not stand
    out are left out."""

    def f(p):
        e, smooth = planes.energy(p)
        rows = []
        for k in range(len(p)):
            for own in planes.components(e[k], LOW, HIGH):
                c = planes.component_stats(e[k], own)
                if max(c["height"], c["width"]) >= planes.WINDOW or c["score"] < SCORE:
                    continue
                shape = planes.ellipse(p[k], smooth[k], (c["mode_y"], c["mode_x"]))
                rows.append((k, *(c[x] for x in ("top", "left", "height", "width", "pixels", "mode_y", "mode_x")), *(round(x, 6) for x in (c["score"], *shape))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 16
        return tuple(np.array(c, np.int64 if i < 8 else np.float64) for i, c in enumerate(columns))

    return _stage(spark, sf_dir, f, '"top" long, "left" long, height long, width long, pixels long, mode_y long, mode_x long, score double, x double, y double, large double, small double, angle double, intensity double, loss double'.replace('"', ""))
