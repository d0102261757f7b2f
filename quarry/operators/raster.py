"""Integer raster operators: prediction, coding, histograms, runs, wavelet and colour steps, each one pass over whole texts within
the tasks that read them (see functions.rasters). Only counts are shuffled, by document and symbol."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rasters
from ..functions.rasters import Slice, raster_stage, residuals
from ..registered import query
from ..sources.tables import DIGEST, RASTER_SQL, RESIDUAL_SQL, table


def _stage(spark, sf_dir, f, fields, keep=("doc_id",)):
    return raster_stage(table(spark, sf_dir, "documents"), f, fields, keep)


@query("w02_gradient_residual", f"WITH {RASTER_SQL}, {RESIDUAL_SQL} SELECT doc_id, count(*) AS n, CAST(sum(abs(r)) AS BIGINT) AS cost, CAST(sum(CASE WHEN r = 0 THEN 1 ELSE 0 END) AS BIGINT) AS exact, {DIGEST.format('r')} AS digest FROM res GROUP BY doc_id")
def gradient_residual(spark, sf_dir):
    def f(s):
        r = residuals(s)
        return None, s.size, s.total(np.abs(r)), s.total(r == 0), s.digest(r)

    return _stage(spark, sf_dir, f, "n long, cost long, exact long, digest long")


_SEVEN = ("w", "n", "nw", "ne", "ww", "nn", "nee")


@query("j13_neighbour_digests", f"WITH {RASTER_SQL}, {RESIDUAL_SQL} SELECT doc_id, {', '.join(f'{DIGEST.format(k)} AS {k}' for k in _SEVEN)} FROM al GROUP BY doc_id")
def neighbour_digests(spark, sf_dir):
    """All seven neighbours of every sample, with the rules at the edges, as one digest each."""
    return _stage(spark, sf_dir, lambda s: (None, *(s.digest(a) for a in (s.neighbours()[k] for k in _SEVEN))), ", ".join(f"{k} long" for k in _SEVEN))


_PLANE = "greatest(least(w, n), least(greatest(w, n), w + n - nw))"
_WIDE = "(6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8)"
_GUESS = dict(
    zip(
        rasters.PREDICTORS,
        ("0", "w", "n", "(w + n) >> 1", "CASE WHEN abs(n - nw) < abs(w - nw) THEN w ELSE n END", _PLANE, _PLANE, "ne", "nw", "ww", "(w + nw) >> 1", "(n + nw) >> 1", "(n + ne) >> 1", f"CAST(sign({_WIDE}) * (abs({_WIDE}) // 16) AS BIGINT)"),
        strict=True,
    )
)
_BEST = "CASE " + " ".join(f"WHEN {n} = least({', '.join(rasters.PREDICTORS)}) THEN '{n}'" for n in rasters.PREDICTORS) + " END"


@query("w01_predictors", f"WITH {RASTER_SQL}, {RESIDUAL_SQL} SELECT doc_id, {', '.join(f'{DIGEST.format(g)} AS {k}' for k, g in _GUESS.items())} FROM al GROUP BY doc_id")
def predictor_digests(spark, sf_dir):
    """The guesses of all fourteen predictors, as one digest each."""
    f = lambda s: (None, *(s.digest(g) for g in rasters.predictions(s.neighbours()).values()))
    return _stage(spark, sf_dir, f, ", ".join(f"{k} long" for k in rasters.PREDICTORS))


@query("w03_predictor_choice", f"WITH {RASTER_SQL}, {RESIDUAL_SQL}, s AS (SELECT doc_id, {', '.join(f'CAST(sum(abs(v - ({g}))) AS BIGINT) AS {k}' for k, g in _GUESS.items())} FROM al GROUP BY doc_id) SELECT *, {_BEST} AS best FROM s")
def predictor_choice(spark, sf_dir):
    """Sum of absolute residuals of every predictor, and the one with the least; of equal ones the first."""

    def f(s):
        sums = [s.total(np.abs(s.v - g)) for g in rasters.predictions(s.neighbours()).values()]
        return None, *sums, np.array(rasters.PREDICTORS, object)[np.argmin(np.stack(sums), 0)].astype(str)

    return _stage(spark, sf_dir, f, ", ".join(f"{k} long" for k in rasters.PREDICTORS) + ", best string")


_TOKEN = "CASE WHEN u < 16 THEN u ELSE 16 + (CAST(floor(log2(u)) AS BIGINT) - 4) * 4 + CAST(floor(u / pow(2, floor(log2(u)) - 2)) AS BIGINT) % 4 END"


@query("m01_token_histogram", f"WITH {RASTER_SQL}, {RESIDUAL_SQL} SELECT doc_id, CAST({_TOKEN} AS BIGINT) AS token, count(*) AS n, CAST(sum(CASE WHEN u < 16 THEN 0 ELSE floor(log2(u)) - 2 END) AS BIGINT) AS raw_bits FROM tok GROUP BY ALL")
def token_histogram(spark, sf_dir):
    """Tokens of the residuals of every document, counted where the text is, with the raw bits that follow them."""

    def f(s):
        of, u, c = s.counts(rasters.zigzag(residuals(s)), 2048)
        token, bits = rasters.hybrid(u)
        key = of * 128 + token
        at, back = np.unique(key, return_inverse=True)
        return at // 128, at % 128, np.bincount(back, c).astype(np.int64), np.bincount(back, c * bits).astype(np.int64)

    return _stage(spark, sf_dir, f, "token long, n long, raw_bits long")


def entropy_sums(s: Slice, of: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct symbols and bits of the ideal code of each raster; 0 bits for a single symbol."""
    n, k = s.size.astype(float), np.bincount(of, minlength=s.n)
    return k, np.where(k == 1, 0.0, n * np.log2(n) - np.bincount(of, c * np.log2(c.astype(float)), s.n))


@query(
    "g03_residual_entropy",
    f"""WITH {RASTER_SQL}, {RESIDUAL_SQL}, h AS (SELECT doc_id, u, count(*) AS c FROM tok GROUP BY ALL),
t AS (SELECT doc_id, sum(c) AS n, count(*) AS k, sum(c * log2(c)) AS s FROM h GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS symbols, CASE WHEN k = 1 THEN 0.0 ELSE round(n * log2(n) - s, 3) END AS bits FROM t""",
)
def residual_entropy(spark, sf_dir):
    """Entropy of the residual symbols of every document; 0 for a single symbol."""

    def f(s):
        of, _, c = s.counts(rasters.zigzag(residuals(s)), 2048)
        return None, s.size, *entropy_sums(s, of, c)

    return _stage(spark, sf_dir, f, "n long, symbols long, bits double").withColumn("bits", F.round("bits", 3))


@query("g19_palette", f"WITH {RASTER_SQL}, d AS (SELECT doc_id, v, count(*) AS n FROM px GROUP BY ALL) SELECT doc_id, v, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY v) - 1 AS INT) AS idx FROM d")
def palette(spark, sf_dir):
    """Distinct samples of a document, in order, with their index."""

    def f(s):
        of, v, c = s.counts(s.v, 256)
        return of, v, c, np.arange(len(of)) - np.searchsorted(of, of)

    return _stage(spark, sf_dir, f, "v int, n long, idx int")


@query("j07_palette_indices", f"WITH {RASTER_SQL}, d AS (SELECT doc_id, p, dense_rank() OVER (PARTITION BY doc_id ORDER BY v) - 1 AS i FROM px) SELECT doc_id, {DIGEST.format('i')} AS digest, CAST(max(i) + 1 AS BIGINT) AS colours FROM d GROUP BY doc_id")
def palette_indices(spark, sf_dir):
    """Every sample as its index in the document's sorted palette."""

    def f(s):
        of, v, _ = s.counts(s.v, 256)
        index = np.zeros(s.n * 256, np.int64)
        index[of * 256 + v] = np.arange(len(of)) - np.searchsorted(of, of)
        return None, s.digest(index[s.row * 256 + s.v]), np.bincount(of, minlength=s.n)

    return _stage(spark, sf_dir, f, "digest long, colours long")


@query("run_lengths", f"WITH {RASTER_SQL}, s AS (SELECT doc_id, CASE WHEN p = 0 OR v <> lag(v) OVER (PARTITION BY doc_id ORDER BY p) THEN 1 ELSE 0 END AS b FROM px) SELECT doc_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS runs FROM s GROUP BY doc_id")
def run_lengths(spark, sf_dir):
    """Runs of equal samples."""
    return _stage(spark, sf_dir, lambda s: (None, s.size, s.total((s.place == 0) | (s.v != s.before(1)))), "n long, runs long")




def squeeze_sql(line: str, at: str) -> str:
    """SQL for a squeeze step along lines of px: line names a line, at the position in it."""
    return f"""l AS (SELECT doc_id, {line} AS line, {at} AS pos, v, lead(v) OVER q AS b, lead(v, 2) OVER q AS c, lead(v, 3) OVER q AS d, lag(v) OVER q AS before FROM px WINDOW q AS (PARTITION BY doc_id, {line} ORDER BY {at})),
m AS (SELECT doc_id, line, pos // 2 AS k, v - b AS diff, (v + b + CASE WHEN v > b THEN 1 ELSE 0 END) >> 1 AS a, c, d, before, v FROM l WHERE pos % 2 = 0),
o AS (SELECT doc_id, line, k, diff, coalesce(a, v) AS a, coalesce((c + d + CASE WHEN c > d THEN 1 ELSE 0 END) >> 1, c, a) AS n, coalesce(before, a) AS b FROM m),
e AS (SELECT *, CAST(trunc((4 * b - 3 * n - a + 6) / 12) AS BIGINT) AS x, CAST(trunc((4 * b - 3 * n - a - 6) / 12) AS BIGINT) AS y FROM o),
g AS (SELECT *, CASE WHEN x - (x & 1) > 2 * (b - a) THEN 2 * (b - a) + 1 ELSE x END AS x1, CASE WHEN y + (y & 1) < 2 * (b - a) THEN 2 * (b - a) - 1 ELSE y END AS y1 FROM e),
t AS (SELECT doc_id, line, k, a, diff - CASE WHEN b >= a AND a >= n THEN CASE WHEN x1 + (x1 & 1) > 2 * (a - n) THEN 2 * (a - n) ELSE x1 END
WHEN b <= a AND a <= n THEN CASE WHEN y1 - (y1 & 1) < 2 * (a - n) THEN 2 * (a - n) ELSE y1 END ELSE 0 END AS r FROM g)
SELECT doc_id, CAST(sum(a * ((line * 16 + k) % 97 + 1)) AS BIGINT) AS averages, CAST(sum(coalesce(r, 0) * ((line * 16 + k) % 97 + 1)) AS BIGINT) AS residuals, CAST(sum(abs(coalesce(r, 0))) AS BIGINT) AS magnitude FROM t GROUP BY doc_id"""


def _squeezed(lines, size, of, number, n):
    """Digests of a squeeze step by raster: averages, residuals and the residuals' magnitude."""
    averages, r = rasters.squeeze(lines, size)
    weight = (number[:, None] * 16 + np.arange(averages.shape[1])) % 97 + 1
    line_sums = (averages * weight).sum(1), (r * weight[:, : r.shape[1]]).sum(1), np.abs(r).sum(1)
    return [rasters.total(x, of, n) for x in line_sums]


@query("w06_row_squeeze", f"WITH {RASTER_SQL}, {squeeze_sql('p // 32', 'p % 32')}")
def row_squeeze(spark, sf_dir):
    """A squeeze step along rows, with tendency: averages and residuals, as digests."""

    def f(s):
        lines, size, of = rasters.row_lines(s)
        return None, *_squeezed(lines, size, of, np.arange(len(of)) - np.searchsorted(of, of), s.n)

    return _stage(spark, sf_dir, f, "averages long, residuals long, magnitude long")


@query("w07_column_squeeze", f"WITH {RASTER_SQL}, {squeeze_sql('p % 32', 'p // 32')}")
def column_squeeze(spark, sf_dir):
    """A squeeze step along columns, with tendency. The columns of rasters of like heights (up to twice the least) are one matrix."""

    def f(s):
        out = np.zeros((3, s.n), np.int64)
        tall = -(-s.size // 32)
        kind = np.frexp(tall.astype(float))[1]
        for k in np.unique(kind[tall > 0]):
            own = np.flatnonzero(kind == k)
            height = int(tall[own].max())
            height += height % 2
            number = np.full(s.n, -1)
            number[own] = np.arange(len(own))
            at = np.flatnonzero(number[s.row] >= 0)
            line = number[s.row[at]] * 32 + s.x[at]
            lines = np.zeros((len(own) * 32, height), np.int64)
            lines[line, s.y[at]] = s.v[at]
            size = np.bincount(line, minlength=len(lines))
            some = np.flatnonzero(size)
            out[:, own] = _squeezed(lines[some], size[some], some // 32, some % 32, len(own))
        return None, *out

    return _stage(spark, sf_dir, f, "averages long, residuals long, magnitude long")




def tendency_sql(b: str, a: str, n: str) -> str:
    """SQL for the expected difference of a pair with average a, after the sample b and before the average n."""
    twelfth = lambda x: f"CAST(trunc(({x}) / 12) AS BIGINT)"
    x, y = twelfth(f"4 * {b} - 3 * {n} - {a} + 6"), twelfth(f"4 * {b} - 3 * {n} - {a} - 6")
    x = f"CASE WHEN {x} - ({x} & 1) > 2 * ({b} - {a}) THEN 2 * ({b} - {a}) + 1 ELSE {x} END"
    y = f"CASE WHEN {y} + ({y} & 1) < 2 * ({b} - {a}) THEN 2 * ({b} - {a}) - 1 ELSE {y} END"
    down = f"CASE WHEN ({x}) + (({x}) & 1) > 2 * ({a} - {n}) THEN 2 * ({a} - {n}) ELSE {x} END"
    up = f"CASE WHEN ({y}) - (({y}) & 1) < 2 * ({a} - {n}) THEN 2 * ({a} - {n}) ELSE {y} END"
    return f"CASE WHEN {b} >= {a} AND {a} >= {n} THEN {down} WHEN {b} <= {a} AND {a} <= {n} THEN {up} ELSE 0 END"


@query(
    "w09_unsqueezed",
    f"""WITH RECURSIVE {RASTER_SQL}, e AS (SELECT doc_id, p // 32 AS y, p % 32 // 2 AS k, max(CASE WHEN p % 2 = 0 THEN v END) AS a, max(CASE WHEN p % 2 = 1 THEN v END) - 128 AS r FROM px GROUP BY ALL),
f AS (SELECT *, CASE WHEN r IS NULL THEN NULL ELSE coalesce(lead(a) OVER (PARTITION BY doc_id, y ORDER BY k), a) END AS n FROM e),
u AS (SELECT doc_id, y, k, a, NULL::BIGINT AS one, NULL::BIGINT AS two, r, n, a AS before FROM f WHERE k = 0
UNION ALL SELECT f.doc_id, f.y, f.k, f.a, NULL, NULL, f.r, f.n, ((2 * g.a + g.dif + CASE WHEN g.dif > 0 THEN -(g.dif & 1) ELSE g.dif & 1 END) >> 1) - g.dif FROM (SELECT *, r + {{tendency}} AS dif FROM u WHERE r IS NOT NULL) g JOIN f ON f.doc_id = g.doc_id AND f.y = g.y AND f.k = g.k + 1),
o AS (SELECT doc_id, y, k, a, r, r + {{tendency}} AS dif FROM u), z AS (SELECT doc_id, y * 32 + 2 * k AS p, CASE WHEN r IS NULL THEN a ELSE (2 * a + dif + CASE WHEN dif > 0 THEN -(dif & 1) ELSE dif & 1 END) >> 1 END AS v FROM o
UNION ALL SELECT doc_id, y * 32 + 2 * k + 1, ((2 * a + dif + CASE WHEN dif > 0 THEN -(dif & 1) ELSE dif & 1 END) >> 1) - dif FROM o WHERE r IS NOT NULL)
SELECT doc_id, {DIGEST.format('v')} AS digest, count(*) AS n FROM z GROUP BY doc_id""".format(tendency=tendency_sql("before", "a", "n")),
)
def unsqueezed(spark, sf_dir):
    """Rows put together from averages and residuals that no squeeze step made: a row's even samples, and its odd ones less 128."""

    def f(s):
        lines, size, _ = rasters.row_lines(s)
        pairs = np.arange(16) < size[:, None] // 2
        averages = np.concatenate([lines[:, 0::2], np.zeros((len(lines), 1), np.int64)], 1)
        back = rasters.unsqueeze(averages, np.where(pairs, lines[:, 1::2] - 128, 0), size)
        return None, s.digest(back[:, :32][np.arange(32) < size[:, None]]), s.size

    return _stage(spark, sf_dir, f, "digest long, n long")


_TRIPLETS = "t AS (SELECT doc_id, p // 3 AS k, max(CASE WHEN p % 3 = 0 THEN v END) AS r, max(CASE WHEN p % 3 = 1 THEN v END) AS g, max(CASE WHEN p % 3 = 2 THEN v END) AS b FROM px GROUP BY doc_id, p // 3)"
_ORDERED = "CASE kind // 7 " + " ".join(f"WHEN {i} THEN [{', '.join('rgb'[k] for k in order)}]" for i, order in enumerate(rasters.PERMUTATIONS)) + " END"


def _channels(s: Slice):
    """Three channels of the raster's whole triplets, and the raster and number of each triplet."""
    n = s.size // 3
    of = np.repeat(np.arange(s.n), n)
    number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = s.start[of] + 3 * number
    return (s.v[at], s.v[at + 1], s.v[at + 2]), of, number


@query(
    "d07_colour_transforms",
    f"""WITH {RASTER_SQL}, {_TRIPLETS}, q AS (SELECT doc_id, k, kind, {_ORDERED} AS c FROM t, (SELECT range AS kind FROM range(42)) WHERE b IS NOT NULL),
a AS (SELECT doc_id, k, kind, kind % 7 AS s, c[1] AS a, c[2] AS b, c[3] AS c FROM q),
z AS (SELECT doc_id, k, kind, CASE WHEN s = 6 THEN (c + ((a - c) >> 1)) + ((b - (c + ((a - c) >> 1))) >> 1) ELSE a END AS x,
CASE WHEN s = 6 THEN a - c WHEN s // 2 = 1 THEN b - a WHEN s // 2 = 2 THEN b - ((a + c) >> 1) ELSE b END AS y,
CASE WHEN s = 6 THEN b - (c + ((a - c) >> 1)) WHEN s % 2 = 1 THEN c - a ELSE c END AS w FROM a)
SELECT doc_id, CAST(kind AS INT) AS kind, CAST(sum(x * (k % 97 + 1)) AS BIGINT) AS first, CAST(sum(y * (k % 97 + 1)) AS BIGINT) AS second, CAST(sum(w * (k % 97 + 1)) AS BIGINT) AS third FROM z GROUP BY doc_id, kind""",
)
def colour_transforms(spark, sf_dir):
    """All 42 reversible colour transforms of a document's sample triplets, as digests of their three channels."""

    def f(s):
        channels, of, number = _channels(s)
        weight, some = number % 97 + 1, np.flatnonzero(s.size >= 3)
        sums = [[rasters.total(x * weight, of, s.n)[some] for x in rasters.colour_forward(channels, kind)] for kind in range(42)]
        return np.tile(some, 42), np.repeat(np.arange(42), len(some)), *(np.concatenate([x[c] for x in sums]) for c in range(3))

    return _stage(spark, sf_dir, f, "kind int, first long, second long, third long")


_PLACES = [[order.index(k) for k in range(3)] for order in rasters.PERMUTATIONS]


@query(
    "d08_colour_inverses",
    f"""WITH {RASTER_SQL}, {_TRIPLETS}, q AS (SELECT doc_id, k, kind, kind % 7 AS s, r AS a, g AS b, b AS c FROM t, (SELECT range AS kind FROM range(42)) WHERE b IS NOT NULL),
c AS (SELECT *, CASE WHEN s = 6 THEN a - (c >> 1) ELSE c + CASE WHEN s % 2 = 1 THEN a ELSE 0 END END AS m FROM q),
i AS (SELECT doc_id, k, kind, CASE WHEN s = 6 THEN [m - (b >> 1) + b, c + m, m - (b >> 1)] ELSE [a, b + CASE s // 2 WHEN 1 THEN a WHEN 2 THEN (a + m) >> 1 ELSE 0 END, m] END AS o FROM c),
z AS (SELECT doc_id, k, kind, CASE kind // 7 {' '.join(f"WHEN {i} THEN [{', '.join(f'o[{k + 1}]' for k in own)}]" for i, own in enumerate(_PLACES))} END AS o FROM i)
SELECT doc_id, CAST(kind AS INT) AS kind, {', '.join(f'CAST(sum(o[{c + 1}] * (k % 97 + 1)) AS BIGINT) AS {name}' for c, name in enumerate('rgb'))} FROM z GROUP BY doc_id, kind""",
)
def colour_inverses(spark, sf_dir):
    """All 42 inverse colour transforms of a document's sample triplets, taken as transformed channels: digests of the three channels they give."""

    def f(s):
        channels, of, number = _channels(s)
        weight, some = number % 97 + 1, np.flatnonzero(s.size >= 3)
        sums = [[rasters.total(x * weight, of, s.n)[some] for x in rasters.colour_inverse(channels, kind)] for kind in range(42)]
        return np.tile(some, 42), np.repeat(np.arange(42), len(some)), *(np.concatenate([x[c] for x in sums]) for c in range(3))

    return _stage(spark, sf_dir, f, "kind int, r long, g long, b long")


@query("d16_quantised_residuals", f"WITH {RASTER_SQL}, {RESIDUAL_SQL}, q AS (SELECT doc_id, sign(r) * ((abs(r) + 2) // 4) * 4 AS q, r FROM res) SELECT doc_id, CAST(sum(CASE WHEN q = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, CAST(sum(abs(q)) AS BIGINT) AS magnitude, CAST(sum(abs(r - q)) AS BIGINT) AS loss FROM q GROUP BY doc_id")
def quantised_residuals(spark, sf_dir):
    """Residuals brought to the nearest multiple of 4, halves away from zero."""

    def f(s):
        r = residuals(s)
        q = np.sign(r) * ((np.abs(r) + 2) >> 2) * 4
        return None, s.total(q == 0), s.total(np.abs(q)), s.total(np.abs(r - q))

    return _stage(spark, sf_dir, f, "zeros long, magnitude long, loss long")


@query("p43_box_downsample", f"WITH {RASTER_SQL}, c AS (SELECT doc_id, p // 64 AS y, (p % 32) // 2 AS x, sum(v) AS s, count(*) AS n FROM px GROUP BY ALL) SELECT doc_id, count(*) AS n, CAST(sum(CAST((s + n // 2) // n AS BIGINT) * ((y * 16 + x) % 97 + 1)) AS BIGINT) AS digest FROM c GROUP BY doc_id")
def box_downsample(spark, sf_dir):
    """Rounded means of 2 by 2 boxes; boxes at the edge have fewer samples."""

    def f(s):
        boxes = -(-s.size // 64) * 16
        of = np.repeat(np.arange(s.n), boxes)
        first = np.cumsum(boxes) - boxes
        at = first[s.row] + s.y // 2 * 16 + s.x // 2
        n, sums = np.bincount(at, minlength=len(of)), np.bincount(at, s.v, len(of)).astype(np.int64)
        mean = (sums + n // 2) // np.maximum(n, 1)
        return None, rasters.total(n > 0, of, s.n), rasters.total(mean * ((np.arange(len(of)) - first[of]) % 97 + 1), of, s.n)

    return _stage(spark, sf_dir, f, "n long, digest long")


# ---------------------------------------------------------------- histograms


def sample_counts(docs, keep=("doc_id",)):
    """Samples of every document, counted where the text is: the columns kept, v and a."""
    return raster_stage(docs, lambda s: s.counts(s.v, 256), "v int, a long", keep)


def _xlog(x):
    return x * F.log2(x.cast("double"))


@query(
    "g05_histogram_distance",
    f"""WITH {RASTER_SQL}, a AS (SELECT doc_id, lang, v, count(*) AS a FROM px JOIN documents USING (doc_id) GROUP BY ALL), b AS (SELECT lang, v, CAST(sum(a) AS BIGINT) AS b FROM a GROUP BY ALL),
d AS (SELECT DISTINCT doc_id, lang FROM a), j AS (SELECT doc_id, coalesce(a, 0) AS a, b FROM d JOIN b USING (lang) LEFT JOIN a USING (doc_id, lang, v)),
s AS (SELECT doc_id, sum(a) AS na, sum(b) AS nb, sum((a + b) * log2(a + b)) AS sab, sum(CASE WHEN a > 0 THEN a * log2(a) ELSE 0 END) AS sa, sum(b * log2(b)) AS sb FROM j GROUP BY doc_id)
SELECT doc_id, round((na + nb) * log2(na + nb) - sab - (na * log2(na) - sa) - (nb * log2(nb) - sb), 2) AS distance FROM s""",
)
def histogram_distance(spark, sf_dir):
    """Bits that one code for a document's and its language's samples costs over two codes. The language has all symbols of
    the document, so only the document's symbols are joined."""
    a = sample_counts(table(spark, sf_dir, "documents"), ("doc_id", "lang"))
    b = a.groupBy("lang", "v").agg(F.sum("a").alias("b"))
    b = b.withColumn("nb", F.sum("b").over(Window.partitionBy("lang")))
    ca, cb = F.col("a"), F.col("b")
    s = a.join(b, ["lang", "v"]).groupBy("doc_id").agg(F.sum("a").alias("na"), F.max("nb").alias("nb"), F.sum(_xlog(ca + cb) - _xlog(cb) - _xlog(ca)).alias("s"))
    na, nb = F.col("na"), F.col("nb")
    return s.select("doc_id", F.round(_xlog(na + nb) - _xlog(na) - _xlog(nb) - F.col("s"), 2).alias("distance"))


@query(
    "g06_cross_entropy",
    f"""WITH {RASTER_SQL}, a AS (SELECT doc_id, v, count(*) AS a FROM px GROUP BY ALL),
b AS (SELECT v, count(*) AS b FROM (SELECT unnest(list_transform(string_split(text, ''), lambda x: ascii(x) % 256)) AS v FROM benchmark WHERE length(text) > 0) GROUP BY v)
SELECT doc_id, CASE WHEN count(*) > count(b) THEN 'Infinity'::DOUBLE ELSE round(sum(a) * log2((SELECT sum(b) FROM b)) - sum(a * log2(b)), 3) END AS bits FROM a LEFT JOIN b USING (v) GROUP BY doc_id""",
)
def cross_entropy(spark, sf_dir):
    """Bits of a document under the code of the benchmark's samples; infinite if that lacks a symbol."""
    a = sample_counts(table(spark, sf_dir, "documents"))
    b = sample_counts(table(spark, sf_dir, "benchmark"), ("item_id",)).groupBy("v").agg(F.sum("a").alias("b"))
    b = b.withColumn("nb", F.sum("b").over(Window.partitionBy(F.lit(0))))  # at most 256 rows
    bits = F.sum("a") * F.log2(F.max("nb").cast("double")) - F.sum(F.col("a") * F.log2(F.col("b").cast("double")))
    t = a.join(F.broadcast(b), "v", "left").groupBy("doc_id").agg(F.round(bits, 3).alias("bits"), (F.count("*") > F.count("b")).alias("lacks"))
    return t.select("doc_id", F.when(F.col("lacks"), F.lit(float("inf"))).otherwise(F.col("bits")).alias("bits"))


@query(
    "g20_channel_range",
    f"""WITH {RASTER_SQL}, s AS (SELECT doc_id, count(*) AS n, min(v) AS lo, max(v) AS hi, count(DISTINCT v) AS colours FROM px GROUP BY doc_id)
SELECT doc_id, n, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, colours, colours * 16 <= n AND colours * 5 <= 4 * (hi - lo + 1) AS compact FROM s""",
)
def channel_range(spark, sf_dir):
    """Range and distinct samples of a document, and whether a palette for them pays."""

    def f(s):
        of, v, _ = s.counts(s.v, 256)
        first, last = np.searchsorted(of, np.arange(s.n)), np.searchsorted(of, np.arange(s.n), "right") - 1
        colours = last - first + 1
        return None, s.size, v[first], v[last], colours, (colours * 16 <= s.size) & (colours * 5 <= 4 * (v[last] - v[first] + 1))

    return _stage(spark, sf_dir, f, "n long, lo int, hi int, colours long, compact boolean")


@query(
    "g29_equal_mass",
    f"""WITH {RASTER_SQL}, h AS (SELECT v, count(*) AS c FROM px GROUP BY v), w AS (SELECT v, c, sum(c) OVER (ORDER BY v) AS upto, sum(c) OVER () AS total FROM h)
SELECT CAST(v AS INT) AS v, CAST(upto * 16 // total AS BIGINT) AS chunk FROM w WHERE upto * 16 // total > (upto - c) * 16 // total AND upto < total""",
)
def equal_mass(spark, sf_dir):
    """Thresholds that cut all samples into sixteen parts of about equal mass, from their histogram of at most 256 rows."""
    h = sample_counts(table(spark, sf_dir, "documents")).groupBy("v").agg(F.sum("a").alias("c"))
    one = Window.partitionBy(F.lit(0))
    h = h.withColumns({"upto": F.sum("c").over(one.orderBy("v")), "total": F.sum("c").over(one)})
    return h.filter("upto * 16 div total > (upto - c) * 16 div total AND upto < total").select("v", F.expr("upto * 16 div total").alias("chunk"))


# ---------------------------------------------------------------- vectors as blocks


@query("g15_quantised_psnr", "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, label, CAST(sum(CASE WHEN round(x * 16) <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS nonzeros, CAST(sum(abs(round(x * 16))) AS BIGINT) AS magnitude, round(CASE WHEN sum((x - round(x * 16) / 16) ** 2) = 0 THEN 100 ELSE 10 * log10(1 / avg((x - round(x * 16) / 16) ** 2)) END, 5) AS psnr FROM e GROUP BY ALL")
def quantised_nonzeros(spark, sf_dir):
    """Quantise every coefficient to sixteenths: non-zero ones, their magnitude, and the quality that is left (100 if exact)."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    q = F.round(F.col("x") * 16)
    error = F.pow(F.col("x") - q / 16, 2)
    t = x.groupBy("vec_id", "label").agg(F.sum((q != 0).cast("long")).alias("nonzeros"), F.sum(F.abs(q)).cast("long").alias("magnitude"), F.avg(error).alias("mse"))
    return t.select("vec_id", "label", "nonzeros", "magnitude", F.round(F.when(F.col("mse") == 0, 100.0).otherwise(10 * F.log10(1 / F.col("mse"))), 5).alias("psnr"))


_TUPLES_SQL = "u AS (SELECT doc_id, k, r * 65536 + g * 256 + b AS c FROM t WHERE b IS NOT NULL)"
#: Colours of a palette at most; a raster with more has none.
MOST_COLOURS = 1024


@query(
    "g19_colour_palette",
    f"""WITH {RASTER_SQL}, {_TRIPLETS}, {_TUPLES_SQL}, d AS (SELECT doc_id, k, dense_rank() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS i, c FROM u),
s AS (SELECT doc_id, count(*) AS pixels, max(i) + 1 AS colours, sum(i * (k % 97 + 1)) AS digest, sum(DISTINCT c) AS total FROM d GROUP BY doc_id)
SELECT doc_id, pixels, colours, colours <= {MOST_COLOURS} AS fits, CASE WHEN colours <= {MOST_COLOURS} THEN CAST(digest AS BIGINT) END AS digest, CAST(total AS BIGINT) AS colour_sum FROM s""",
)
def colour_palette(spark, sf_dir):
    """Palettes of whole colours (three samples): distinct ones in order, whether they are few enough, and every pixel as its place among them."""

    def f(s):
        (r, g, b), of, number = _channels(s)
        colour = r * 65536 + g * 256 + b
        key, back = np.unique(of * (1 << 24) + colour, return_inverse=True)
        owner = key >> 24
        index = (np.arange(len(key)) - np.searchsorted(owner, owner))[back]
        some = np.flatnonzero(s.size >= 3)
        colours = np.bincount(owner, minlength=s.n)[some]
        digest = rasters.total(index * (number % 97 + 1), of, s.n)[some]
        return some, np.bincount(of, minlength=s.n)[some], colours, colours <= MOST_COLOURS, digest, rasters.total(key & 0xFFFFFF, owner, s.n)[some]

    out = _stage(spark, sf_dir, f, "pixels long, colours long, fits boolean, digest long, colour_sum long")
    return out.withColumn("digest", F.when(F.col("fits"), F.col("digest")))


_QUANT = "least(255, CAST(floor({0} / 8.0 + 0.5) AS BIGINT) * 8)"
_LUMA = "(0.2126::DOUBLE * {r} + 0.7152::DOUBLE * {g} + 0.0722::DOUBLE * {b})"


@query(
    "g15_colour_psnr",
    f"""WITH {RASTER_SQL}, {_TRIPLETS}, q AS (SELECT doc_id, r, g, b, {', '.join(f'{_QUANT.format(c)} AS q{c}' for c in 'rgb')} FROM t WHERE b IS NOT NULL),
e AS (SELECT doc_id, count(*) AS n, {', '.join(f'avg(({c} - q{c}) * ({c} - q{c})) AS m{c}' for c in 'rgb')}, avg(power({_LUMA.format(r='r', g='g', b='b')} - {_LUMA.format(r='qr', g='qg', b='qb')}, 2)) AS luma FROM q GROUP BY doc_id)
SELECT doc_id, n AS pixels, round(CASE WHEN mr + mg + mb = 0 THEN 99 ELSE least(99, 10 * log10(65025.0 * 3 / (mr + mg + mb))) END, 6) AS rgb, round(CASE WHEN luma < 1e-12 THEN 99 ELSE least(99, 10 * log10(65025.0 / luma)) END, 6) AS luma FROM e""",
)
def colour_psnr(spark, sf_dir):
    """Peak signal to noise, over three channels and over luma, of colours brought to multiples of 8; 99 at most."""

    def f(s):
        channels, of, _ = _channels(s)
        some = np.flatnonzero(s.size >= 3)
        n = np.bincount(of, minlength=s.n)[some]
        error = [x - np.minimum(255, np.floor(x / 8.0 + 0.5).astype(np.int64) * 8) for x in channels]
        mean = sum(rasters.total(e * e, of, s.n)[some] / n for e in error) / 3
        luma = np.bincount(of, (0.2126 * error[0] + 0.7152 * error[1] + 0.0722 * error[2]) ** 2, s.n)[some] / n
        db = lambda m: np.where(m < 1e-12, 99.0, np.minimum(99.0, 10 * np.log10(65025.0 / np.maximum(m, 1e-300))))
        return some, n, db(mean), db(luma)

    return _stage(spark, sf_dir, f, "pixels long, rgb double, luma double").withColumns({c: F.round(c, 6) for c in ("rgb", "luma")})


FACTORS = (2, 4, 8)


@query(
    "p43_box_factors",
    f"""WITH {RASTER_SQL}, c AS (SELECT doc_id, f, p // 32 // f AS y, p % 32 // f AS x, sum(v) AS s, count(*) AS n FROM px, (SELECT unnest({list(FACTORS)}) AS f) GROUP BY ALL)
SELECT doc_id, CAST(f AS INT) AS factor, count(*) AS n, CAST(sum(CAST((s + n // 2) // n AS BIGINT) * ((y * (32 // f) + x) % 97 + 1)) AS BIGINT) AS digest FROM c GROUP BY doc_id, f""",
)
def box_factors(spark, sf_dir):
    """Rounded means of boxes of three sizes; boxes at the edge have fewer samples."""

    def f(s):
        rows = []
        for factor in FACTORS:
            wide = 32 // factor
            boxes = -(-(-(-s.size // 32)) // factor) * wide
            first = np.cumsum(boxes) - boxes
            at = first[s.row] + s.y // factor * wide + s.x // factor
            total, n = (np.bincount(at, w, int(boxes.sum())).astype(np.int64) for w in (s.v, None))
            of = np.repeat(np.arange(s.n), boxes)
            place = np.arange(len(of)) - first[of]
            mean = np.where(n > 0, (total + n // 2) // np.maximum(n, 1), 0)
            rows.append((np.arange(s.n), np.full(s.n, factor), rasters.total(n > 0, of, s.n), rasters.total(mean * (place % 97 + 1), of, s.n)))
        return tuple(np.concatenate(c) for c in zip(*rows, strict=True))

    return _stage(spark, sf_dir, f, "factor int, n long, digest long")
