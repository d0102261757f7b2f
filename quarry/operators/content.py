"""Features of the content of colour rasters (three samples a pixel, 32 pixels a row), and the class they tell. Each raster in the task that reads its text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import planes
from ..functions.rasters import Slice, raster_stage
from ..registered import query
from ..sources.tables import WIDTH, table

#: Range of a channel up to which a block is flat; gradient above which a pixel is an edge; bounds above which a raster is a screen.
FLAT, EDGE, SCREEN_MASK, SCREEN_FLAT = 4, 30, 5000.0, 0.5

COLUMNS = ("m3_colourfulness", "flat_blocks", "edge_density", "luma_var", "mask_p25", "mask_median", "mask_p75", "luma_mean", "n_pixels", "aspect", "bpp_source", "byte_entropy")


def colour_planes(s: Slice):
    """Rasters and their pixels (rasters by rows by columns by channels), a height at a time; the last row is filled up with its last pixel."""
    pixels = s.size // 3
    rows = -(-pixels // WIDTH)
    for height in np.unique(rows[rows > 0]):
        own = np.flatnonzero(rows == height)
        step = max(1, planes.MOST // (int(height) * WIDTH))
        for i in range(0, len(own), step):
            some = own[i : i + step]
            place = 3 * np.minimum(np.arange(height * WIDTH), pixels[some][:, None] - 1)
            yield some, np.stack([s.v[s.start[some][:, None] + place + c] for c in range(3)], 2).reshape(len(some), height, WIDTH, 3)


def _blocks(x: np.ndarray) -> np.ndarray:
    """Whole blocks of 8 by 8: rasters by blocks by 64."""
    n, h, w = x.shape
    return x[:, : h // 8 * 8].reshape(n, h // 8, 8, w // 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, -1, 64)


def features(p: np.ndarray) -> list[np.ndarray]:
    """COLUMNS of each colour plane. Without a whole block the shares and masks of blocks are 0; an edge needs inner pixels."""
    n, h, w, _ = p.shape
    r, g, b = (p[..., c].astype(float) for c in range(3))
    flat = lambda x: x.reshape(n, -1)
    rg, yb = flat(r - g), flat(0.5 * (r + g) - b)
    m3 = np.sqrt(rg.var(1) + yb.var(1)) + 0.3 * np.sqrt(rg.mean(1) ** 2 + yb.mean(1) ** 2)
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    whole = np.floor(luma + 0.5)
    ranges = np.stack([_blocks(p[..., c]).max(2, initial=0) - _blocks(p[..., c]).min(2, initial=255) for c in range(3)])
    some = h // 8 > 0
    flat_blocks = (ranges <= FLAT).all(0).mean(1) if some else np.zeros(n)
    _, _, length = planes.gradients(whole)
    edges = (length[:, 1:-1, 1:-1] > EDGE).mean((1, 2)) if h > 2 else np.zeros(n)
    at = planes.around(whole)
    mask = 100.0 / (np.log(1 + np.abs(whole - 0.25 * (at(-1, 0) + at(1, 0) + at(0, -1) + at(0, 1)))) + 0.01)
    if some:
        means = np.sort(_blocks(mask).mean(2), 1)
        masks = [means[:, int(np.floor(q * (means.shape[1] - 1) + 0.5))] for q in (0.25, 0.5, 0.75)]
    else:
        masks = [np.zeros(n)] * 3
    counts = np.bincount((np.arange(n)[:, None] * 256 + p.reshape(n, -1)).ravel(), minlength=n * 256).reshape(n, 256) / (h * w * 3)
    entropy = -np.where(counts > 0, counts * np.log2(np.maximum(counts, 1e-300)), 0.0).sum(1)
    fill = lambda x: np.full(n, float(x))
    return [m3, flat_blocks, edges, flat(luma).var(1), *masks, flat(luma).mean(1), fill(h * w), fill(w / h), fill(3), entropy]


def _near(dy: int, dx: int) -> str:
    return f"y[1 + greatest(0, least(h - 1, i // 32 + {dy})) * 32 + greatest(0, least(31, i % 32 + {dx}))]"


_GX = f"({_near(-1, 1)} + 2 * {_near(0, 1)} + {_near(1, 1)}) - ({_near(-1, -1)} + 2 * {_near(0, -1)} + {_near(1, -1)})"
_GY = f"({_near(1, -1)} + 2 * {_near(1, 0)} + {_near(1, 1)}) - ({_near(-1, -1)} + 2 * {_near(-1, 0)} + {_near(-1, 1)})"
_L = "0.299::DOUBLE * r[1 + i] + 0.587::DOUBLE * g[1 + i] + 0.114::DOUBLE * b[1 + i]"
_PICK = "m[1 + CAST(floor({q}::DOUBLE * (len(m) - 1) + 0.5) AS BIGINT)]"
FEATURE_SQL = f"""tx AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: ascii(x) % 256) AS c FROM documents WHERE length(text) > 2),
ch AS (SELECT doc_id, len(c) // 3 AS n, (len(c) // 3 + 31) // 32 AS h, {', '.join(f"list_transform(range((len(c) // 3 + 31) // 32 * 32), lambda i: c[1 + 3 * least(i, len(c) // 3 - 1) + {k}]) AS {x}" for k, x in enumerate('rgb'))} FROM tx),
lm AS (SELECT *, list_transform(range(h * 32), lambda i: {_L}) AS l, list_transform(range(h * 32), lambda i: floor({_L} + 0.5)) AS y FROM ch),
nb AS (SELECT *, list_transform(range(h * 32), lambda i: 100.0::DOUBLE / (ln(1 + abs(y[1 + i] - 0.25::DOUBLE * ({_near(-1, 0)} + {_near(1, 0)} + {_near(0, -1)} + {_near(0, 1)}))) + 0.01::DOUBLE)) AS k,
list_transform(range(h * 32), lambda i: CASE WHEN i // 32 BETWEEN 1 AND h - 2 AND i % 32 BETWEEN 1 AND 30 THEN CAST(sqrt(({_GX}) ** 2 + ({_GY}) ** 2) > {EDGE} AS INT) END) AS e FROM lm),
un AS (SELECT doc_id, h, unnest(range(h * 32)) AS i, unnest(r) AS r, unnest(g) AS g, unnest(b) AS b, unnest(l) AS l, unnest(k) AS k, unnest(e) AS e FROM nb),
st AS (SELECT doc_id, h, sqrt(var_pop(r - g) + var_pop(0.5::DOUBLE * (r + g) - b)) + 0.3::DOUBLE * sqrt(avg(r - g) ** 2 + avg(0.5::DOUBLE * (r + g) - b) ** 2) AS m3, coalesce(avg(e), 0) AS edges, var_pop(l) AS lv, avg(l) AS la FROM un GROUP BY doc_id, h),
bl AS (SELECT doc_id, avg(k) AS m, greatest(max(r) - min(r), max(g) - min(g), max(b) - min(b)) <= {FLAT} AS flat FROM un WHERE i // 256 < h // 8 GROUP BY doc_id, i // 256, i % 32 // 8),
bs AS (SELECT doc_id, avg(CAST(flat AS INT)) AS flat, list(m ORDER BY m) AS m FROM bl GROUP BY doc_id),
hs AS (SELECT doc_id, v, count(*) AS c FROM (SELECT doc_id, unnest([r, g, b]) AS v FROM un) GROUP BY ALL), en AS (SELECT doc_id, -sum(c / t * log2(c / t)) AS e FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS t FROM hs) GROUP BY doc_id),
ft AS (SELECT doc_id, round(m3, 6) AS m3_colourfulness, round(coalesce(flat, 0), 6) AS flat_blocks, round(edges, 6) AS edge_density, round(lv, 6) AS luma_var, {', '.join(f"round(coalesce({_PICK.format(q=q)}, 0), 6) AS {x}" for q, x in ((0.25, 'mask_p25'), (0.5, 'mask_median'), (0.75, 'mask_p75')))},
round(la, 9) AS luma_mean, CAST(h * 32 AS DOUBLE) AS n_pixels, round(32.0::DOUBLE / h, 6) AS aspect, 3.0::DOUBLE AS bpp_source, round(e, 6) AS byte_entropy FROM st LEFT JOIN bs USING (doc_id) JOIN en USING (doc_id))"""


@query("g13_content_features", f"WITH {FEATURE_SQL} SELECT *, CASE WHEN mask_median > {SCREEN_MASK} AND flat_blocks > {SCREEN_FLAT} THEN 'screen' ELSE 'photo' END AS class FROM ft")
def content_features(spark, sf_dir):
    """Twelve features of every colour raster: colourfulness, flat blocks, edges, luma's mean and variance, masking of its blocks, size, shape and entropy; and
    whether it looks like a screen."""

    def f(s):
        made = [(own, *features(p)) for own, p in colour_planes(s)]
        if not made:
            return np.empty(0, np.int64), *[np.empty(0)] * len(COLUMNS)
        return tuple(np.concatenate(c) for c in zip(*made, strict=True))

    out = raster_stage(table(spark, sf_dir, "documents"), f, ", ".join(f"{c} double" for c in COLUMNS)).withColumns({c: F.round(c, 9 if c == "luma_mean" else 6) for c in COLUMNS})
    return out.withColumn("class", F.when((F.col("mask_median") > SCREEN_MASK) & (F.col("flat_blocks") > SCREEN_FLAT), "screen").otherwise("photo"))


@query(
    "f04_screen_share",
    f"""WITH {FEATURE_SQL}, k AS (SELECT doc_id, mask_median > {SCREEN_MASK} AND flat_blocks > {SCREEN_FLAT} AS screen, edge_density FROM ft)
SELECT coalesce(source, '') AS source, count(*) AS n, count(*) FILTER (screen) AS screens, round(avg(edge_density), 9) AS edges FROM k JOIN documents USING (doc_id) GROUP BY ALL""",
)
def screen_share(spark, sf_dir):
    """How many rasters of each source look like screens, and their mean share of edges."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    k = content_features(spark, sf_dir).select("doc_id", "class", "edge_density")
    return k.join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("class") == "screen").alias("screens"), F.round(F.avg("edge_density"), 9).alias("edges"))
