"""Operators on blocks of 8 by 8 samples, one row each (vectors of 64). Neighbours are read within the block's array;
nothing but sums over all blocks is shuffled."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registered import query
from ..sources.tables import table

BLOCK_SQL = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS p FROM embeddings WHERE len(embedding) = 64)"

#: SQL for the nine neighbours of each sample, the edge repeated.
AROUND_SQL = """around AS (SELECT a.vec_id, a.p, a.x, b.x AS y, (2 - abs(dy)) * (2 - abs(dx)) / 16.0::DOUBLE AS w FROM e a, (SELECT unnest([-1, 0, 1]) AS dy) v, (SELECT unnest([-1, 0, 1]) AS dx) h
JOIN e b ON b.vec_id = a.vec_id AND b.p = least(greatest(a.p // 8 + dy, 0), 7) * 8 + least(greatest(a.p % 8 + dx, 0), 7))"""


def _blocks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def block_stage(spark, sf_dir, f, name: str):
    """f over batches of blocks (an array of n by 8 by 8): n by k values, as rows vec_id, k, `name` rounded to 6 digits. Arrow
    hands over whole batches, so that a block costs no call."""

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8)
            out = f(x).reshape(len(x), -1)
            k = np.tile(np.arange(out.shape[1], dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), out.shape[1]))), pa.array(k), pa.array(out.ravel())], names=["vec_id", "k", name])

    whole = _blocks(spark, sf_dir).filter(F.forall("x", lambda v: v.isNotNull())).select("vec_id", "x")
    return whole.mapInArrow(run, f"vec_id long, k int, {name} double").withColumn(name, F.round(name, 6) + 0.0)


def _around(i):
    """The nine samples around sample i of x, row by row, the edge repeated."""
    inside = lambda k: F.least(F.greatest(k, F.lit(0)), F.lit(7))
    return [F.get("x", inside(F.floor(i / 8).cast("int") + dy) * 8 + inside(i % 8 + dx)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _sum(array, f=lambda x: x):
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + f(x))


@query("g11_block_norm", f"WITH {BLOCK_SQL} SELECT vec_id, round(pow(avg(pow(least(greatest(x * 300, 0), 100), 16)), 0.0625), 5) AS norm FROM e GROUP BY vec_id")
def block_norm(spark, sf_dir):
    """The 16-norm of a block's distances, each kept between 0 and 100."""
    return _blocks(spark, sf_dir).select("vec_id", F.round(F.pow(_sum("x", lambda x: F.pow(F.least(F.greatest(x * 300, F.lit(0.0)), F.lit(100.0)), F.lit(16.0))) / 64, F.lit(0.0625)), 5).alias("norm"))


@query(
    "g23_chroma_slope",
    f"""WITH {BLOCK_SQL}, s AS (SELECT a.vec_id, sum(a.x * b.x) AS ab, sum(a.x * a.x) AS aa FROM e a JOIN e b ON a.vec_id = b.vec_id AND b.p = a.p + 32 GROUP BY a.vec_id)
SELECT vec_id, CASE WHEN aa = 0 THEN 0 ELSE CAST(least(greatest(round(84 * ab / aa), -128), 127) AS INT) END AS slope FROM s""",
)
def chroma_slope(spark, sf_dir):
    """Least-squares slope through the origin of a block's second half on its first, in 84ths, as a signed byte."""
    half = lambda f: _sum(F.transform(F.slice("x", 1, 32), f))
    s = _blocks(spark, sf_dir).select("vec_id", half(lambda x, i: x * F.get("x", i + 32)).alias("ab"), half(lambda x, i: x * x).alias("aa"))
    slope = F.least(F.greatest(F.round(84 * F.col("ab") / F.col("aa")), F.lit(-128)), F.lit(127)).cast("int")
    return s.select("vec_id", F.when(F.col("aa") == 0, 0).otherwise(slope).alias("slope"))


@query("l07_pyramid_energy", f"WITH {BLOCK_SQL}, {AROUND_SQL}, b AS (SELECT vec_id, p, x, sum(y * w) AS y FROM around GROUP BY ALL) SELECT vec_id, round(sum(y * y), 6) AS base, round(sum((x - y) * (x - y)), 6) AS detail FROM b GROUP BY vec_id")
def pyramid_energy(spark, sf_dir):
    """Energy of a block after a 3 by 3 blur, and of the detail that the blur takes away."""
    weights = [(2 - abs(dy)) * (2 - abs(dx)) / 16 for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    blur = F.transform("x", lambda x, i: sum((a * w for a, w in zip(_around(i), weights, strict=True)), F.lit(0.0)))
    b = _blocks(spark, sf_dir).select("vec_id", "x", blur.alias("y"))
    detail = F.zip_with("x", "y", lambda x, y: (x - y) * (x - y))
    return b.select("vec_id", F.round(_sum("y", lambda y: y * y), 6).alias("base"), F.round(_sum(detail), 6).alias("detail"))


# Weights of the four smallest of nine samples, what a distance below 2 adds to them, and what they sum to.
EROSION_BASE, EROSION_ADD, EROSION_TOTAL = (0.125, 0.1, 0.09, 0.06), (0.0, -0.1, -0.09, -0.06), 0.29959705784054957


def erosion_weights(distance: float) -> list[float]:
    near = (2.0 - distance) * 0.5 if distance < 2 else 0.0
    own = [b + near * a for b, a in zip(EROSION_BASE, EROSION_ADD, strict=True)]
    return [w * EROSION_TOTAL / sum(own) for w in own]


_WEIGHTS = erosion_weights(1.0)


@query(
    "w15_fuzzy_erosion",
    f"""WITH {BLOCK_SQL}, {AROUND_SQL}, s AS (SELECT vec_id, p, list_sort(list(y)) AS l FROM around GROUP BY ALL),
c AS (SELECT vec_id, p // 16 * 4 + p % 8 // 2 AS k, sum({' + '.join(f'l[{i + 1}] * {w!r}::DOUBLE' for i, w in enumerate(_WEIGHTS))}) AS v FROM s GROUP BY ALL) SELECT vec_id, CAST(k AS INT) AS k, round(v, 6) AS v FROM c""",
)
def erosion(spark, sf_dir):
    """The four smallest of the nine samples around each sample, weighted for a distance of 1, and summed over 2 by 2 samples."""

    def f(x):
        wide = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="edge")
        nine = np.stack([wide[:, dy : dy + 8, dx : dx + 8] for dy in range(3) for dx in range(3)], -1)
        smallest = (np.sort(nine, -1)[..., :4] * _WEIGHTS).sum(-1)
        return smallest.reshape(-1, 4, 2, 4, 2).sum((2, 4))

    return block_stage(spark, sf_dir, f, "v")


@query(
    "g16_plane_stats",
    f"""WITH {BLOCK_SQL}, d AS (SELECT vec_id, p, x, lag(x, 1) OVER w AS l, lag(x, 8) OVER w AS u FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY p))
SELECT vec_id, max(abs(x)) AS peak, max(CASE WHEN p % 8 > 0 THEN abs(x - l) END) AS across, max(abs(x - u)) AS down FROM d GROUP BY vec_id""",
)
def plane_stats(spark, sf_dir):
    """Largest sample of a block and its largest steps to the left and upper neighbours."""
    most = lambda f: F.array_max(F.transform("x", f))
    across = most(lambda x, i: F.when(i % 8 > 0, F.abs(x - F.get("x", i - 1))))
    down = most(lambda x, i: F.when(i >= 8, F.abs(x - F.get("x", i - 8))))
    return _blocks(spark, sf_dir).select("vec_id", most(lambda x, i: F.abs(x)).alias("peak"), across.alias("across"), down.alias("down"))


@query(
    "v03_block_cosines",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS p FROM embeddings),
k AS (SELECT range AS k FROM range(8)),
rows AS (SELECT vec_id, p // 8 AS y, k, sum(x * cos(pi() * (2 * (p % 8) + 1) * k / 16)) AS s FROM e, k GROUP BY ALL),
cols AS (SELECT vec_id, r.k AS u, k.k AS w, sum(s * cos(pi() * (2 * y + 1) * k.k / 16)) AS s FROM rows r, k GROUP BY ALL)
SELECT vec_id, CAST(w * 8 + u AS INT) AS k, round(s * (CASE WHEN u = 0 THEN sqrt(0.125) ELSE 0.5 END) * (CASE WHEN w = 0 THEN sqrt(0.125) ELSE 0.5 END), 6) + 0.0 AS c FROM cols""",
)
def block_transform(spark, sf_dir):
    """8 by 8 cosine transform of every vector of 64, by rows and columns."""
    basis = np.array([[math.cos(math.pi * (2 * x + 1) * k / 16) * (math.sqrt(0.125) if k == 0 else 0.5) for x in range(8)] for k in range(8)])
    return block_stage(spark, sf_dir, lambda x: basis @ x @ basis.T, "c")


def _zeros(spark, sf_dir):
    x = _blocks(spark, sf_dir).select("label", F.posexplode("x").alias("p", "x"))
    return x.groupBy("label", "p").agg(F.count("*").alias("n"), F.count_if(F.round(F.col("x") * 8) == 0).alias("zeros"))


@query("g09_zero_counts", f"WITH {BLOCK_SQL} SELECT label, CAST(p AS INT) AS p, count(*) AS n, count(*) FILTER (round(x * 8) = 0) AS zeros FROM e GROUP BY ALL")
def zero_counts(spark, sf_dir):
    """How often each position of the blocks of a class quantises to zero."""
    return _zeros(spark, sf_dir).select("label", "p", "n", "zeros")


@query("t04_scan_order", f"WITH {BLOCK_SQL}, z AS (SELECT label, p, count(*) FILTER (round(x * 8) = 0) AS zeros FROM e GROUP BY ALL) SELECT label, CAST(p AS INT) AS p, zeros, CAST(row_number() OVER (PARTITION BY label ORDER BY zeros, p) - 1 AS INT) AS place FROM z")
def scan_order(spark, sf_dir):
    """Positions of each class, those that are seldom zero first; equal ones in their natural order."""
    w = Window.partitionBy("label").orderBy("zeros", "p")
    return _zeros(spark, sf_dir).select("label", "p", "zeros", (F.row_number().over(w) - 1).alias("place"))
