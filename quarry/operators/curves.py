"""Curves, searches, rank measures, fronts, medoids and marker lines of experiment cells. A group is one image's cells, whose number the
experiment's design bounds; what runs over all cells is summed up in the tasks that read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curves
from ..registered import query
from ..sources.tables import CELLS_SQL, cells, table

_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def by_image(t: DataFrame, f, fields: str) -> DataFrame:
    """f over each image's rows (columns by name, as arrays): rows of `fields`."""
    kinds = [_KINDS[x.split()[1]] for x in fields.split(", ")]
    names = [x.split()[0] for x in fields.split(", ")]

    def run(key, own):
        rows = f({c: own.column(c).to_numpy(zero_copy_only=False) for c in own.column_names})
        columns = [[key[0].as_py()] * len(rows), *zip(*rows, strict=True)] if rows else [[]] * (len(names) + 1)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *kinds), strict=True)], names=["image", *names])

    return t.groupBy("image").applyInArrow(run, f"image long, {fields}")


TARGETS = tuple(range(40, 95, 5))


def quality_curves(spark, sf_dir) -> DataFrame:
    """Mean score (0 to 100) of each image at each setting, with its cells."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image"), F.col("l_quantity").cast("double").alias("q"), (100 - 1000 * F.col("l_discount").cast("double")).alias("s"))
    return t.dropna().groupBy("image", "q").agg(F.avg("s").alias("s"), F.count("*").alias("n"))


def _searches(own: dict) -> list[tuple]:
    order = np.argsort(own["q"])
    q, n = own["q"][order], own["n"][order].astype(float)
    if len(q) < 4:
        return []
    s = curves.risen(own["s"][order], n)
    out = []
    for t in TARGETS:
        at, score, reached, steps = curves.search(q, s, t, curves.first_guess(t))
        exact = curves.setting_for(q, s, t)
        out.append((t, None if exact is None else round(exact, 6), at, round(score, 6), reached, steps))
    return out


@query("l12_searches")
def searches(spark, sf_dir):
    """For each image with four settings or more and each target: the setting that its risen curve has for it, and what a search of a few
    steps comes to."""
    return by_image(quality_curves(spark, sf_dir), _searches, "target int, exact double, setting double, score double, reached boolean, steps int")


#: Rounds of the reweighted fit, its ridge, and the least error that weighs.
ROUNDS, RIDGE, LEAST_ERROR = 30, 1e-3, 1e-2
_KNOTS = (50, 60, 70, 80)


def l1_fit(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """Coefficients that make the sum of absolute errors of y least, weighted by w: least squares again and again, each row by its weight over its last error.
    A round is one pass that adds up the products of the columns."""
    p = len(columns)
    beta = np.zeros(p)
    for k in range(ROUNDS):

        def run(batches, k=k, beta=beta):
            total = np.zeros((p + 1, p + 1))
            for batch in batches:
                x = np.stack([batch.column(c).to_numpy() for c in (*columns, "y")])
                w = batch.column("w").to_numpy()
                if k:
                    w = w / np.maximum(np.abs(x[-1] - beta @ x[:-1]), LEAST_ERROR)
                total += (x * w) @ x.T
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

        g = np.zeros((p + 1, p + 1))
        for r in rows.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # columns by columns
            g[r["i"], r["j"]] = r["v"]
        beta = np.linalg.solve(g[:p, :p] + RIDGE * np.eye(p), g[:p, p])
    return beta


def l1_rows(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Design of the fit, of searches that have an exact setting: constant, target, its hinges, and the image's spread of cells."""
    t = F.col("target").cast("double")
    columns = {"one": F.lit(1.0), "target": (t - 65) / 25, **{f"over{k}": F.greatest(t - k, F.lit(0.0)) / 10 for k in _KNOTS}, "steps": F.col("steps").cast("double")}
    images = found.groupBy("image").agg(F.count("exact").alias("m"))
    rows = found.filter("exact IS NOT NULL").join(images, "image").select(*[c.alias(k) for k, c in columns.items()], F.col("exact").alias("y"), (1.0 / F.col("m")).alias("w"))
    return rows, list(columns)


@query("l14_l1_fit")
def fit(spark, sf_dir):
    """Coefficients that foretell the setting of a target, by least absolute errors; images weigh the same."""
    rows, columns = l1_rows(searches(spark, sf_dir))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    n = rows.count()
    beta = l1_fit(rows, columns) if n else np.zeros(len(columns))
    rows.unpersist()
    return spark.createDataFrame([(c, n, round(float(b), 4)) for c, b in zip(columns, beta, strict=True)], "column string, n long, coefficient double")


# ---------------------------------------------------------------- ranks and fronts


@query(
    "g43_rank_panel",
    f"""WITH {CELLS_SQL}, r AS (SELECT image, l_orderkey, bytes, quality, rank() OVER (PARTITION BY image ORDER BY bytes) + (count(*) OVER (PARTITION BY image, bytes) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY image ORDER BY quality) + (count(*) OVER (PARTITION BY image, quality) - 1) / 2.0 AS ry, row_number() OVER (PARTITION BY image) AS k FROM cells),
p AS (SELECT a.image, sum(sign(a.bytes - b.bytes) * sign(a.quality - b.quality)) AS s, sum(abs(sign(a.bytes - b.bytes))) AS x, sum(abs(sign(a.quality - b.quality))) AS y FROM r a JOIN r b ON a.image = b.image AND a.k < b.k GROUP BY a.image),
c AS (SELECT image, count(*) AS n, CASE WHEN min(bytes) < max(bytes) AND min(quality) < max(quality) THEN corr(bytes, quality) END AS plcc, CASE WHEN min(bytes) < max(bytes) AND min(quality) < max(quality) THEN corr(rx, ry) END AS srocc FROM r GROUP BY image)
SELECT image, n, round(plcc, 8) AS plcc, round(srocc, 8) AS srocc, CASE WHEN x > 0 AND y > 0 THEN round(s / sqrt(x * y), 8) END AS krocc FROM c LEFT JOIN p USING (image)""",
)
def rank_panel(spark, sf_dir):
    """Linear, rank and pair correlation of an image's bytes and quality; pairs are counted by inversions."""

    def f(own):
        found = curves.panel(own["bytes"].astype(float), own["quality"].astype(float)) if len(own["bytes"]) > 1 else (None,) * 3
        return [(len(own["bytes"]), *(None if x is None else round(x, 8) for x in found))]

    return by_image(cells(spark, sf_dir).select("image", "bytes", "quality"), f, "n long, plcc double, srocc double, krocc double")


@query(
    "u10_front_distance",
    f"""WITH {CELLS_SQL}, c AS (SELECT DISTINCT image, strategy, bytes, quality FROM cells WHERE strategy IN ('A', 'R')),
f AS (SELECT image, strategy, ln(bytes) AS x, quality / 10 AS y FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.image = c.image AND o.strategy = c.strategy AND o.bytes <= c.bytes AND o.quality >= c.quality AND (o.bytes < c.bytes OR o.quality > c.quality))),
d AS (SELECT a.image, a.strategy, a.x, a.y, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM f a JOIN f b ON a.image = b.image AND a.strategy <> b.strategy GROUP BY ALL)
SELECT image, round(max(d), 6) AS distance, (SELECT count(*) FROM f WHERE f.image = d.image) AS points FROM d GROUP BY image""",
)
def front_distance(spark, sf_dir):
    """Distance of an image's two fronts (logarithm of bytes, quality in tens): the farthest that a point of either is from the other. Images with one front are left out."""

    def f(own):
        fronts = []
        for s in ("A", "R"):
            mine = own["strategy"] == s
            b, q = own["bytes"][mine].astype(float), own["quality"][mine].astype(float)
            at = curves.front(b, q)
            fronts.append(np.stack([np.log(b[at]), q[at] / 10], 1))
        a, r = fronts
        return [(round(max(curves.farthest_nearest(a, r), curves.farthest_nearest(r, a)), 6), len(a) + len(r))] if len(a) and len(r) else []

    return by_image(cells(spark, sf_dir).filter("strategy IN ('A', 'R')").select("image", "strategy", "bytes", "quality"), f, "distance double, points long")


# ---------------------------------------------------------------- medoids

#: Clusters, rounds at most, and fraction bits of a coordinate.
CLUSTERS, KMEANS_ROUNDS, BITS = 8, 20, 24


def medoids(vectors: DataFrame, k: int = CLUSTERS, rounds: int = KMEANS_ROUNDS) -> DataFrame:
    """k-means over vectors (vec_id, x: array of double, all of one length) and each cluster's vector nearest to its centre: cluster, size, medoid, distance.

    Centres begin with the vector of the smallest id, then always the one farthest from its nearest centre (ties: the smaller id). A round sums coordinates as
    whole numbers in the tasks that read them, so centres are the same however rows are dealt out; it ends when no vector moves. Clusters without
    vectors are dropped; fewer distinct vectors than k give fewer clusters.
    """
    spark = vectors.sparkSession
    first = vectors.orderBy("vec_id").limit(1).collect()
    names = "cluster int, size long, medoid long, distance double"
    if not first:
        return spark.createDataFrame([], names)
    centres = np.array([first[0]["x"]])

    def matrix(batch):
        column = batch.column("x")
        return column.flatten().to_numpy().reshape(batch.num_rows, -1)

    def apart(x, c):
        return np.stack([((x - m) ** 2).sum(1) for m in c], 1)

    for _ in range(k - 1):

        def far(batches, centres=centres):
            best = None
            for batch in batches:
                x, ids = matrix(batch), batch.column("vec_id").to_numpy()
                d = apart(x, centres).min(1)
                i = np.lexsort((ids, -d))[0]
                if best is None or (-d[i], ids[i]) < best[:2]:
                    best = (-d[i], ids[i], x[i])
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([-best[0]]), pa.array([int(best[1])]), pa.array([best[2].tolist()], pa.list_(pa.float64()))], names=["d", "vec_id", "x"])

        found = vectors.mapInArrow(far, "d double, vec_id long, x array<double>").orderBy(F.desc("d"), "vec_id").limit(1).first()
        if found["d"] <= 0:
            break
        centres = np.vstack([centres, found["x"]])
    before = None
    for _ in range(rounds):

        def sums(batches, centres=centres):
            total = np.zeros((len(centres), centres.shape[1] + 1), np.int64)
            for batch in batches:
                x = matrix(batch)
                own = apart(x, centres).argmin(1)
                np.add.at(total, own, np.concatenate([np.rint(x * (1 << BITS)).astype(np.int64), np.ones((len(x), 1), np.int64)], 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["c", "s"])

        total = np.zeros((len(centres), centres.shape[1] + 1), np.int64)
        for r in vectors.mapInArrow(sums, "c long, s array<long>").select("c", F.posexplode("s").alias("k", "v")).groupBy("c", "k").agg(F.sum("v").alias("v")).collect():  # clusters by coordinates
            total[r["c"], r["k"]] = r["v"]
        total = total[total[:, -1] > 0]
        if before is not None and np.array_equal(before, total):
            break
        before, centres = total, total[:, :-1] / total[:, -1:] / (1 << BITS)

    def dealt(batches):
        for batch in batches:
            d = apart(matrix(batch), centres)
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(own)), own]))], names=["vec_id", "cluster", "d"])

    own = vectors.mapInArrow(dealt, "vec_id long, cluster int, d double")
    nearest = own.groupBy("cluster").agg(F.count("*").alias("size"), F.min(F.struct("d", "vec_id")).alias("m"))
    return nearest.select("cluster", "size", F.col("m.vec_id").alias("medoid"), F.round("m.d", 6).alias("distance"))


@query("j17_medoids")
def cluster_medoids(spark, sf_dir):
    """Eight clusters of the vectors, their sizes, and the vector that stands for each."""
    t = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    return medoids(t.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")))


# ---------------------------------------------------------------- marker lines


@query(
    "s16_marked_values",
    """WITH e AS (SELECT user_id, event_id, event_type, value, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following FROM events),
m AS (SELECT user_id, following, event_id AS marker FROM e WHERE event_type = 'purchase'), p AS (SELECT user_id, following, CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM e WHERE event_type <> 'purchase' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, following ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY user_id, following) AS pending FROM p)
SELECT user_id, marker, v AS value, n, CAST(pending AS BIGINT) AS pending FROM r JOIN m USING (user_id, following) WHERE k = 1""",
)
def marked_values(spark, sf_dir):
    """Values before a marker belong to it: of a user's whole values since the marker before, the most frequent one (ties: the least). Markers
    without values, and values that no marker follows, are left out."""
    t = table(spark, sf_dir, "events")
    marker = F.col("event_type") == "purchase"
    ahead = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    e = t.withColumn("following", F.sum(marker.cast("long")).over(ahead))
    markers = e.filter(marker).select("user_id", "following", F.col("event_id").alias("marker"))
    values = e.filter(~marker).groupBy("user_id", "following", F.floor("value").alias("v")).agg(F.count("*").alias("n"))
    best = values.groupBy("user_id", "following").agg(F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b"), F.sum("n").alias("pending"))
    return best.join(markers, ["user_id", "following"]).select("user_id", "marker", F.col("b.v").alias("value"), (-F.col("b.m")).alias("n"), "pending")
