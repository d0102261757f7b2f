"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Vectors, scaled to length 1, are projected on `projections` random directions. A block of vectors keeps, for each single
projection, its values in order. A query lays a window around its own value on every projection; a vector in the
window collides there. Virtual rehashing widens all windows (by `growth`) until enough vectors have collided on
`threshold` of the projections; those, and only those, are verified with the exact cosine. A window that holds more than half
of a sorted array is counted by what lies outside it, so a query touches the smaller part. Every vector is in some block, and
every query meets every block, in blocks of queries; each pair of blocks returns its k best, which are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_column, materialize

_BLOCK = "block int, ids binary, vectors binary, dim int"


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter(whole & F.exists("embedding", lambda x: x != 0))


def _in_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of about `size` vectors, by a hash of the id; as many as the table needs."""
    n = max(1, -(-vectors.count() // size))

    def f(table: pa.Table) -> pa.Table:
        ids = batch_column(table, "vec_id").to_numpy()
        column = batch_column(table, "embedding")
        dims = np.asarray(pc.list_value_length(column))
        out = []
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            x = column.take(pa.array(own)).flatten().to_numpy().reshape(len(own), d)
            order = np.argsort(ids[own], kind="stable")
            out.append((table.column("block")[0].as_py(), ids[own][order].tobytes(), x[order].astype("<f8").tobytes(), int(d)))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["block", "ids", "vectors", "dim"])

    return vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(f, _BLOCK)


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, on the vectors as they are; scaled by a power of two where squares would leave the range."""
    fit = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])
    a, b = fit(rows), fit(query)
    return (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))


class Block:
    """Sorted projections of the vectors of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, seed: int):
        self.ids, self.vectors = ids, vectors
        # divided by the largest component first: squares neither overflow nor vanish
        scaled = vectors / np.abs(vectors).max(1, keepdims=True)
        self.unit = scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], projections))
        values = self.unit @ self.axes
        self.order = np.argsort(values, 0, kind="stable").T.copy()
        self.values = np.take_along_axis(values.T, self.order, 1)

    def _window(self, centers: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each query's window in each sorted array."""
        low = np.stack([np.searchsorted(v, c - width) for v, c in zip(self.values, centers, strict=True)])
        return low, np.stack([np.searchsorted(v, c + width, "right") for v, c in zip(self.values, centers, strict=True)])

    def candidates(self, queries: np.ndarray, enough: int, threshold: int, width: float, growth: float):
        """For each unit vector of queries: its number, and the places that collide with it on `threshold` projections
        at the first width that gives enough. A wider window counts only what it adds to the one before."""
        n, m = len(self.ids), len(self.values)
        enough = min(enough, n)
        centers = (queries @ self.axes).T
        active = np.arange(len(queries))
        low, high = self._window(centers, width)
        counts = np.empty((len(queries), n), np.int32)
        flat, base = self.order.ravel(), np.arange(m) * n

        def total(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            """How often each place occurs in ranges of all sorted arrays."""
            size = ends - starts
            upto = np.cumsum(size)
            return np.bincount(flat[np.repeat(starts - upto + size, size) + np.arange(int(upto[-1]))], minlength=n)

        for q in active:
            if 2 * int((high[:, q] - low[:, q]).sum()) > n * m:
                counts[q] = m - total(np.concatenate([base, base + high[:, q]]), np.concatenate([base + low[:, q], base + n]))
            else:
                counts[q] = total(base + low[:, q], base + high[:, q])
        while True:
            rest = []
            for q in active:
                found = np.flatnonzero(counts[q] >= threshold)
                if len(found) >= enough:
                    yield q, found
                else:
                    rest.append(q)
            if not rest:
                return
            active, width = np.array(rest), width * growth
            wider_low, wider_high = self._window(centers[:, active], width)
            for i, q in enumerate(active):
                counts[q] += total(np.concatenate([base + wider_low[:, i], base + high[:, q]]), np.concatenate([base + low[:, q], base + wider_high[:, i]]))
            low[:, active], high[:, active] = wider_low, wider_high


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, projections: int = 192, threshold: int = 184, width: float = 2.2, growth: float = 1.05, verified: float = 0.02, block: int = 8192, query_block: int = 512, seed: int = 7) -> DataFrame:
    """The k nearest rows of vectors (vec_id, embedding) by cosine for every row of queries (the same columns).

    Rows with a null id, a null, zero, or empty vector, or one with null or non-finite components take no part; neither do
    vectors of another dimension than the query's. A query never meets its own id. Ties go to the smaller vec_id; fewer than k
    candidates are all returned. Rows that repeat an id with an equal score count once; an id with several vectors is a candidate
    with each of them. Other columns are not read; an empty table on either side gives no rows. `verified`: share of
    a block that is verified for each query, besides 20 k, at least. Returns query_id, rank, vec_id, score.
    """
    left = materialize(_in_blocks(_usable(vectors), block), "blocks").withColumnsRenamed({"ids": "v_ids", "vectors": "v", "block": "v_block"})
    right = materialize(_in_blocks(_usable(queries), query_block), "queries").withColumnsRenamed({"ids": "q_ids", "vectors": "q", "block": "q_block"})
    n_left = left.agg(F.coalesce(F.max("v_block"), F.lit(0))).first()[0] + 1
    # the query set meets all rows, in blocks; Spark takes the queries, repeated for each block, for as small as they are once, and would
    # gather and broadcast them in the driver
    met = right.withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))).join(left.hint("merge"), ["v_block", "dim"])

    def f(batches):
        held = (None, None)
        for batch in batches:
            for r in range(batch.num_rows):
                number, d = batch.column("v_block")[r].as_py(), batch.column("dim")[r].as_py()
                part = lambda c, kind: np.frombuffer(batch.column(c)[r].as_buffer(), kind)  # noqa: B023, E731
                own = Block(part("v_ids", "<i8"), part("v", "<f8").reshape(-1, d), projections, seed) if held[0] != (number, d) else held[1]
                held = ((number, d), own)
                q_ids, q = part("q_ids", "<i8"), part("q", "<f8").reshape(-1, d)
                scaled = q / np.abs(q).max(1, keepdims=True)
                unit = scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
                ids, others, scores = [], [], []
                for i, at in own.candidates(unit, 20 * k + int(verified * len(own.ids)), threshold, width, growth):
                    at = at[own.ids[at] != q_ids[i]]
                    score = cosines(own.vectors[at], q[i])
                    order = np.lexsort((own.ids[at], -score))
                    name, score = own.ids[at][order], score[order]
                    new = np.ones(len(name), bool)
                    new[1:] = (name[1:] != name[:-1]) | (score[1:] != score[:-1])
                    ids.append(np.full(min(k, int(new.sum())), q_ids[i]))
                    others.append(name[new][:k])
                    scores.append(score[new][:k])
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, others, scores)], names=["query_id", "vec_id", "score"])

    found = met.select("v_block", "dim", "v_ids", "v", "q_ids", "q").mapInArrow(f, "query_id long, vec_id long, score double").distinct()
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
