"""Rasters of whole batches as flat arrays: samples of many texts one after another, with row and place of each.

A raster operator is a function of a Slice; `raster_stage` runs it over the texts of a table, slice by slice, within the tasks
that read them. Neighbours are shifted copies of the flat array, so nothing is done sample by sample and no sample moves
to another task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import WIDTH

#: Characters handled at once.
SLICE = 1 << 20


class Slice:
    """Samples `v` of n rasters; `row` is a sample's raster, `place` its position there, `size` the samples of each raster."""

    def __init__(self, v: np.ndarray, size: np.ndarray):
        self.v, self.size, self.n = v, size, len(size)
        self.row = np.repeat(np.arange(self.n), size)
        self.start = np.cumsum(size) - size
        self.place = np.arange(len(v)) - self.start[self.row]
        self.x, self.y = self.place % WIDTH, self.place // WIDTH

    def before(self, k: int) -> np.ndarray:
        """The sample k places earlier; of no meaning where the raster has none there."""
        out = np.zeros(len(self.v), np.int64)
        out[k:] = self.v[: max(0, len(self.v) - k)]
        return out

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum over each raster."""
        return total(values, self.row, self.n)

    def digest(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values over each raster, weighted by place, so that equal digests mean equal values in practice."""
        return self.total(values * (self.place % 97 + 1))

    def neighbours(self) -> dict[str, np.ndarray]:
        """w, n, nw, ne, ww, nn, nee of every sample. Outside the raster: the left one of a row's first sample is the one
        above, that of the first row 0; a missing upper one is the left one, missing farther ones are the next nearer."""
        left, above = self.x > 0, self.y > 0
        up = self.before(WIDTH)
        w = np.where(left, self.before(1), np.where(above, up, 0))
        n = np.where(above, up, w)
        nw = np.where(left & above, self.before(WIDTH + 1), w)
        ne = np.where((self.x + 1 < WIDTH) & above, self.before(WIDTH - 1), n)
        ww = np.where(self.x > 1, self.before(2), w)
        nn = np.where(self.y > 1, self.before(2 * WIDTH), n)
        nee = np.where((self.x + 2 < WIDTH) & above, self.before(WIDTH - 2), ne)
        return {"w": w, "n": n, "nw": nw, "ne": ne, "ww": ww, "nn": nn, "nee": nee}

    def counts(self, symbols: np.ndarray, most: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raster, symbol (0 to most - 1) and number of every symbol that a raster has, in that order."""
        table = np.bincount(self.row * most + symbols, minlength=self.n * most)
        at = np.flatnonzero(table)
        return at // most, at % most, table[at]


def total(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Whole sums by group; groups are in ascending order."""
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    edge = np.searchsorted(groups, np.arange(n + 1))
    return upto[edge[1:]] - upto[edge[:-1]]


def clamped_gradient(n: np.ndarray, w: np.ndarray, nw: np.ndarray) -> np.ndarray:
    """The plane through three neighbours, kept between the upper and the left one."""
    return np.clip(n + w - nw, np.minimum(n, w), np.maximum(n, w))


def residuals(s: Slice) -> np.ndarray:
    """Samples less the clamped gradient of their neighbours."""
    a = s.neighbours()
    return s.v - clamped_gradient(a["n"], a["w"], a["nw"])


#: Names of the predictors, in the order that a choice among equals follows.
PREDICTORS = ("zero", "west", "north", "average0", "choose", "gradient", "weighted", "north_east", "north_west", "west_west", "average1", "average2", "average3", "average4")


def predictions(a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Every predictor's guess from the neighbours. Averages are rounded down, but for the last, which is rounded to zero;
    the weighted one, which has no state here, is the gradient."""
    w, n, nw, ne, ww, nn, nee = (a[k] for k in ("w", "n", "nw", "ne", "ww", "nn", "nee"))
    plane = clamped_gradient(n, w, nw)
    wide = 6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8
    guesses = (
        np.zeros_like(w), w, n, (w + n) >> 1, np.where(np.abs(n - nw) < np.abs(w - nw), w, n), plane, plane, ne, nw, ww,
        (w + nw) >> 1, (n + nw) >> 1, (n + ne) >> 1, np.sign(wide) * (np.abs(wide) // 16),
    )
    return dict(zip(PREDICTORS, guesses, strict=True))


def zigzag(x: np.ndarray) -> np.ndarray:
    """Signed to unsigned: 0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    return np.where(x >= 0, 2 * x, -2 * x - 1)


def hybrid(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token of an unsigned value (itself below 16, else its exponent and its two next bits), and the raw bits that follow."""
    exponent = np.frexp(np.maximum(u, 1).astype(np.float64))[1] - 1
    return np.where(u < 16, u, 16 + (exponent - 4) * 4 + ((u >> np.maximum(exponent - 2, 0)) & 3)), np.where(u < 16, 0, exponent - 2)


def slices(column: pa.Array, rasters: Callable[[np.ndarray], np.ndarray] = lambda v: v & 255) -> Iterator[tuple[int, Slice]]:
    """First row and Slice of runs of rows of about SLICE characters; a sample is a character's code, modulo 256."""
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    row = 0
    while row < len(sizes):
        end = max(row + 1, int(np.searchsorted(upto, upto[row] + SLICE, "right")) - 1)
        text = "".join(column.slice(row, end - row).to_pylist())
        yield row, Slice(rasters(np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)), sizes[row:end])
        row = end


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores where its files give fewer tasks than there are; a table of many row groups stays as it is."""
    n = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(n) if docs.rdd.getNumPartitions() < n else docs


def count_stage(docs: DataFrame, f: Callable[[Slice, np.ndarray, list], np.ndarray], key: str, most_keys: int = 1024) -> DataFrame:
    """Counts over the samples of docs' texts, by key: key, cell, n. f gives a table of counts, a row for each of the keys (its third
    argument; the second is the key's number of each raster). A task adds up all that it reads before it passes anything on;
    where it meets more than most_keys keys, it passes on what it has so far."""

    def run(batches):
        table: dict = {}

        def out(kind):
            for k, counts in table.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), kind), pa.array(at), pa.array(counts[at])], names=["key", "cell", "n"])
            table.clear()

        kind = None
        for batch in batches:
            kind = batch.column(key).type
            names = batch.column(key).to_pylist()
            for row, part in slices(batch.column("text")):
                own = names[row : row + part.n]
                distinct = {k: i for i, k in enumerate(dict.fromkeys(own))}
                counts = f(part, np.array([distinct[k] for k in own]), list(distinct))
                for k, c in zip(distinct, counts, strict=True):
                    table[k] = table[k] + c if k in table else c
                if len(table) > most_keys:
                    yield from out(kind)
        if kind is not None:
            yield from out(kind)

    some = spread(docs.filter(F.length("text") > 0).select(key, "text"))
    counted = some.mapInArrow(run, f"key {some.schema[key].dataType.simpleString()}, cell long, n long")
    return counted.groupBy(F.col("key").alias(key), "cell").agg(F.sum("n").alias("n"))


def raster_stage(docs: DataFrame, f: Callable[[Slice], tuple], fields: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """f over the rasters of docs' texts (those with a character). f gives the raster of each row it makes, or None for one a
    raster, and the columns of `fields`; `keep` are columns of docs that come first."""

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for row, part in slices(text):
                of, *columns = f(part)
                at = pa.array(np.arange(part.n) + row if of is None else of + row)
                arrays = [*(batch.column(c).take(at) for c in keep), *(pa.array(c) for c in columns)]
                made = pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])
                yield made.cast(schema)

    out = spread(docs.filter(F.length("text") > 0).select(*keep, "text"))
    kept = ", ".join(f"{c} {out.schema[c].dataType.simpleString()}" for c in keep)
    spec = f"{kept}, {fields}"
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([pa.field(f"c{k}", kinds[x.split()[1]]) for k, x in enumerate(spec.split(", "))])
    return out.mapInArrow(run, spec)


# ---------------------------------------------------------------- squeeze


def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean of two samples, rounded towards the first."""
    return (a + b + (a > b)) >> 1


def _twelfth(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * (np.abs(x) // 12)


def tendency(b: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The difference to be expected between the two samples of a pair with average a, after the sample b and before the average
    n: 0 unless the three rise or fall, and never more than keeps them doing so."""
    down = _twelfth(4 * b - 3 * n - a + 6)
    down = np.where(down - (down & 1) > 2 * (b - a), 2 * (b - a) + 1, down)
    down = np.where(down + (down & 1) > 2 * (a - n), 2 * (a - n), down)
    up = _twelfth(4 * b - 3 * n - a - 6)
    up = np.where(up + (up & 1) < 2 * (b - a), 2 * (b - a) - 1, up)
    up = np.where(up - (up & 1) < 2 * (a - n), 2 * (a - n), up)
    return np.where((b >= a) & (a >= n), down, np.where((b <= a) & (a <= n), up, 0))


def squeeze(lines: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Averages and residuals of lines (a matrix, `size` samples of each row count): a residual is the difference of a pair
    less its tendency, an odd last sample is its own average."""
    k = np.arange(lines.shape[1] // 2)
    a, b = lines[:, 0::2][:, : len(k)], lines[:, 1::2]
    pairs = size[:, None] // 2
    whole = np.where(k < pairs, average(a, b), 0)
    odd = np.zeros((len(lines), len(k) + 1), np.int64)
    odd[:, :-1] = whole
    last = np.flatnonzero(size % 2 == 1)
    odd[last, size[last] // 2] = lines[last, size[last] - 1]
    following = np.where(k + 1 < (size[:, None] + 1) // 2, odd[:, 1:], whole)
    before = np.concatenate([whole[:, :1], b[:, :-1]], 1)
    return odd, np.where(k < pairs, a - b - tendency(before, whole, following), 0)


def unsqueeze(averages: np.ndarray, residuals: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The lines that squeeze took apart: pair by pair along all lines at once."""
    out = np.zeros((len(size), 2 * residuals.shape[1] + 1), np.int64)
    before = averages[:, 0]
    for k in range(residuals.shape[1]):
        now = averages[:, k]
        following = np.where(k + 1 < (size + 1) // 2, averages[:, k + 1], now)
        difference = residuals[:, k] + tendency(before if k else now, now, following)
        a = (now * 2 + difference + np.where(difference > 0, -(difference & 1), difference & 1)) >> 1
        there = k < size // 2
        out[:, 2 * k], out[:, 2 * k + 1] = np.where(there, a, 0), np.where(there, a - difference, 0)
        before = out[:, 2 * k + 1]
    odd = np.flatnonzero(size % 2 == 1)
    out[odd, size[odd] - 1] = averages[odd, size[odd] // 2]
    return out


def row_lines(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The raster rows of a slice as a matrix, the samples of each, and the raster of each."""
    rows = -(-s.size // WIDTH)
    of = np.repeat(np.arange(s.n), rows)
    first = np.cumsum(rows) - rows
    lines = np.zeros((len(of), WIDTH), np.int64)
    lines[first[s.row] + s.y, s.x] = s.v
    return lines, np.bincount(first[s.row] + s.y, minlength=len(of)), of


# ---------------------------------------------------------------- colour

#: The order in which a permutation takes the three channels.
PERMUTATIONS = ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1), (1, 0, 2), (2, 1, 0))


def colour_forward(channels, kind: int):
    """One of 42 reversible transforms of three channels: kind is 7 times the permutation plus the transform. A transform takes
    off the second channel nothing, the first, or the mean of first and third, and off the third nothing or the first; the last
    one gives luma, orange-blue and green-purple differences."""
    a, b, c = (channels[k] for k in PERMUTATIONS[kind // 7])
    step = kind % 7
    if step == 6:
        co = a - c
        base = c + (co >> 1)
        cg = b - base
        return base + (cg >> 1), co, cg
    return a, b - (0, a, (a + c) >> 1)[step // 2], c - (a if step & 1 else 0)


def colour_inverse(channels, kind: int):
    a, b, c = channels
    step = kind % 7
    if step == 6:
        base = a - (c >> 1)
        green = c + base
        blue = base - (b >> 1)
        a, b, c = blue + b, green, blue
    else:
        c = c + (a if step & 1 else 0)
        b = b + (0, a, (a + c) >> 1)[step // 2]
    out = [None] * 3
    for at, x in zip(PERMUTATIONS[kind // 7], (a, b, c), strict=True):
        out[at] = x
    return tuple(out)
