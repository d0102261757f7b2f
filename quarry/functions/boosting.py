"""Gradient boosting on binned columns, and what is read off the trees: predictions, dependence surfaces, their shape.

Trees see bins alone, so rows whose bins are the same are added up once, in slabs: a slab holds the rows with some bins of the outer
columns, as sums for each combination of the inner ones' bins. There are as many combinations as there are bins, however many rows.
Several models grow together: a level of all of them is one pass over the slabs, which adds up residuals and rows by model, open node,
column and bin within the tasks, and one sum. Within a slab a leaf is a product of conditions on outer and on inner columns, so predictions
and sums are products of matrices. Residuals are whole numbers (in units of 2 ** -SCALE) and values have FINE fraction bits, so all sums are
exact, and trees the same however the rows are dealt out. Trees are held by the driver; rows never are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a column, and fraction bits of a residual and of a value.
BINS, SCALE, FINE = 32, 20, 40
#: Combinations of bins that are handled at once, and most of them in a slab; what a slab costs besides them, in their terms; bytes of slabs that a task reads.
AT_ONCE, MOST_INNER, SLAB_COST, TASK_BYTES = 1 << 18, 1 << 12, 20, 32 << 20


@dataclass
class Tree:
    """Nodes by place (children of i at 2 i + 1 and 2 i + 2): column split on (-1 in a leaf), last bin of the lower side, value, rows."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; bins: columns by rows."""
        at = np.zeros(bins.shape[1], np.int64)
        while True:
            inner = np.flatnonzero(self.column[at] >= 0)
            if not len(inner):
                return at
            own = at[inner]
            at[inner] = 2 * own + 1 + (bins[self.column[own], inner] > self.cut[own])

    def boxes(self, n_columns: int, places: range | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Leaves, or the nodes at the places: their places, and for each whether a column's bin leads there (nodes by columns by bins)."""
        found, open_ = [], [(0, np.ones((n_columns, BINS), bool))]
        while open_:
            at, box = open_.pop()
            inner = self.column[at] >= 0
            if at in places if places is not None else not inner:
                found.append((at, box))
            if inner:
                for child, side in ((2 * at + 1, np.arange(BINS) <= self.cut[at]), (2 * at + 2, np.arange(BINS) > self.cut[at])):
                    own = box.copy()
                    own[self.column[at]] &= side
                    open_.append((child, own))
        return np.array([at for at, _ in found], np.int64), np.array([box for _, box in found]).reshape(-1, n_columns, BINS)


@dataclass
class Model:
    """A sum of trees that predicts an outcome from some columns, fitted to the rows that its flag marks."""

    name: str
    outcome: int
    flag: int
    columns: tuple[int, ...]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def predict(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        """The sum of the first trees, or of all."""
        out = np.full(bins.shape[1], self.base)
        use = self.trees[:trees]
        boxes = [t.boxes(len(bins)) for t in use]
        if any(len(at) > 8 for at, _ in boxes):
            for t in use:
                out += t.value[t.leaves(bins)]
            return out
        # eight trees share a word, a leaf has a bit: those that every column leaves are the leaves of a row
        for k in range(0, len(use), 8):
            word = np.full(bins.shape[1], (1 << 64) - 1, np.uint64)
            for c in range(len(bins)):
                mask = np.zeros(BINS, np.uint64)
                for j, (at, box) in enumerate(boxes[k : k + 8]):
                    for i in range(len(at)):
                        mask |= box[i, c].astype(np.uint64) << np.uint64(8 * j + i)
                word &= mask[bins[c]]
            for j, (at, _) in enumerate(boxes[k : k + 8]):
                value = np.zeros(256)
                value[1 << np.arange(len(at))] = use[k + j].value[at]
                out += value[(word >> np.uint64(8 * j)) & np.uint64(255)]
        return out


def fine(x):
    return np.rint(x * (1 << FINE)) / (1 << FINE)


def whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * (1 << SCALE)).astype(np.int64)


def best_split(total: np.ndarray, rows: np.ndarray, columns: tuple[int, ...], ridge: float, least: int) -> tuple[int, int] | None:
    """(column, last bin of the lower side) of the largest gain, or None if there is none above 0; total, rows: columns by bins. Of
    equal gains the first column and lowest bin; no side has under `least` rows."""
    g, n = total[columns[0]].sum(), rows[columns[0]].sum()
    low_g, low_n = np.cumsum(total, 1)[:, :-1].astype(float), np.cumsum(rows, 1)[:, :-1]
    high_g, high_n = g - low_g, n - low_n
    gain = low_g**2 / (low_n + ridge) + high_g**2 / (high_n + ridge) - float(g) ** 2 / (n + ridge)
    open_ = (low_n >= least) & (high_n >= least)
    open_[[c for c in range(len(total)) if c not in columns]] = False
    gain = np.where(open_, gain, -np.inf)
    c, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (int(c), int(b)) if gain[c, b] > 0 else None


def _unpacked(batch: pa.RecordBatch, n_columns: int, n_outcomes: int):
    """Bins (columns by rows), outcomes and flags of a batch."""
    bins = np.stack([batch.column(f"x{k}").to_numpy() for k in range(n_columns)]).astype(np.int64)
    outcomes = [batch.column(f"y{k}").to_numpy(zero_copy_only=False) for k in range(n_outcomes)]
    return bins, outcomes, batch.column("flags").to_numpy()


@dataclass
class Codes:
    """Codes of bins: the bins that occur in each column, and which columns make up a slab's code (outer) and that of its combinations (inner)."""

    there: list[list[int]]
    outer: list[int]
    inner: list[int]

    def strides(self, columns: list[int]) -> list[int]:
        return [int(np.prod([len(self.there[c]) for c in columns[k + 1 :]], dtype=np.int64)) for k in range(len(columns))]

    @property
    def size(self) -> int:
        return int(np.prod([len(self.there[c]) for c in self.inner], dtype=np.int64))

    def places(self, columns: list[int], code: np.ndarray) -> list[np.ndarray]:
        """The bin of each of the columns in a code of slabs or combinations."""
        return [np.array(self.there[c])[code // k % len(self.there[c])] for c, k in zip(columns, self.strides(columns), strict=True)]


def slabs(binned: DataFrame, mask: int, n_columns: int, n_outcomes: int) -> tuple[DataFrame, Codes]:
    """Rows of binned with a flag of the mask, in slabs: slab (a code), flags, and for each outcome rows (n0, ...) and sums in whole units (s0, ...)
    of every combination. How many columns are inner ones follows what slabs and combinations cost. Sums of a slab may come in parts."""
    seen = binned.agg(F.count("*").alias("n"), *[F.bit_or(F.expr(f"shiftleft(1L, x{c})")).alias(f"x{c}") for c in range(n_columns)]).first()
    there = [[b for b in range(BINS) if (seen[f"x{c}"] or 0) >> b & 1] or [0] for c in range(n_columns)]
    order = sorted(range(n_columns), key=lambda c: (len(there[c]), c))
    product = lambda columns: int(np.prod([len(there[c]) for c in columns], dtype=object))
    cost = {k: min(seen["n"], product(order[k:])) * (SLAB_COST + product(order[:k])) for k in range(n_columns) if product(order[:k]) <= MOST_INNER}
    inner = order[: min(cost, key=cost.get)]
    out = Codes(there, [c for c in order if c not in inner], inner)
    size, fields = out.size, ", ".join(f"n{o} binary, s{o} binary" for o in range(n_outcomes))

    def code(batches):
        rank = [np.array([there[c].index(b) if b in there[c] else 0 for b in range(BINS)]) for c in range(n_columns)]
        for batch in batches:
            bins, y, flags = _unpacked(batch, n_columns, n_outcomes)
            own = np.flatnonzero(flags & mask)
            codes = [sum((rank[c][bins[c, own]] * k for c, k in zip(columns, out.strides(columns), strict=True)), np.zeros(len(own), np.int64)) for columns in (out.outer, inner)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (codes[0], flags[own] & mask, codes[1], *(v[own].astype(float) for v in y))], names=["slab", "flags", "cell", *[f"y{o}" for o in range(n_outcomes)]])

    def pack(batches):
        def emit(slab, flags, sums):
            packed = [pa.array(slab), pa.array(flags)]
            for n, s in sums:
                for x in (n.astype("<u4"), s.astype("<f8")):
                    ends = np.arange(len(slab) + 1, dtype=np.int32) * (size * x.itemsize)
                    packed.append(pa.Array.from_buffers(pa.binary(), len(slab), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())]))
            return pa.RecordBatch.from_arrays(packed, names=["slab", "flags", *[f"{k}{o}" for o in range(n_outcomes) for k in "ns"]])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            slab, flags, cell = (batch.column(c).to_numpy() for c in ("slab", "flags", "cell"))
            y = [batch.column(f"y{o}").to_numpy(zero_copy_only=False).astype(float) for o in range(n_outcomes)]
            new = np.concatenate([[True], (slab[1:] != slab[:-1]) | (flags[1:] != flags[:-1])])
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            ends = np.append(first, len(slab))
            step = max(1, AT_ONCE // size)
            for g in range(0, len(first), step):
                h = min(g + step, len(first))
                own = slice(ends[g], ends[h])
                at = (group[own] - g) * size + cell[own]
                sums = []
                for v in y:
                    ok = np.isfinite(v[own])
                    sums.append(tuple(np.bincount(at[ok], w, (h - g) * size).reshape(h - g, size) for w in (None, whole(v[own][ok]).astype(float))))
                sums = [(n.astype(np.int64), s) for n, s in sums]
                names = slab[first[g:h]], flags[first[g:h]]
                if held is not None:
                    # counts have 32 bits; what is over that goes to a second slab of the same name
                    if held[0] == names[0][0] and held[1] == names[1][0] and all(int(n.sum() + m[0].sum()) < 1 << 32 for (n, _), (m, _) in zip(held[2], sums, strict=True)):
                        for (n, s), (m, t) in zip(held[2], sums, strict=True):
                            m[0] += n[0]
                            t[0] += s[0]
                    else:
                        yield emit(np.array(held[:1]), np.array([held[1]]), held[2])
                held = (int(names[0][-1]), int(names[1][-1]), [(n[-1:], s[-1:]) for n, s in sums])
                if h - g > 1:
                    yield emit(names[0][:-1], names[1][:-1], [(n[:-1], s[:-1]) for n, s in sums])
        if held is not None:
            yield emit(np.array(held[:1]), np.array([held[1]]), held[2])

    many = min(seen["n"], product(out.outer)) * size * 12 * n_outcomes
    parts = max(2 * binned.sparkSession.sparkContext.defaultParallelism, -(-many // TASK_BYTES))
    # codes are made here, not by Spark, which would work out the expressions of bins and flags once for each use
    rows = binned.mapInArrow(code, "slab long, flags long, cell long, " + ", ".join(f"y{o} double" for o in range(n_outcomes)))
    table = rows.repartition(parts, "slab", "flags").sortWithinPartitions("slab", "flags").mapInArrow(pack, "slab long, flags long, " + fields).persist(StorageLevel.MEMORY_AND_DISK)
    return table, out


def _blocks(batch: pa.RecordBatch, size: int, n_outcomes: int):
    """Slabs of a batch in runs of about AT_ONCE combinations: codes, flags, and rows and sums of each outcome (slabs by combinations)."""

    def numbers(name, kind):
        column = batch.column(name)
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32, batch.num_rows + 1, column.offset * 4)
        return np.frombuffer(data, kind)[ends[0] // np.dtype(kind).itemsize : ends[-1] // np.dtype(kind).itemsize].reshape(-1, size)

    slab, flags = batch.column("slab").to_numpy(), batch.column("flags").to_numpy()
    sums = [(numbers(f"n{o}", "<u4"), numbers(f"s{o}", "<f8")) for o in range(n_outcomes)]
    step = max(1, AT_ONCE // size)
    for k in range(0, batch.num_rows, step):
        yield slab[k : k + step], flags[k : k + step], [(n[k : k + step], s[k : k + step]) for n, s in sums]


def fit(binned: DataFrame, models: list[Model], n_columns: int, n_outcomes: int, trees: int = 20, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: int = 20) -> list[Model]:
    """Fit the models to binned: x0, x1, ... (int bins), y0, y1, ... (double), flags (long; bit k marks the rows of models with flag k).
    Rows with a null or non-finite outcome are of no use to its models, and a model without rows stays empty."""
    mask = 0
    for m in models:
        mask |= 1 << m.flag
    table, codes = slabs(binned, mask, n_columns, n_outcomes)
    size, outer, inner = codes.size, codes.outer, codes.inner

    def means(batches):
        total = np.zeros((len(models), 2), np.int64)
        for batch in batches:
            for _, flags, sums in _blocks(batch, size, n_outcomes):
                for i, m in enumerate(models):
                    own = flags >> m.flag & 1 == 1
                    n, s = sums[m.outcome]
                    total[i] += int(s[own].sum()), int(n[own].sum(dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["m", "g", "n"])

    for r in table.mapInArrow(means, "m long, g long, n long").groupBy("m").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).collect():
        if r["n"]:
            models[r["m"]].base = float(fine(r["g"] / r["n"] / (1 << SCALE)))
    within = codes.places(inner, np.arange(size))  # the bin of each inner column, by combination
    for _ in range(trees):
        for m in models:
            m.trees.append(Tree.empty(depth))
        for level in range(depth):
            first = (1 << level) - 1
            cells = (1 << level) * n_columns * BINS

            def level_sums(batches, first=first, cells=cells, level=level):
                total = np.zeros((2, len(models), 1 << level, n_columns, BINS), np.int64)
                dense = np.zeros((2, len(models), 1 << level, size))
                ready = []
                for m in models:
                    made = [(t.value[at], box) for t in m.trees[:-1] for at, box in [t.boxes(n_columns)]]
                    value = np.concatenate([v for v, _ in made]) if made else np.empty(0)
                    leaf = np.concatenate([b for _, b in made]) if made else np.empty((0, n_columns, BINS), bool)
                    at, node = m.trees[-1].boxes(n_columns, range(first, first + (1 << level)))
                    inside = lambda boxes: np.logical_and.reduce([boxes[:, c, b] for c, b in zip(inner, within, strict=True)] or [np.ones((len(boxes), size), bool)])
                    ready.append((leaf, inside(leaf) * value[:, None], at - first, node, inside(node).astype(float)))
                for batch in batches:
                    for slab, flags, sums in _blocks(batch, size, n_outcomes):
                        for i, m in enumerate(models):
                            leaf, leaf_in, at, node, node_in = ready[i]
                            own = np.flatnonzero(flags >> m.flag & 1 == 1)
                            if not len(own) or not len(at):
                                continue
                            n, s = (x if len(own) == len(slab) else x[own] for x in sums[m.outcome])
                            bins = codes.places(outer, slab[own])
                            # rows by nodes: where the outer columns' bins lead
                            out = lambda boxes: np.logical_and.reduce([boxes[:, c].T[b] for c, b in zip(outer, bins, strict=True)]).astype(float)  # noqa: B023, E731
                            guess = out(leaf) @ leaf_in if len(leaf) else np.zeros(n.shape)
                            guess += m.base
                            guess *= 1 << SCALE
                            np.rint(guess, out=guess)
                            n = n.astype(float)
                            guess *= n
                            to = out(node)
                            for k, x in enumerate((np.subtract(s, guess, out=guess), n)):
                                if inner:
                                    dense[k, i, at] += to.T @ x
                                by_row = (x @ node_in.T * to).T
                                for c, b in zip(outer, bins, strict=True):
                                    for j, w in zip(at, by_row, strict=True):
                                        total[k, i, j, c] += np.bincount(b, w, BINS).astype(np.int64)
                for i in range(len(models)):
                    _, _, at, _, node_in = ready[i]
                    for k in range(2):
                        for j, w in zip(at, dense[k, i, at] * node_in, strict=True):
                            for c, b in zip(inner, within, strict=True):
                                total[k, i, j, c] += np.bincount(b, w, BINS).astype(np.int64)
                flat = total.reshape(2, -1)
                at = np.flatnonzero(flat[1])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[0, at]), pa.array(flat[1, at])], names=["cell", "g", "n"])

            sums = table.mapInArrow(level_sums, "cell long, g long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
            found = np.zeros((2, len(models) * cells), np.int64)
            for r in sums.collect():  # models by nodes by columns by bins
                found[:, r["cell"]] = r["g"], r["n"]
            found = found.reshape(2, len(models), 1 << level, n_columns, BINS)
            for i, m in enumerate(models):
                t = m.trees[-1]
                for k in range(1 << level):
                    _settle(t, first + k, found[0, i, k], found[1, i, k], m.columns, ridge, least, rate)
    table.unpersist()
    return models


def _settle(t: Tree, at: int, total: np.ndarray, rows: np.ndarray, columns: tuple[int, ...], ridge: float, least: int, rate: float) -> None:
    """Split a node, or leave it a leaf; its children get the values they have as leaves."""
    n = int(rows[columns[0]].sum())
    if not n:
        return
    split = best_split(total, rows, columns, ridge, least)
    t.rows[at] = n
    t.value[at] = fine(rate * float(total[columns[0]].sum()) / (1 << SCALE) / (n + ridge))
    if split is None:
        return
    c, b = split
    t.column[at], t.cut[at] = c, b
    for child, side in ((2 * at + 1, slice(None, b + 1)), (2 * at + 2, slice(b + 1, None))):
        t.rows[child] = int(rows[c, side].sum())
        t.value[child] = fine(rate * float(total[c, side].sum()) / (1 << SCALE) / (t.rows[child] + ridge))


def scores(binned: DataFrame, models: list[Model], tests: list[int], n_columns: int, n_outcomes: int) -> list[dict]:
    """Squared error and variance of each model's outcome on its own rows and on those of its test flag: n, sum and squares, by model and set."""

    def run(batches):
        out = np.zeros((len(models), 2, 4))
        for batch in batches:
            bins, y, flags = _unpacked(batch, n_columns, n_outcomes)
            for i, m in enumerate(models):
                for k, flag in enumerate((m.flag, tests[i])):
                    own = np.flatnonzero((flags >> flag & 1 == 1) & np.isfinite(y[m.outcome]))
                    v, p = y[m.outcome][own], m.predict(bins[:, own])
                    out[i, k] += len(own), v.sum(), (v**2).sum(), ((v - p) ** 2).sum()
        rows = [(i, k, *out[i, k]) for i in range(len(models)) for k in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["m", "held_out", "n", "s", "ss", "e"])

    return binned.mapInArrow(run, "m long, held_out long, n double, s double, ss double, e double").groupBy("m", "held_out").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "e")]).collect()


# ---------------------------------------------------------------- dependence


def dependence(model: Model, columns: tuple[int, int]) -> np.ndarray:
    """The model's mean prediction by the bins of two columns: a tree's branches on other columns count by their rows."""
    one, two = columns
    out = np.full((BINS, BINS), model.base)
    for t in model.trees:

        def below(at: int, t=t) -> np.ndarray:
            c = t.column[at]
            if c < 0:
                return np.full((BINS, BINS), t.value[at])
            low, high = below(2 * at + 1), below(2 * at + 2)
            if c in (one, two):
                side = np.arange(BINS) <= t.cut[at]
                return np.where(side[:, None] if c == one else side[None, :], low, high)
            a, b = t.rows[2 * at + 1], t.rows[2 * at + 2]
            return (a * low + b * high) / max(a + b, 1)

        out += below(0)
    return out


def surface_class(surface: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[str, float, float | None, float, float]:
    """Shape of a surface over a grid: its class, the share (percent) of its variance that no sum of two curves explains, that of its
    logarithm (none unless all is positive), the ratio of the slopes along the rows at the two ends of the columns, and the twist at the centre over the mean size."""
    var = surface.var()
    if var < 1e-10:
        return "FLAT", 0.0, 0.0, 1.0, 0.0

    def left(x):
        centred = x - x.mean(1, keepdims=True) - x.mean(0, keepdims=True) + x.mean()
        return float(centred.var() / x.var() * 100) if x.var() > 1e-10 else 100.0

    added = float((surface - surface.mean(1, keepdims=True) - surface.mean(0, keepdims=True) + surface.mean()).var() / var * 100)
    times = left(np.log(surface)) if (surface > 0).all() else None
    slope = np.abs((surface[-1] - surface[0]) / (rows[-1] - rows[0] + 1e-9))
    gating = float(max(slope[0], slope[-1]) / (min(slope[0], slope[-1]) + 1e-9))
    twist = 0.0
    if min(surface.shape) >= 3:
        i, j = surface.shape[0] // 2, surface.shape[1] // 2
        twist = float((surface[i + 1, j + 1] - surface[i + 1, j - 1] - surface[i - 1, j + 1] + surface[i - 1, j - 1]) / 4 / (np.abs(surface).mean() + 1e-9))
    if added < 5:
        kind = "ADDITIVE"
    elif times is not None and times < 5:
        kind = "MULTIPLICATIVE"
    elif gating > 3:
        kind = "GATED"
    else:
        kind = "SYNERGISTIC" if twist > 0.02 else "SUPPRESSIVE" if twist < -0.02 else "WEAKLY_COUPLED"
    return kind, added, times, gating, twist
