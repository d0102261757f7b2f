"""Quality classifier by positive-unlabelled learning.

A logistic model over form features of the text (shares of bytes and of byte-class pairs, word and line statistics)
minimises the non-negative unbiased risk

    pi R_P(+) + max(0, R_U(-) - pi R_P(-))

of trusted positives P and unlabelled documents U. If the bracket falls below 0, a step is taken up its gradient, as in the
non-negative estimator's algorithm. The class prior pi, the share of positives in U, is estimated from P and U alone: a
model that tells P from U is fitted on one half of the documents, and of the scores in the other half the best bin is taken, the
top scores where U has the smallest share of what P has, with a margin for the sizes. Labels of negatives are not used.
Features are made where the text is; only those of a bounded sample reach the driver, and only the weights are sent out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, batch_column, first_of_row, map_arrow, release, slices, span_hashes, text_buffers, word_spans

#: Classes of bytes whose pairs are counted: letters by case, digits, white space, each other visible sign, non-ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[0x20, 0x09, 0x0B, 0x0C]] = 4
_CLASS[[0x0A, 0x0D]] = 5
_CLASS[128:] = 6
for _k, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[ord(_c)] = 7 + _k
N_CLASSES = 7 + 32
_N_STATS = 11
N_FEATURES = N_CLASSES + N_CLASSES * N_CLASSES + _N_STATS


def _pieces_stats(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Share of pieces (words, lines) of each row that repeat an earlier one of the row."""
    total = np.bincount(row, minlength=n)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    again = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=n) if len(h) else np.zeros(n)
    return again / np.maximum(total, 1)


def features(column: pa.Array):
    """Feature matrices (float32) for slices of the rows."""
    raw, offsets = text_buffers(column)
    for a, b in slices(offsets, 1 << 18):  # a slice takes some hundred times its bytes, in counts of pairs and byte positions
        own, part = offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]
        n, size = b - a, np.diff(own)
        row = first_of_row(own, len(part))
        kind = _CLASS[part]
        single = np.bincount(row * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        same = row[1:] == row[:-1]
        pair = np.bincount(row[1:][same] * N_CLASSES**2 + kind[:-1][same] * N_CLASSES + kind[1:][same], minlength=n * N_CLASSES**2).reshape(n, -1)
        starts, ends, first = word_spans(part, own, SPACED)
        words = np.diff(first)
        word_row = np.repeat(np.arange(n), words)
        length = ends - starts
        mean = np.bincount(word_row, length, n) / np.maximum(words, 1)
        spread = np.sqrt(np.maximum(0, np.bincount(word_row, length.astype(float) ** 2, n) / np.maximum(words, 1) - mean**2))
        hashes = span_hashes(part, starts, ends)
        stutter = np.bincount(word_row[1:][(hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])], minlength=n) / np.maximum(words, 1)
        line = np.ones(256, bool)
        line[[0x0A, 0x0D]] = False
        l_starts, l_ends, l_first = word_spans(part, own, line)
        lines = np.diff(l_first)
        stats = np.stack(
            [
                np.log1p(size), np.log1p(words), mean / 10, spread / 10, np.log1p(mean * 0 + np.bincount(word_row, length > 20, n)) / 4,
                _pieces_stats(hashes, word_row, n), stutter, np.log1p(lines),
                _pieces_stats(span_hashes(part, l_starts, l_ends), np.repeat(np.arange(n), lines), n),
                np.log1p(words / np.maximum(lines, 1)) / 4, (size == 0).astype(float),
            ],
            1,
        )
        scale = np.maximum(size, 1)[:, None]
        yield np.concatenate([np.sqrt(single / scale), np.sqrt(pair / scale), stats], 1).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk with the logistic loss: that of positives, and the bracket."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean()) - prior * float(np.logaddexp(0, zp).mean())


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step goes down: the risk's slope by each score; where the bracket is below 0, that of minus the bracket."""
    back, gu = prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    if risk(zp, zu, prior)[1] < 0:
        return back, -gu
    return prior * (_sigmoid(zp) - 1) / len(zp) - back, gu


def standardise(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of the features; both samples (float32) are overwritten, so that they are held once."""
    count = len(positive) + len(unlabelled)
    mean = ((positive.sum(0, np.float64) + unlabelled.sum(0, np.float64)) / count).astype(np.float32)
    square = np.zeros(len(mean))
    for x in (positive, unlabelled):
        x -= mean
        for k in range(0, len(x), 1024):
            square += np.square(x[k : k + 1024]).sum(0, np.float64)
    scale = (np.sqrt(square / count) + 1e-2).astype(np.float32)
    for x in (positive, unlabelled):
        x /= scale
    return mean, scale


def descend(p: np.ndarray, u: np.ndarray, slope, steps: int, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam; slope(zp, zu) gives what a step goes down by each score."""
    w, bias = np.zeros(p.shape[1], np.float32), np.float32(0)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        cp, cu = slope(p @ w + bias, u @ w + bias)
        grad = np.append(p.T @ cp.astype(np.float32) + u.T @ cu.astype(np.float32) + decay * w, cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = (w - step[:-1]).astype(np.float32), np.float32(bias - step[-1])
    return w, float(bias)


def best_bin(zp: np.ndarray, zu: np.ndarray, gamma: float = 0.01, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores of rows that the scoring model has not seen."""
    at = np.unique(zp)[::-1]
    qp = (len(zp) - np.searchsorted(np.sort(zp), at)) / len(zp)
    qu = (len(zu) - np.searchsorted(np.sort(zu), at)) / len(zu)
    margin = np.sqrt(np.log(4 / delta) / (2 * len(zu))) + np.sqrt(np.log(4 / delta) / (2 * len(zp)))
    k = int(np.argmin((qu + (1 + gamma) * margin) / qp))
    return float(np.clip(qu[k] / qp[k], 0.01, 0.99))


def estimate_prior(p: np.ndarray, u: np.ndarray, p_half: np.ndarray, u_half: np.ndarray, steps: int = 100) -> float:
    """The prior by best_bin; the halves (booleans) say which standardised rows the scoring model is fitted on. 0.5 if a part is empty."""
    if not all(x.any() for x in (p_half, ~p_half, u_half, ~u_half)):
        return 0.5
    w, _ = descend(p[p_half], u[u_half], lambda zp, zu: ((_sigmoid(zp) - 1) / len(zp), _sigmoid(zu) / len(zu)), steps, decay=1e-3)
    return best_bin(p[~p_half] @ w, u[~u_half] @ w)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, halves: tuple | None = None, steps: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, and the mean and scale of features, and bias. Both samples are overwritten. Without a prior it is estimated,
    with halves (booleans for the rows of each sample)."""
    mean, scale = standardise(positive, unlabelled)
    if prior is None:
        prior = estimate_prior(positive, unlabelled, *halves)
    w, bias = descend(positive, unlabelled, lambda zp, zu: slopes(zp, zu, prior), steps)
    return w, mean, scale, bias


def _rows(sample: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a sample of `most` rows at most, in the order of doc_id, and half of them by doc_id. They travel
    compressed: most are 0."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate(list(features(batch_column(batch, "text"))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary())], names=["doc_id", "x"])

    if sample.select("doc_id").limit(most + 1).count() > most:  # rows that repeat a chosen doc_id; else the hash keeps to the bound
        sample = sample.limit(most)
    found = sorted(map_arrow(sample.select("doc_id", "text"), f, "doc_id string, x binary").collect())
    out = np.empty((len(found), N_FEATURES), np.float32)
    for k, r in enumerate(found):
        out[k] = np.frombuffer(zlib.decompress(r["x"]), np.float32)
    return out, np.array([zlib.crc32(f"half {r['doc_id']}".encode()) & 1 == 0 for r in found], bool)


def train(docs: DataFrame, labels: DataFrame, eligible, most_positive: int = 4000, most_unlabelled: int = 8000) -> tuple | None:
    """Fit on rows of docs (doc_id, text) for which the column `eligible` is true; labels has doc_id, quality.

    At most most_positive rows labelled 1, and twice most_unlabelled of all rows (most_unlabelled are expected), are used, chosen
    by a hash of doc_id. None if there is nothing to learn from.
    """
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    labels = labels.filter("doc_id IS NOT NULL AND quality = 1").filter(eligible)
    chosen = labels.select("doc_id").distinct().orderBy(rank, "doc_id").limit(most_positive)
    docs = docs.filter(eligible).filter("doc_id IS NOT NULL")
    total = docs.select("doc_id").count()
    part = min(1.0, most_unlabelled / max(1, total))
    positive, p_half = _rows(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), most_positive)
    unlabelled, u_half = _rows(docs.filter(F.pmod(rank, F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))), 2 * most_unlabelled)
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, halves=(p_half, u_half))


def score(docs: DataFrame, labels: DataFrame, eligible=None, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, text) and all their columns, with score (0 to 1) and predicted (1 if score >= threshold).

    Null texts are scored as empty ones, repeated rows alike, texts of any length whole. Without a row labelled 1 all scores are
    0.5; an empty table gives no rows; a null doc_id is scored, and not learned from. Columns of docs named score or predicted
    are replaced (see common.beside to keep them).
    """
    model = train(docs, labels, F.lit(True) if eligible is None else eligible)
    release()  # the sample's features
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        if shared.value is None:
            s = np.full(batch.num_rows, 0.5)
        else:
            w, mean, scale, bias = shared.value
            z = np.concatenate([((x - mean) / scale) @ w + bias for x in features(batch_column(batch, "text"))]).astype(np.float64)
            s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return map_arrow(docs.select(*kept), f, schema)
