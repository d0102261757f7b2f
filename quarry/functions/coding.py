"""Code lengths, canonical codes, normalised counts, and the clustering of histograms: each on one set of histograms of bounded
size, which Spark has counted over all texts."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable

import numpy as np

#: Longest code, and sum of normalised counts.
LIMIT, TABLE = 15, 4096


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits for the symbols that occur; a single one gets length 1.

    Two queues: symbols by count (of equal ones the larger first), and the nodes in the order that they are made; of equal weights
    the symbol is taken. While the longest code is over the limit, small counts are raised to 1, 3, 7, ...
    """
    lengths = np.zeros(len(counts), np.int64)
    symbols = np.flatnonzero(counts)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    least = 0
    while True:
        weight = np.maximum(counts[symbols], least)
        order = np.lexsort((-symbols, weight))
        leaves = deque(zip(weight[order].tolist(), order.tolist(), strict=True))
        nodes: deque = deque()  # (weight, number); numbers from len(symbols) on
        parts: list[tuple[int, int]] = []

        def smallest():
            return (leaves if leaves and (not nodes or leaves[0][0] <= nodes[0][0]) else nodes).popleft()

        while len(leaves) + len(nodes) > 1:
            (a, left), (b, right) = smallest(), smallest()
            nodes.append((a + b, len(symbols) + len(parts)))
            parts.append((left, right))
        depth = np.zeros(len(symbols) + len(parts), np.int64)
        for k in range(len(parts) - 1, -1, -1):
            depth[list(parts[k])] = depth[len(symbols) + k] + 1
        if depth[: len(symbols)].max() <= limit:
            lengths[symbols] = depth[: len(symbols)]
            return lengths
        least = 2 * least + 1


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol with a length, with its bits reversed: the first bit is the lowest."""
    codes = np.zeros(len(lengths), np.int64)
    symbols = np.flatnonzero(lengths)
    order = symbols[np.lexsort((symbols, lengths[symbols]))]
    size = lengths[order]
    room = np.left_shift(1, LIMIT + 1 - size)
    code = (np.cumsum(room) - room) >> (LIMIT + 1 - size)
    for k in range(LIMIT):
        codes[order] |= np.where(k < size, ((code >> k) & 1) << np.maximum(size - 1 - k, 0), 0)
    return codes


def normalised(counts: np.ndarray, total: int = TABLE) -> np.ndarray:
    """Counts scaled to the total, at least 1 where there are any; what is left goes to the largest one (the last of equals), which
    keeps 1 at least."""
    out = np.where(counts > 0, np.maximum(counts * total // max(1, int(counts.sum())), 1), 0)
    if out.any():
        most = len(out) - 1 - int(np.argmax(out[::-1]))
        out[most] = max(1, out[most] + total - int(out.sum()))
    return out


# ---------------------------------------------------------------- clustering


def entropy_bits(h: np.ndarray) -> np.ndarray:
    """Bits of the ideal code of each histogram (last axis)."""
    n = h.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, n * np.log2(np.maximum(n, 1)), 0.0) - np.where(h > 0, h * np.log2(np.maximum(h, 1)), 0.0).sum(-1)


def prefix_bits(h: np.ndarray) -> float:
    """Bits of the symbols in a prefix code of their own."""
    return float((h * code_lengths(h)).sum())


def divergence(h: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Bits that each histogram takes more with the shares of a fixed one; infinite where that one lacks a symbol."""
    n = fixed.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(h > 0, h * -np.log2(fixed / n), 0.0)
    return np.where(h.sum(-1) > 0, each.sum(-1) - entropy_bits(h), 0.0)


def prefix_population(h: np.ndarray) -> float:
    """Cost of a histogram with a prefix code: its symbols' bits, and a tenth of a bit for each distinct symbol."""
    return prefix_bits(h) + 0.1 * np.count_nonzero(h)


def table_population(h: np.ndarray) -> float:
    """Cost of a histogram with a table of shares: the ideal code's bits, and 5 for each symbol up to the largest; 0 for one symbol."""
    size = int(np.flatnonzero(h)[-1]) + 1 if h.any() else 0
    return float(entropy_bits(h)) + 5.0 * size if size > 1 else 0.0


def spread(h: np.ndarray, most: int, near: float, bits: Callable = entropy_bits, fixed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of histograms (rows): the label of each row, and the clusters' histograms.

    The first seed is the largest row (with fixed clusters, the one farthest from them), then always the row farthest from its nearest seed, until there are
    `most` seeds or that distance is below `near`. The distance of two is what a common code costs more than one for
    each; to a fixed cluster it is the divergence. Then each other row, in order, goes to its nearest cluster, which grows by it,
    unless it is fixed. Empty rows go to cluster 0.
    """
    fixed = np.empty((0, h.shape[1]), h.dtype) if fixed is None else fixed
    many = (lambda x: bits(x)) if bits is entropy_bits else (lambda x: np.array([bits(r) for r in x]))
    own, full = many(h), h.sum(1) > 0
    label = np.where(full, -1, 0)
    if not len(h):
        return label, fixed
    away = np.where(full, np.inf, 0.0)
    for f in fixed:
        away = np.minimum(away, np.maximum(divergence(h, f), 0.0))
    clusters, cost = [f.copy() for f in fixed], [float(many(f[None])[0]) for f in fixed]
    seed = int(np.argmax(away)) if len(fixed) and away.max() > 0 else int(np.argmax(h.sum(1)))
    while len(clusters) < len(fixed) + most and full.any() and label[seed] < 0:
        label[seed], away[seed] = len(clusters), 0.0
        clusters.append(h[seed].copy())
        cost.append(float(own[seed]))
        open_ = np.flatnonzero(away > 0)
        away[open_] = np.minimum(away[open_], many(h[open_] + h[seed]) - own[open_] - own[seed])
        seed = int(np.argmax(away))
        if away[seed] < near:
            break
    for i in np.flatnonzero(label < 0):
        to = np.array([float(divergence(h[i], c)) if k < len(fixed) else 0.0 for k, c in enumerate(clusters)])
        grown = many(np.stack(clusters) + h[i])
        to[len(fixed) :] = grown[len(fixed) :] - own[i] - np.array(cost[len(fixed) :])
        best = int(np.argmin(to))
        if best >= len(fixed):
            clusters[best] += h[i]
            cost[best] = float(grown[best])
        label[i] = best
    return label, np.stack(clusters) if clusters else fixed


def merged(label: np.ndarray, clusters: np.ndarray, cost: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Clusters joined pair by pair while that lowers the total cost: always the pair that lowers it most (ties: the lower numbers).

    A heap holds the pairs that pay, with the time when each was looked at; a pair whose clusters have changed since is dropped
    when it comes up.
    """
    h = {k: c.copy() for k, c in enumerate(clusters)}
    own = {k: cost(c) for k, c in h.items()}
    changed, clock, heap = dict.fromkeys(h, 0), 0, []

    def look(a: int, b: int) -> None:
        gain = cost(h[a] + h[b]) - own[a] - own[b]
        if gain < 0:
            heapq.heappush(heap, (gain, a, b, clock))

    for a in h:
        for b in range(a + 1, len(h)):
            look(a, b)
    into = np.arange(len(clusters))
    while heap:
        _, a, b, when = heapq.heappop(heap)
        if a not in h or b not in h or when < max(changed[a], changed[b]):
            continue
        h[a] += h.pop(b)
        own[a] = cost(h[a])
        into[into == b] = a
        clock += 1
        changed[a] = clock
        for k in h:
            if k != a:
                look(min(a, k), max(a, k))
    return (into[label] if len(into) else label), h and np.stack([h[k] for k in sorted(h)])


def renumbered(label: np.ndarray) -> np.ndarray:
    """Labels by first appearance: 0, 1, ..."""
    seen, first, back = np.unique(label, return_index=True, return_inverse=True)
    order = np.empty(len(seen), np.int64)
    order[np.argsort(first)] = np.arange(len(seen))
    return order[back]
