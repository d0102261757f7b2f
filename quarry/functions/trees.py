"""Decision trees over the residuals of rasters: properties of a sample, their bins, the split that saves most bits, depth limits,
numbering. A tree is a dict from path to node; a path says for each level whether the property is within the threshold (0) or above it (1)."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from .rasters import Slice, clamped_gradient, zigzag

#: Predictors that a leaf can have; the first one is the root's.
CHOICES = ("gradient", "west", "north", "average0")
PROPERTIES = ("y", "x", "abs_n", "abs_w", "n", "w", "w_over_gradient", "gradient", "w_nw", "nw_n", "n_ne", "n_nn", "w_ww")
#: Most bins of a property, and tokens of a residual.
BINS, TOKENS = 16, 64
#: A property's values lie within these bounds.
LOW, HIGH = -512, 512


@dataclass(frozen=True)
class Node:
    """A leaf where prop is None. `bin` is the last one of the lower side, `threshold` the largest value of the property there."""

    predictor: int
    n: int
    bits: float
    prop: int | None = None
    bin: int = 0
    threshold: int = 0
    saved: float = 0.0


def properties(s: Slice, a: dict[str, np.ndarray]) -> np.ndarray:
    """The properties of every sample, a row for each. A first sample's left gradient is 0; x and y stop at the upper bound."""
    n, w, nw = a["n"], a["w"], a["nw"]
    gradient = w + n - nw
    before = np.zeros_like(gradient)
    before[1:] = gradient[:-1]
    before[s.x == 0] = 0
    out = np.empty((len(PROPERTIES), len(s.v)), np.int16)
    for k, x in enumerate((s.y, s.x, np.abs(n), np.abs(w), n, w, w - before, gradient, w - nw, nw - n, n - a["ne"], n - a["nn"], w - a["ww"])):
        out[k] = np.clip(x, LOW, HIGH)
    return out


def token_bits(token: np.ndarray) -> np.ndarray:
    """Raw bits that follow a token."""
    return np.where(token < 16, 0, (token - 16) // 8 + 1)


def residual_tokens(s: Slice, a: dict[str, np.ndarray]) -> np.ndarray:
    """Token of each sample's residual, a row for each choice of predictor: itself below 16, else its exponent, its next and its two last bits."""
    guess = {"gradient": clamped_gradient(a["n"], a["w"], a["nw"]), "west": a["w"], "north": a["n"], "average0": (a["w"] + a["n"]) >> 1}
    most = int(max(x.max() for x in (s.v, *guess.values())) - min(x.min() for x in (s.v, *guess.values()))) if len(s.v) else 0
    u = zigzag(np.arange(-most, most + 1))
    e = np.frexp(np.maximum(u, 1).astype(np.float64))[1] - 1
    token = np.where(u < 16, u, 16 + (e - 4) * 8 + ((u >> np.maximum(e - 1, 0)) & 1) * 4 + (u & 3))
    out = np.empty((len(CHOICES), len(s.v)), np.int64)
    for k, c in enumerate(CHOICES):
        out[k] = token[s.v - guess[c] + most]
    return out


def thresholds(counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper ends of all bins but the last, from the counts of the values LOW to HIGH: a bin ends where another of `bins` equal shares is full."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    share = np.cumsum(counts) * bins // total
    return (np.flatnonzero(np.diff(share, prepend=0) > 0) + LOW)[:-1]


def estimated_bits(counts: np.ndarray) -> np.ndarray:
    """Bits of the tokens (last axis) in a table of 4096: no share is less than one of them, and a single token takes none."""
    total = counts.sum(-1, keepdims=True)
    share = np.maximum(counts / np.maximum(total, 1), 1 / 4096)
    return -np.where((counts == total) | (counts == 0), 0.0, counts * np.log2(share)).sum(-1)


def best_split(counts: np.ndarray, predictor: int, threshold: float) -> tuple | None:
    """(prop, bin, lower and upper side's predictor, samples, bits) of the split that costs least, or None if it does not save more than the
    threshold. counts: tokens by predictor, property and bin. Each side takes the predictor of least cost, where one other than the
    node's is charged for the change (that charge is no cost of the split). Of equal ones: the first property, the lowest bin."""
    raw = token_bits(np.arange(counts.shape[-1]))
    whole = counts[:, 0].sum(1)
    base = float(estimated_bits(whole)[predictor] + (whole[predictor] * raw).sum())
    if base <= threshold:
        return None
    lower = np.cumsum(counts, 2)
    upper = whole[:, None, None] - lower
    charge = np.where(np.arange(len(counts)) == predictor, 0.0, 800 / (100 + threshold))
    sides = []
    for side in (lower, upper):
        cost = estimated_bits(side) + (side * raw).sum(-1)
        pick = np.argmin(cost + charge[:, None, None], 0)
        sides.append((np.take_along_axis(cost, pick[None], 0)[0], pick))
    there = counts[0].sum(-1)  # property by bin
    last = there.shape[1] - 1 - np.argmax(there[:, ::-1] > 0, 1)
    open_ = (there > 0) & (np.arange(there.shape[1]) < last[:, None])
    cost = np.where(open_, sides[0][0] + sides[1][0], np.inf)
    prop, b = np.unravel_index(int(np.argmin(cost)), cost.shape)
    if not cost[prop, b] + threshold < base:
        return None
    n = int(lower[0, prop, b].sum())
    return (int(prop), int(b), *((int(p[prop, b]), k, float(c[prop, b])) for (c, p), k in zip(sides, (n, int(whole[0].sum()) - n), strict=True)), base)


def capped(tree: dict[str, Node], depth: int) -> dict[str, Node]:
    """No node lies deeper than `depth`: a split there becomes a leaf with the predictor of its lowest descendant."""
    out = {}
    for path, node in tree.items():
        if len(path) > depth:
            continue
        if len(path) == depth and node.prop is not None:
            low = path
            while tree[low].prop is not None:
                low += "0"
            node = replace(node, predictor=tree[low].predictor, prop=None)
        out[path] = node
    return out


def numbered(tree: dict[str, Node]) -> list[tuple[str, Node, int | None]]:
    """Nodes level by level, the lower side (the right child) first, with the context of each leaf: 0, 1, ... in that order."""
    out, context = [], 0
    for path in sorted(tree, key=lambda p: (len(p), p)):
        leaf = tree[path].prop is None
        out.append((path, tree[path], context if leaf else None))
        context += leaf
    return out


def joined(trees: list[dict[str, Node]], part: int) -> dict[str, Node]:
    """One tree over several parts: splits on the part's number (property `part`), by halves, above the parts' own trees."""
    if len(trees) == 1:
        return dict(trees[0])
    half = len(trees) // 2
    out = {"": Node(0, sum(t[""].n for t in trees), sum(t[""].bits for t in trees), part, half - 1, half - 1)}

    def below(own: list, first: int, path: str) -> None:
        if len(own) == 1:
            out.update({path + p: x for p, x in own[0].items()})
            return
        h = len(own) // 2
        out[path] = Node(0, sum(t[""].n for t in own), sum(t[""].bits for t in own), part, first + h - 1, first + h - 1)
        below(own[:h], first, path + "0")
        below(own[h:], first + h, path + "1")

    below(trees, 0, "")
    return out
