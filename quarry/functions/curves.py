"""Curves of scores over a setting: pooled so that they rise, read at a setting or for a score, and searched step by step; rank measures
of two columns; distance of two fronts. Each on one group of bounded size."""

from __future__ import annotations

import math

import numpy as np

#: A score this near the target will do; steps of a search; least and largest setting.
NEAR, STEPS, LEAST, MOST = 0.5, 8, 1.0, 100.0


def risen(s: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest rising values: neighbours that fall are pooled to their mean."""
    means, sizes, members = [], [], []
    for v, w in zip(s.tolist(), weight.tolist(), strict=True):
        means.append(v)
        sizes.append(w)
        members.append(1)
        while len(means) > 1 and means[-2] > means[-1]:
            v, w, m = means.pop(), sizes.pop(), members.pop()
            means[-1] = (means[-1] * sizes[-1] + v * w) / (sizes[-1] + w)
            sizes[-1] += w
            members[-1] += m
    return np.repeat(means, members)


def setting_for(q: np.ndarray, s: np.ndarray, target: float) -> float | None:
    """The lowest setting whose score is the target, between two known ones in proportion; none if no score reaches it."""
    if s[-1] < target:
        return None
    i = int(np.searchsorted(s, target, "left"))
    if i == 0:
        return float(q[0])
    return float(q[i]) if s[i] == s[i - 1] else float(q[i - 1] + (target - s[i - 1]) / (s[i] - s[i - 1]) * (q[i] - q[i - 1]))


def first_guess(target: float) -> float:
    return min(max(40 + 0.58 * target, LEAST), MOST)


def search(q: np.ndarray, s: np.ndarray, target: float, start: float) -> tuple[float, float, bool, int]:
    """A search for the least setting that reaches the target (to within NEAR), which asks for one score a step: setting, score, whether
    it is reached, steps. Between a setting too low and one too high it takes the secant, a tenth of the gap off either at least; else it
    goes on by a fifth more than what is missing, 4 at least; settings are whole."""
    at = min(max(start, LEAST), MOST)
    low = high = reached = None
    nearest, steps = (at, math.inf), 0
    while steps < STEPS:
        score = float(np.interp(at, q, s))
        steps += 1
        if steps == 1 or abs(score - target) < abs(nearest[1] - target):
            nearest = at, score
        if score >= target - NEAR and (reached is None or at < reached[0]):
            reached = at, score
        if abs(score - target) <= NEAR:
            break
        if score < target:
            low = at, score
        else:
            high = at, score
        if low and high:
            gap = high[0] - low[0]
            if gap <= 1:
                break
            rise = high[1] - low[1]
            following = low[0] + ((target - low[1]) / rise * gap if abs(rise) > 1e-9 else gap / 2)
            following = min(max(following, low[0] + gap * 0.1), high[0] - gap * 0.1)
        elif low:
            following = min(low[0] + max((target - low[1]) * 1.2, 4.0), MOST)
            if following <= low[0] + 0.5:
                break
        else:
            following = max(high[0] - max((high[1] - target) * 1.2, 4.0), LEAST)
            if following >= high[0] - 0.5:
                break
        following = min(max(float(round(following)), LEAST), MOST)
        if abs(following - at) < 0.5:
            break
        at = following
    return (*reached, True, steps) if reached else (*nearest, False, steps)


# ---------------------------------------------------------------- ranks


def mean_ranks(x: np.ndarray) -> np.ndarray:
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    upto = np.cumsum(n)
    return (upto - (n - 1) / 2)[back]


def inversions(x: np.ndarray) -> int:
    """Pairs of which the first is larger, by merging sorted halves."""
    runs, width, total = x.copy(), 1, 0
    while width < len(runs):
        for a in range(0, len(runs) - width, 2 * width):
            left, right = runs[a : a + width], runs[a + width : a + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, "right")).sum())
            runs[a : a + 2 * width] = np.sort(runs[a : a + 2 * width], kind="stable")
        width *= 2
    return total


def tied(*columns: np.ndarray) -> int:
    """Pairs that are equal in all columns."""
    n = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
    return int((n * (n - 1) // 2).sum())


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    dx, dy = x - x.mean(), y - y.mean()
    size = math.sqrt(float((dx * dx).sum()) * float((dy * dy).sum()))
    return float((dx * dy).sum()) / size if size > 0 else None


def panel(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """Linear, rank and pair (tau-b) correlation; none where a column is constant."""
    order = np.lexsort((y, x))
    pairs, tx, ty = len(x) * (len(x) - 1) // 2, tied(x), tied(y)
    if pairs == tx or pairs == ty:
        return None, None, None
    against = inversions(np.unique(y, return_inverse=True)[1][order])  # equal x come by y, so they add none
    for_ = pairs - tx - ty + tied(x, y) - against
    return correlation(x, y), correlation(mean_ranks(x), mean_ranks(y)), (for_ - against) / math.sqrt((pairs - tx) * (pairs - ty))


# ---------------------------------------------------------------- fronts


def front(cost: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Places of the points that no other beats (no more cost, no less gain, one of them better), by cost; one of equal points."""
    order = np.lexsort((-gain, cost))
    best = np.maximum.accumulate(np.concatenate([[-np.inf], gain[order][:-1]]))
    return order[gain[order] > best]


def farthest_nearest(a: np.ndarray, b: np.ndarray) -> float:
    """The largest distance of a point of a (x, y; by x) to its nearest of b: outwards from its place among b's x, as far as x alone is nearer
    than the best so far."""
    at = np.searchsorted(b[:, 0], a[:, 0])
    best = np.full(len(a), np.inf)
    for step in range(len(b) + 1):
        open_ = False
        for place in (at + step, at - 1 - step):
            ok = (place >= 0) & (place < len(b))
            own = b[np.clip(place, 0, len(b) - 1)]
            apart = np.where(ok, np.abs(own[:, 0] - a[:, 0]), np.inf)
            near = apart <= best
            open_ |= bool((near & ok).any())
            best = np.where(near & ok, np.minimum(best, np.hypot(apart, own[:, 1] - a[:, 1])), best)
        if not open_:
            break
    return float(best.max())
