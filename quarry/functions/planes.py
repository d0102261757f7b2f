"""Whole texts as planes: rasters of equal height side by side, so that a filter is one pass over all of them and sees across the tiles
that its results belong to. The last row is filled up with its last sample."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ..sources.tables import WIDTH
from .rasters import Slice, raster_stage

#: Planes handled at once, in samples.
MOST = 1 << 19


def planes(s: Slice):
    """Rasters and their planes (rasters by rows by columns, from 0 to 1), a height at a time."""
    rows = -(-s.size // WIDTH)
    for height in np.unique(rows[rows > 0]):
        own = np.flatnonzero(rows == height)
        step = max(1, MOST // (int(height) * WIDTH))
        for i in range(0, len(own), step):
            some = own[i : i + step]
            place = np.minimum(np.arange(height * WIDTH), s.size[some][:, None] - 1)
            yield some, s.v[s.start[some][:, None] + place].reshape(len(some), height, WIDTH) / 255.0


def plane_stage(docs: DataFrame, f: Callable[[np.ndarray], tuple], fields: str) -> DataFrame:
    """f over the planes of docs' texts. f gives the plane of each row it makes, or None for one a plane, and the columns of `fields`."""

    def run(s: Slice) -> tuple:
        made: list[tuple] = []
        for own, p in planes(s):
            of, *columns = f(p)
            made.append((own if of is None else own[of], *columns))
        return tuple(np.concatenate(c) for c in zip(*made, strict=True))

    return raster_stage(docs, run, fields)


def digest(x: np.ndarray) -> np.ndarray:
    """Sum over each plane of values in 1024ths, weighted by place: equal digests mean equal planes in practice."""
    x = np.floor(x.reshape(len(x), -1) * 1024 + 0.5).astype(np.int64)
    return (x * (np.arange(x.shape[1]) % 97 + 1)).sum(1)


def padded(p: np.ndarray, by: int, mode: str = "edge") -> np.ndarray:
    """Planes with a border that repeats the edge, or mirrors what is inside it ('symmetric')."""
    if mode == "symmetric" and by > min(p.shape[1:]):
        for k in (1, 2):
            n = p.shape[k]
            at = np.arange(-by, n + by) % (2 * n)
            p = np.take(p, np.where(at < n, at, 2 * n - 1 - at), k)
        return p
    return np.pad(p, ((0, 0), (by, by), (by, by)), mode=mode)


def around(p: np.ndarray, by: int = 1, mode: str = "edge") -> Callable[[int, int], np.ndarray]:
    """at(dy, dx): every sample's neighbour, up to `by` away."""
    wide, (_, h, w) = padded(p, by, mode), p.shape
    return lambda dy, dx: wide[:, by + dy : by + dy + h, by + dx : by + dx + w]


# ---------------------------------------------------------------- filters


def smoothed(p: np.ndarray, side: float, corner: float) -> np.ndarray:
    """The mean of a sample, its sides and its corners, weighted against the sample."""
    at = around(p)
    sides = at(0, -1) + at(0, 1) + at(-1, 0) + at(1, 0)
    corners = at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1)
    return (p + side * sides + corner * corners) / (1 + 4 * (side + corner))


def blurred(p: np.ndarray, taps: tuple[float, ...]) -> np.ndarray:
    """A blur along rows, then along columns; taps from the centre outwards."""
    for axis in (2, 1):
        reach = len(taps) - 1
        wide = np.pad(p, [(0, 0)] + [(reach, reach) if k == axis else (0, 0) for k in (1, 2)], mode="edge")
        part = lambda k, wide=wide, axis=axis, n=p.shape[axis], reach=reach: np.take(wide, np.arange(reach + k, reach + k + n), axis)
        p = taps[0] * part(0) + sum(taps[k] * (part(-k) + part(k)) for k in range(1, len(taps)))
    return p


def gradients(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sobel gradients across and down, and their length; 0 at the border."""
    at = around(p)
    across = (at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1))
    down = (at(1, -1) + 2 * at(1, 0) + at(1, 1)) - (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1))
    inner = np.zeros(p.shape, bool)
    inner[:, 1:-1, 1:-1] = True
    across, down = np.where(inner, across, 0.0), np.where(inner, down, 0.0)
    return across, down, np.sqrt(across * across + down * down)


def maxima(across: np.ndarray, down: np.ndarray, length: np.ndarray, least: float) -> np.ndarray:
    """Inner samples whose gradient is at least `least` and no shorter than the two next to it along its direction (of four)."""
    at = around(length)
    flat, steep = np.abs(across) > 2 * np.abs(down), np.abs(down) > 2 * np.abs(across)
    same = np.signbit(across) == np.signbit(down)
    pick = lambda a, b, c, d: np.where(flat, a, np.where(steep, b, np.where(same, c, d)))
    one = pick(at(0, -1), at(-1, 0), at(-1, -1), at(-1, 1))
    two = pick(at(0, 1), at(1, 0), at(1, 1), at(1, -1))
    inner = np.zeros(length.shape, bool)
    inner[:, 1:-1, 1:-1] = True
    return inner & (length >= least) & (length >= one) & (length >= two)


def ridges(p: np.ndarray, mask: np.ndarray, least: float, ratio: float) -> np.ndarray:
    """Samples of the mask where the plane bends much one way (at least `least`) and `ratio` times less the other."""
    at = around(p)
    xx, yy = at(0, 1) - 2 * p + at(0, -1), at(1, 0) - 2 * p + at(-1, 0)
    xy = 0.25 * (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1))
    half, det = (xx + yy) * 0.5, xx * yy - xy * xy
    disc = half * half - det
    root = np.sqrt(np.maximum(disc, 0.0))
    one, two = np.abs(half + root), np.abs(half - root)
    big, small = np.maximum(one, two), np.minimum(one, two)
    return mask & (disc >= 0) & (big >= least) & (small * ratio <= big)


def box_means(p: np.ndarray, factor: int) -> np.ndarray:
    """Means of boxes; those at the lower and right edge hold what is left."""
    rows, columns = np.arange(0, p.shape[1], factor), np.arange(0, p.shape[2], factor)
    n = np.outer(np.diff([*rows, p.shape[1]]), np.diff([*columns, p.shape[2]]))
    return np.add.reduceat(np.add.reduceat(p, rows, 1), columns, 2) / n


def laplacian(p: np.ndarray) -> np.ndarray:
    at = around(p)
    return 4 * p - at(-1, 0) - at(1, 0) - at(0, -1) - at(0, 1)


def pyramid(p: np.ndarray, levels: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Details of each level and what is left: a level is blurred and every second sample kept; its detail is what these, repeated,
    do not give back."""
    out = []
    for _ in range(levels):
        small = blurred(p, (0.5, 0.25))[:, ::2, ::2]
        rows, columns = np.arange(p.shape[1]) * small.shape[1] // p.shape[1], np.arange(p.shape[2]) * small.shape[2] // p.shape[2]
        out.append(p - small[:, rows][:, :, columns])
        p = small
    return out, p


#: Fixed values of the edge-preserving filter: scale of the quantiser, of the inverse deviation, of the channel's differences, of the step, and at the border of blocks; below the least inverse deviation nothing is filtered.
QUANT_SCALE, INVERSE_SCALE, CHANNEL_SCALE, STEP_SCALE, BORDER_SCALE, LEAST_INVERSE = 0.46, -1.1715729, 5.0, 1.65, 2.0 / 3.0, -3.9052429


def inverse_deviations(quant: np.ndarray, sharpness: np.ndarray, scale: float) -> np.ndarray:
    """Of each block, by its quantiser and sharpness (0 to 7): negative, and -10000 for no sharpness."""
    return 1.0 / np.minimum(QUANT_SCALE / (scale * quant * INVERSE_SCALE) * (np.minimum(sharpness, 7) / 7), -1e-4)


def edge_preserved(p: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Samples drawn towards their four neighbours, each as far as its cross of five samples is like the sample's own; inverse: a value a
    block of 8 by 8 samples."""
    at = around(p, 2, "symmetric")
    h, w = p.shape[1:]
    own = np.repeat(np.repeat(inverse, 8, 1), 8, 2)[:, :h, :w]
    edge = lambda n: np.isin(np.arange(n) % 8, (0, 7))
    own_scaled = own * STEP_SCALE * np.where(edge(h)[:, None] | edge(w)[None], BORDER_SCALE, 1.0)
    total, out = np.ones_like(p), p.copy()
    for dy, dx in ((0, -1), (-1, 0), (1, 0), (0, 1)):
        apart = sum(np.abs(at(y, x) - at(dy + y, dx + x)) for y, x in ((0, 0), (-1, 0), (0, -1), (1, 0), (0, 1))) * CHANNEL_SCALE
        weight = np.maximum(apart * own_scaled + 1, 0.0)
        total += weight
        out += weight * at(dy, dx)
    return np.where(own < LEAST_INVERSE, p, out / total)


# ---------------------------------------------------------------- blobs

#: Taps of the noise filter and of the background filter (applied twice); border around a blob for its background; window of a blob.
NOISE, BACKGROUND, EXTRA, WINDOW = (0.558311, 0.210395, 0.010449), (0.222338, 0.210431, 0.1784), 4, 5
#: Largest component.
MOST_PIXELS = 1000


def energy(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared difference of the planes without noise and without blobs; and the planes without noise."""
    smooth = blurred(p, NOISE)
    ground = blurred(blurred(p, BACKGROUND), BACKGROUND)
    return (smooth - ground) ** 2, smooth


def components(e: np.ndarray, low: float, high: float) -> list[np.ndarray]:
    """Samples (row, column) of each component of one plane: it begins at a sample above `high` and grows over those of its eight neighbours that
    are above `low`. In the order of their first samples; those over MOST_PIXELS are left out."""
    open_ = e > low
    out = []
    for y, x in np.argwhere(e > high).tolist():
        if not open_[y, x]:
            continue
        open_[y, x] = False
        found, queue = [(y, x)], deque([(y, x)])
        while queue:
            a, b = queue.popleft()
            for c in range(max(a - 1, 0), min(a + 2, e.shape[0])):
                for d in range(max(b - 1, 0), min(b + 2, e.shape[1])):
                    if open_[c, d]:
                        open_[c, d] = False
                        found.append((c, d))
                        queue.append((c, d))
        if len(found) <= MOST_PIXELS:
            out.append(np.array(found))
    return out


def component_stats(e: np.ndarray, own: np.ndarray) -> dict:
    """Box of a component; the sample of most energy in the box and its border; mean inside the box and out; the score: how many
    deviations of the border the inside stands out."""
    (top, left), (bottom, right) = own.min(0), own.max(0)
    y0, x0 = max(top - EXTRA, 0), max(left - EXTRA, 0)
    near = e[y0 : bottom + EXTRA + 1, x0 : right + EXTRA + 1]
    inside = np.zeros(near.shape, bool)
    inside[top - y0 : bottom - y0 + 1, left - x0 : right - x0 + 1] = True
    place = np.unravel_index(int(np.argmax(near)), near.shape)
    rest = near[~inside]
    mean, ground = float(near[inside].mean()), float(rest.mean()) if len(rest) else 0.0
    spread = float((rest**2).mean() - ground**2) if len(rest) else 0.0
    return {"top": int(top), "left": int(left), "height": int(bottom - top + 1), "width": int(right - left + 1), "pixels": len(own), "mode_y": int(place[0] + y0), "mode_x": int(place[1] + x0), "mean": mean, "ground": ground, "score": (mean - ground) / spread**0.5 if spread > 0 else 0.0}


def ellipse(p: np.ndarray, smooth: np.ndarray, mode: tuple[int, int]) -> tuple[float, float, float, float, float, float, float]:
    """Centre, the two variances (the larger first), angle and intensity of the Gaussian blob at a sample, by the moments of what stands out there of the smooth
    plane; and its mean squared error there."""
    y, x = np.mgrid[max(mode[0] - 2, 0) : min(mode[0] + 3, p.shape[0]), max(mode[1] - 2, 0) : min(mode[1] + 3, p.shape[1])]
    apart = p[y, x] - smooth[y, x]
    sign = 1.0 if p[mode] - smooth[mode] > 0 else -1.0
    weight = np.maximum(sign * apart, 1e-6)
    weight = weight / weight.sum()
    cx, cy = float((weight * x).sum()), float((weight * y).sum())
    xx, xy, yy = (float((weight * a * b).sum()) - c for a, b, c in ((x, x, cx * cx), (x, y, cx * cy), (y, y, cy * cy)))
    root = max((xx - yy) ** 2 + 4 * xy * xy, 0.0) ** 0.5
    large, small = (xx + yy + root) / 2, max((xx + yy - root) / 2, 1e-12)
    angle = 0.5 * float(np.arctan2(2 * xy, xx - yy))
    rx, ry = np.cos(angle) * (x - cx) + np.sin(angle) * (y - cy), -np.sin(angle) * (x - cx) + np.cos(angle) * (y - cy)
    shape = np.exp(-0.5 * (rx * rx / max(large, 1e-12) + ry * ry / small))
    intensity = float((shape * apart).sum() / ((shape * shape).sum() + 1e-6))
    return cx, cy, large, small, angle, intensity, float(((apart - intensity * shape) ** 2).mean())
