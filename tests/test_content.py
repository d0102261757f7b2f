"""Content features against loops over pixels."""

import math

import numpy as np

from quarry.functions.rasters import Slice
from quarry.operators import content


def plain(p):
    """The features of one picture (rows by columns by channels), pixel by pixel."""
    h, w, _ = p.shape
    pixels = p.reshape(-1, 3).astype(float)
    rg, yb = pixels[:, 0] - pixels[:, 1], (pixels[:, 0] + pixels[:, 1]) / 2 - pixels[:, 2]
    m3 = math.sqrt(rg.var() + yb.var()) + 0.3 * math.sqrt(rg.mean() ** 2 + yb.mean() ** 2)
    luma = [[0.299 * p[y, x, 0] + 0.587 * p[y, x, 1] + 0.114 * p[y, x, 2] for x in range(w)] for y in range(h)]
    y_ = [[math.floor(v + 0.5) for v in row] for row in luma]
    flat = masks = None
    flat, masks = [], []
    for by in range(h // 8):
        for bx in range(w // 8):
            block = p[by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8]
            flat.append(all(block[..., c].max() - block[..., c].min() <= 4 for c in range(3)))
            total = 0.0
            for y in range(by * 8, by * 8 + 8):
                for x in range(bx * 8, bx * 8 + 8):
                    near = [y_[max(y - 1, 0)][x], y_[min(y + 1, h - 1)][x], y_[y][max(x - 1, 0)], y_[y][min(x + 1, w - 1)]]
                    total += 100 / (math.log(1 + abs(y_[y][x] - sum(near) / 4)) + 0.01)
            masks.append(total / 64)
    masks.sort()
    edges = []
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            a = [[y_[y + i][x + j] for j in (-1, 0, 1)] for i in (-1, 0, 1)]
            gx = a[0][2] + 2 * a[1][2] + a[2][2] - a[0][0] - 2 * a[1][0] - a[2][0]
            gy = a[2][0] + 2 * a[2][1] + a[2][2] - a[0][0] - 2 * a[0][1] - a[0][2]
            edges.append(math.hypot(gx, gy) > 30)
    counts = np.bincount(p.ravel(), minlength=256)
    share = counts[counts > 0] / counts.sum()
    pick = lambda q: masks[math.floor(q * (len(masks) - 1) + 0.5)] if masks else 0.0
    mean = lambda x: sum(x) / len(x) if x else 0.0
    values = np.array(luma)
    return [m3, mean(flat), mean(edges), values.var(), pick(0.25), pick(0.5), pick(0.75), values.mean(), h * w, w / h, 3, -(share * np.log2(share)).sum()]


def test_features_equal_a_loop():
    rng = np.random.default_rng(1)
    for h in (1, 2, 7, 8, 19):
        p = rng.integers(0, 256, (2, h, 32, 3))
        p[1, :, :16] = 90
        got = content.features(p)
        for k in range(2):
            assert np.allclose([x[k] for x in got], plain(p[k])), h


def test_plain_and_checked_pictures():
    grey = np.full((1, 32, 32, 3), 128)
    f = dict(zip(content.COLUMNS, (float(x[0]) for x in content.features(grey)), strict=True))
    assert f["m3_colourfulness"] < 0.01 and f["flat_blocks"] == 1 and f["edge_density"] == 0 and f["mask_median"] > 5000 and f["n_pixels"] == 1024 and f["aspect"] == 1
    y, x = np.mgrid[:32, :32]
    check = np.repeat((((x // 4 + y // 4) % 2) * 255)[None, ..., None], 3, 3)
    f = dict(zip(content.COLUMNS, (float(v[0]) for v in content.features(check)), strict=True))
    assert f["edge_density"] > 0.05 and f["flat_blocks"] < 0.5 and f["m3_colourfulness"] < 1


def test_colour_planes():
    sizes = [2, 3, 96, 99, 200]
    v = np.arange(sum(sizes)) % 256
    s = Slice(v, np.array(sizes))
    seen = {k: p for own, planes_ in content.colour_planes(s) for k, p in zip(own.tolist(), planes_, strict=True)}
    assert set(seen) == {1, 2, 3, 4}
    for k, p in seen.items():
        own = v[s.start[k] : s.start[k] + sizes[k] // 3 * 3].reshape(-1, 3)
        flat = p.reshape(-1, 3)
        assert len(flat) % 32 == 0 and np.array_equal(flat[: len(own)], own) and (flat[len(own) :] == own[-1]).all()
