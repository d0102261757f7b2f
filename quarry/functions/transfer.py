"""Sample arithmetic as column expressions: transfer functions, colour spaces, quality curves. Each is a template of an SQL
expression with the arguments in braces, for F.expr."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the published transfer functions (sRGB, ST 2084, BT.2100, BT.709).
SRGB = "CASE WHEN {v} <= 0.04045D THEN {v} / 12.92D ELSE pow(({v} + 0.055D) / 1.055D, 2.4D) END"
_N = "pow(greatest({v}, 0D), 1D / 78.84375D)"
PQ = f"pow(greatest({_N} - 0.8359375D, 0D) / (18.8515625D - 18.6875D * {_N}), 1D / 0.1593017578125D)"
HLG = "CASE WHEN greatest({v}, 0D) <= 0.5D THEN greatest({v}, 0D) * greatest({v}, 0D) / 3D ELSE (exp(({v} - 0.55991073D) / 0.17883277D) + (1D - 4D * 0.17883277D)) / 12D END"
BT709 = "CASE WHEN greatest({v}, 0D) <= 0.081D THEN greatest({v}, 0D) / 4.5D ELSE pow(({v} + 0.099D) / 1.099D, 1D / 0.45D) END"
GAMMA = "pow({v}, 1D / {gamma})"

# The opsin absorbance matrix and bias of the XYB colour space.
OPSIN = ((0.30, 1.0 - 0.078 - 0.30, 0.078), (0.23, 1.0 - 0.078 - 0.23, 0.078), (0.24342268924547819, 0.20476744424496821, 1.0 - 0.24342268924547819 - 0.20476744424496821))
OPSIN_BIAS, OPSIN_BIAS_CBRT = 0.0037930732552754493, 0.15595420054

# Knots of the curve from the common quality scale to the native one.
QUALITY_KNOTS = (
    (5.0, 5.0), (10.0, 5.0), (15.0, 5.0), (20.0, 5.0), (25.0, 9.3), (30.0, 22.7), (35.0, 33.0), (40.0, 38.8), (45.0, 43.8),
    (50.0, 48.5), (55.0, 51.9), (60.0, 55.1), (65.0, 58.0), (70.0, 61.3), (72.0, 63.2), (75.0, 65.5), (78.0, 67.9), (80.0, 69.1),
    (82.0, 71.8), (85.0, 76.1), (87.0, 79.3), (90.0, 84.2), (92.0, 86.9), (95.0, 91.2), (97.0, 92.8), (99.0, 93.8),
)

DISTANCE = "CASE WHEN {v} >= 100 THEN 0D WHEN {v} >= 90 THEN (100 - greatest({v}, 0D)) / 10 WHEN {v} >= 70 THEN 1 + (90 - {v}) / 20 ELSE 2 + (70 - greatest({v}, 0D)) / 10 END"
TO_BYTE = "CAST(floor(least(greatest({v}, 0D), 1D) * 255 + 0.5D) AS INT)"
FINITE = "CASE WHEN isnan({v}) OR abs({v}) = double('Infinity') THEN 0D ELSE {v} END"


def expr(template: str, **arguments: str) -> Column:
    return F.expr(template.format(**arguments))


def interpolation(knots: tuple[tuple[float, float], ...], v: str) -> str:
    """Piecewise linear through the knots, flat outside them."""
    parts = [f"WHEN {v} <= {knots[0][0]}D THEN {knots[0][1]}D", f"WHEN {v} >= {knots[-1][0]}D THEN {knots[-1][1]}D"]
    parts += [f"WHEN {v} <= {x1}D THEN {y0}D + ({v} - {x0}D) / {x1 - x0}D * {round(y1 - y0, 9)}D" for (x0, y0), (x1, y1) in zip(knots[:-1], knots[1:], strict=True)]
    return f"CASE {' '.join(parts)} END"


def matrix(m, r: str, g: str, b: str) -> tuple[str, str, str]:
    """A 3 by 3 matrix on three channels."""
    return tuple(f"({a!r}D * {r} + {c!r}D * {g} + {d!r}D * {b})" for a, c, d in m)


def xyb(r: str, g: str, b: str, nits: float = 255.0) -> tuple[str, str, str]:
    """Linear red, green and blue to X, Y and B."""
    k = repr(nits / 255.0) + "D"
    mixed = matrix(OPSIN, f"({r} * {k})", f"({g} * {k})", f"({b} * {k})")
    x, y, z = (f"(cbrt(greatest({m}, 0D) + {OPSIN_BIAS!r}D) - {OPSIN_BIAS_CBRT!r}D)" for m in mixed)
    return f"0.5D * ({x} - {y})", f"0.5D * ({x} + {y})", z


def inverted(m) -> tuple:
    """The inverse of a 3 by 3 matrix, by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return ((e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det), ((f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det), ((d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det)


def linear_rgb(x: str, y: str, b: str) -> tuple[str, str, str]:
    """X, Y and B to linear red, green and blue."""
    back = [f"(pow({v} + {OPSIN_BIAS_CBRT!r}D, 3D) - {OPSIN_BIAS!r}D)" for v in (f"({y} + {x})", f"({y} - {x})", b)]
    return matrix(inverted(OPSIN), *back)
