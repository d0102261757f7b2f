"""Transfer functions, colour spaces, quality curves and sample conversions over columns of samples. One projection each: nothing
is shuffled, and the expressions stay in generated code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transfer as t
from ..registered import query
from ..sources.tables import table

#: Samples of 8 and 16 bits, a unit interval, a quality, and three channels, from the line items.
_SAMPLES = "samples AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) % 256 AS c8, CAST(floor(l_extendedprice * 7) AS BIGINT) % 65536 AS c16, l_quantity * 2 AS q, l_discount * 10 AS u, l_tax * 12.5 AS w FROM lineitem)"
_KEY = ("l_orderkey", "l_linenumber")


def samples(spark, sf_dir):
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(*_KEY, (F.floor(price) % 256).alias("c8"), (F.floor(price * 7) % 65536).alias("c16"), (F.col("l_quantity") * 2).alias("q"), (F.col("l_discount") * 10).alias("u"), (F.col("l_tax") * 12.5).alias("w"))


def _duck(sql: str) -> str:
    """The expression in the other dialect: doubles have no suffix there."""
    import re

    return re.sub(r"(?<=[0-9])D\b", "::DOUBLE", sql).replace("double('Infinity')", "'Infinity'::DOUBLE")


def projection(name: str, doc: str, digits: int = 7, **columns: str) -> None:
    """Register a query of columns over the samples, rounded where they are fractions."""
    rounded = {k: v if v.startswith("CAST") else f"round({v}, {digits}) + 0" for k, v in columns.items()}

    def f(spark, sf_dir):
        return samples(spark, sf_dir).select(*_KEY, *[F.expr(v).alias(k) for k, v in rounded.items()])

    f.__doc__ = doc
    query(name, f"WITH {_SAMPLES} SELECT l_orderkey, l_linenumber, {', '.join(f'{_duck(v)} AS {k}' for k, v in rounded.items())} FROM samples")(f)


_U8, _U16 = "(c8 / 255D)", "(c16 / 65535D)"
for _name, _doc, _template in (("srgb", "sRGB", t.SRGB), ("pq", "perceptual quantiser", t.PQ), ("hlg", "hybrid log-gamma", t.HLG), ("bt709", "BT.709", t.BT709)):
    _id = {"srgb": ("p01", "p02", "p25"), "pq": ("p03", "p04", "p13"), "hlg": ("p06", "p05", "p14"), "bt709": ("p08", None, "p15")}[_name]
    projection(f"{_id[0]}_{_name}_u8_linear", f"8-bit samples, {_doc}, to linear light.", linear=_template.format(v=_U8))
    if _id[1]:
        projection(f"{_id[1]}_{_name}_u16_linear", f"16-bit samples, {_doc}, to linear light.", linear=_template.format(v=_U16))
    projection(f"{_id[2]}_{_name}_unit_linear", f"Samples between 0 and 1, {_doc}, to linear light, in three channels.", r=_template.format(v="u"), g=_template.format(v="w"), b=_template.format(v=_U8))
projection("p09_gamma_u8_linear", "8-bit samples of a given gamma to linear light.", linear=t.GAMMA.format(v=_U8, gamma="0.45455D"))
projection("p10_gamma_u16_linear", "16-bit samples of a given gamma to linear light.", linear=t.GAMMA.format(v=_U16, gamma="0.45455D"))
projection("p11_gray_u8_rgb", "A grey 8-bit sample as three equal linear channels.", **{c: t.SRGB.format(v=_U8) for c in "rgb"})
projection("p12_gray_u16_rgb", "A grey 16-bit sample as three equal linear channels.", **{c: t.SRGB.format(v=_U16) for c in "rgb"})
_Y = f"(0.2627D * u + 0.678D * w + 0.0593D * {_U8})"
projection("p07_hlg_ootf", "Scene light to display light: every channel times luminance to the power gamma - 1; black stays.", **{c: f"CASE WHEN {_Y} > 0 THEN {v} * pow({_Y}, 0.2D) ELSE {v} END" for c, v in zip("rgb", ("u", "w", _U8), strict=True)})
projection("p22_alpha_u16_to_u8", "16-bit alpha to 8 bits, rounded.", alpha=t.TO_BYTE.format(v=_U16))
projection("p23_alpha_unit_to_u8", "Alpha between 0 and 1 to 8 bits, clamped and rounded.", alpha=t.TO_BYTE.format(v="(u * 1.5D - 0.25D)"))
projection("p24_alpha_u16", "16-bit alpha as it is.", alpha="CAST(c16 AS INT)")
projection("p26_xyb", "Linear red, green, blue to the XYB colour space.", **dict(zip(("x", "y", "b"), t.xyb("u", "w", _U8), strict=True)))
projection("p26_xyb_1000_nits", "Linear red, green, blue to the XYB colour space at an intensity target of 1000.", **dict(zip(("x", "y", "b"), t.xyb("u", "w", _U8, 1000.0), strict=True)))
projection("p27_matrix", "A 3 by 3 colour matrix on three channels.", **dict(zip(("r", "g", "b"), t.matrix(t.OPSIN, "u", "w", _U8), strict=True)))
projection("p32_xyb_back", "XYB to linear red, green, blue: the channels of p26 as they were.", digits=6, **dict(zip(("r", "g", "b"), t.linear_rgb(*(f"({v})" for v in t.xyb("u", "w", _U8))), strict=True)))
projection("p37_quality_distance", "Quality to distance.", distance=t.DISTANCE.format(v="q"))
projection("p38_native_quality", "Common quality scale to the native one, between knots.", quality=t.interpolation(t.QUALITY_KNOTS, "q"))
projection("p39_interpolation", "Piecewise linear interpolation, flat outside the knots.", y=t.interpolation(((0.1, 4.0), (0.3, 1.0), (0.7, 2.5)), "u"))
projection("p42_finite", "Values that are not finite as 0.", v=t.FINITE.format(v="(CASE WHEN c8 % 7 = 0 THEN double('Infinity') ELSE u END)"))


@query("p18_half_floats", "SELECT vec_id, CAST(p AS INT) AS p, CASE WHEN a = 0 THEN 0.0 WHEN a < pow(2, -14) THEN s * round_even(a * pow(2, 24), 0) / pow(2, 24) ELSE s * round_even(a * pow(2, 10 - e), 0) * pow(2, e - 10) END AS v FROM (SELECT vec_id, p, abs(x) AS a, CASE WHEN x < 0 THEN -1.0 ELSE 1.0 END AS s, floor(log2(CASE WHEN x = 0 THEN 1 ELSE abs(x) END)) AS e FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS p FROM embeddings))")
def half_floats(spark, sf_dir):
    """Samples brought to 16-bit floats (ten bits after the first, ties to even) and back; those under 2 ** -14 to multiples of 2 ** -24."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x")).withColumn("x", F.col("x").cast("double"))
    a = F.abs("x")
    step = F.when(a < 2.0**-14, F.lit(2.0**-24)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.when(a == 0, 1.0).otherwise(a))) - 10))
    return x.select("vec_id", "p", (F.bround(F.col("x") / step) * step + 0.0).alias("v"))


# Empirical costs of run lengths by token.
LENGTH_COSTS = (
    2.797667318563126, 3.213177690381199, 2.5706009246743737, 2.408392498667534, 2.829649191872326, 3.3923087753324577, 4.029267451554331,
    4.415576699706408, 4.509357574741465, 9.21481543803004, 10.020590190114898, 11.858671627804766, 12.45853300490526, 11.713105831990857,
    12.561996324849314, 13.775477692278367, 13.174027068768641,
)


@query("m05_length_cost", f"WITH {_SAMPLES} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN c16 = 0 THEN 0 ELSE 1 + floor(log2(c16)) END AS BIGINT) AS token, round([{', '.join(map(repr, LENGTH_COSTS))}][CAST(least(CASE WHEN c16 = 0 THEN 0 ELSE 1 + floor(log2(c16)) END, 16) AS INT) + 1] + CASE WHEN c16 = 0 THEN 0 ELSE floor(log2(c16)) END, 6) AS cost FROM samples")
def length_cost(spark, sf_dir):
    """Token of a run's length (its exponent plus 1) and its cost with the bits that follow."""
    n = F.when(F.col("c16") == 0, F.lit(-1)).otherwise(F.length(F.bin("c16")) - 1)
    costs = F.array(*map(F.lit, LENGTH_COSTS))
    s = samples(spark, sf_dir).select(*_KEY, (n + 1).cast("long").alias("token"))
    return s.select(*_KEY, "token", F.round(F.get(costs, F.least("token", F.lit(16)).cast("int")) + F.greatest(F.col("token") - 1, F.lit(0)), 6).alias("cost"))


@query(
    "m12_colour_distance",
    f"""WITH {_SAMPLES}, a AS (SELECT l_orderkey, l_linenumber, [c8, c16 % 256, CAST(floor(q) AS BIGINT)] AS a, [c16 // 256, CAST(floor(u * 255) AS BIGINT), c8 // 2] AS b FROM samples),
s AS (SELECT *, (a[1] + b[1] + a[2] + b[2] + a[3] + b[3]) * (1.21::DOUBLE / 3) AS m FROM a),
w AS (SELECT *, 3 + CASE WHEN a[1] + b[1] >= m THEN 1.15 ELSE 0 END AS w1, 5 + CASE WHEN a[2] + b[2] >= m THEN 1.15 ELSE 0 END AS w2, 2 + CASE WHEN a[3] + b[3] >= m THEN CASE WHEN a[3] + b[3] < 1.22::DOUBLE * m THEN 0.62 ELSE 1.12 END ELSE 0 END AS w3 FROM s)
SELECT l_orderkey, l_linenumber, round(4 * ((a[1] - b[1]) ** 2 * w1 * w1::DOUBLE + (a[2] - b[2]) ** 2 * w2 * w2::DOUBLE + (a[3] - b[3]) ** 2 * w3 * w3::DOUBLE) + (3 * (a[1] - b[1]) + 5 * (a[2] - b[2]) + (a[3] - b[3])) ** 2, 4) AS weighted FROM w""",
)
def colour_distance(spark, sf_dir):
    """Distance of two colours: see colour_distance_of."""
    s = samples(spark, sf_dir).selectExpr(*_KEY, "array(c8, c16 % 256, floor(q)) AS a", "array(c16 div 256, floor(u * 255), c8 div 2) AS b")
    return s.select(*_KEY, F.round(colour_distance_of("a", "b"), 4).alias("weighted"))


def colour_distance_of(a: str, b: str):
    """Distance of two colours (arrays of three): four times the squared differences, each channel weighted and bright channels more, and the
    square of the difference of their weighted sums."""
    one, two = (lambda k: F.get(a, F.lit(k))), (lambda k: F.get(b, F.lit(k)))
    part = lambda k: one(k) + two(k)
    mean = (part(0) + part(1) + part(2)) * F.lit(1.21 / 3)
    extra = [F.when(part(0) >= mean, 1.15), F.when(part(1) >= mean, 1.15), F.when(part(2) >= mean, F.when(part(2) < 1.22 * mean, 0.62).otherwise(1.12))]
    squares = sum((F.pow(one(k) - two(k), 2) * F.pow(F.lit(float(base)) + F.coalesce(x, F.lit(0.0)), 2) for k, (base, x) in enumerate(zip((3, 5, 2), extra, strict=True))), F.lit(0.0))
    return 4 * squares + F.pow(3 * (one(0) - two(0)) + 5 * (one(1) - two(1)) + (one(2) - two(2)), 2)
