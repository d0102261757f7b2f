"""Integer coding, approximated functions, thresholds, overrides and parsing over columns of samples: one projection each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registered import query
from ..sources.tables import table
from .transfer import projection


def hybrid_uint(v: str, split: int, msb: int, lsb: int) -> dict[str, str]:
    """Token, trailing bits and their number: values below 2 ** split are tokens; others keep `msb` bits after the first and the
    `lsb` last ones in the token."""
    rest = f"({v} >> {lsb})"
    n = f"CAST(length(bin({rest})) - {msb + 1} AS INT)"
    token = f"{1 << split} + (({n} - {split - msb - lsb}) << {msb + lsb}) + ((({rest} >> {n}) & {(1 << msb) - 1}) << {lsb}) + ({v} & {(1 << lsb) - 1})"
    small = f"CASE WHEN {v} < {1 << split} THEN"
    return {"token": f"CAST({small} {v} ELSE {token} END AS BIGINT)", "bits": f"CAST({small} 0 ELSE {rest} & ((1 << {n}) - 1) END AS BIGINT)", "n_bits": f"CAST({small} 0 ELSE {n} END AS BIGINT)"}


_SIGNED = "(CASE WHEN c16 >= 32768 THEN 2 * (c16 - 32768) ELSE 65535 - 2 * c16 END)"
projection("m02_hybrid_uint", "Values as hybrid integers of three configurations.", **{f"{k}_{s}{m}{n}": v for s, m, n in ((4, 2, 0), (4, 1, 2), (7, 0, 0)) for k, v in hybrid_uint("c16", s, m, n).items()})
projection("m03_residual_token", "Signed residuals, made unsigned with the sign in the last bit, as tokens.", **{k: v for k, v in hybrid_uint(_SIGNED, 4, 1, 2).items() if k != "bits"})
projection("m07_log2", "Logarithm to base 2; exact, where an approximation is accepted.", y="log2(c16 + 1)")
projection("m08_pow2", "Powers of 2; exact, where an approximation is accepted.", y="pow(2D, u * 20D - 10D)")
projection("m10_cosine", "Cosine; exact, where an approximation is accepted.", y="cos(u * 40D - 20D)")

# Coefficients of the error function's approximation, from the constant on.
ERF = (1.0, 2.77820801e-01, 2.32120216e-01, 2.05260015e-04, 7.77394369e-02)
_SUM = " + ".join(f"{c!r}D * pow(abs(u * 6D - 3D), {k}D)".replace("e-0", "E-") for k, c in enumerate(ERF))
projection("m09_error_function", "Error function: 1 less a polynomial to the power -4, odd in its argument; within 6e-4.", y=f"sign(u * 6D - 3D) * (1D - pow({_SUM}, -4D))")

# What a quantised 1 stands for by channel, and the share of 1 / q taken off larger values.
ONES, RECIPROCAL = (1.0 - 0.05465007330715401, 1.0 - 0.07005449891748593, 1.0 - 0.049935103337343655), 0.145
_Q = "(c8 % 9 - 4)"
projection("m11_quant_bias", "Quantised values moved towards zero by channel.", y=f"CASE WHEN {_Q} = 0 THEN 0D WHEN abs({_Q}) = 1 THEN {_Q} * CASE c16 % 3 WHEN 0 THEN {ONES[0]!r}D WHEN 1 THEN {ONES[1]!r}D ELSE {ONES[2]!r}D END ELSE {_Q} - {RECIPROCAL}D / {_Q} END")

# Channel orders by number; others keep the order.
ORDERS = ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1), (1, 0, 2), (2, 1, 0))
_THREE = ("c8", "c16 % 256", "c16 % 100")
projection("m14_channel_order", "Three channels in one of six orders.", **{c: "CAST(CASE c8 % 7 " + " ".join(f"WHEN {k} THEN {_THREE[o[i]]}" for k, o in enumerate(ORDERS)) + f" ELSE {_THREE[i]} END AS BIGINT)" for i, c in enumerate(("a", "b", "c"))})

_LIGHT, _FREQUENCY = "log10(0.1D + c16 / 100D)", "log10(greatest(u * 30D, 0.1D))"
_OFF = f"({_FREQUENCY} - log10(least(greatest(0.5D + 2D * {_LIGHT}, 0.5D), 8D)))"
projection("m18_contrast_sensitivity", "Contrast sensitivity by frequency and luminance: a parabola in logarithms, at least 1.", y=f"greatest(1D, pow(10D, log10(least(greatest(50D + 100D * {_LIGHT}, 50D), 500D)) - 0.85D * {_OFF} * {_OFF}))")

# Dead zones of the first and of the other quadrants, and what each covered block takes off them.
FIRST_Y, FIRST, OTHERS, EACH_BLOCK, LEAST = 0.56, 0.58, 0.62, 0.00744, 0.5
_COVERED = "pow(2D, c16 % 6)"


def _threshold(plain: str) -> str:
    return f"CASE WHEN c8 % 3 <> 1 AND {_COVERED} >= 4 THEN greatest({plain} - {EACH_BLOCK}D * {_COVERED}, {LEAST}D) ELSE {plain} END"


_FIRST = f"CASE WHEN c8 % 3 = 1 THEN {FIRST_Y}D ELSE {FIRST}D END"
projection("v10_dead_zones", "Dead zones of the four quadrants by channel and covered blocks.", t0=_threshold(f"({_FIRST})"), **{f"t{k}": _threshold(f"{OTHERS}D") for k in (1, 2, 3)})
_V = "((u * 8D - 4D) * (1D + w))"
projection("v11_dead_zone_quantised", "Weighted coefficients, 0 in the dead zone, else the nearest integer, ties to even.", y=f"CASE WHEN abs({_V}) < CASE WHEN c8 % 4 = 0 THEN {FIRST}D ELSE {OTHERS}D END THEN 0D WHEN abs({_V}) - floor(abs({_V})) = 0.5D THEN sign({_V}) * 2D * floor((abs({_V}) + 1D) / 2D) ELSE sign({_V}) * floor(abs({_V}) + 0.5D) END")
projection("f16_overrides", "Settings with those overridden that are given.", a="coalesce(CASE WHEN c8 % 3 = 0 THEN u END, w)", b="coalesce(CASE WHEN c8 % 5 = 0 THEN CAST(c8 AS DOUBLE) END, CASE WHEN c8 % 2 = 0 THEN u END, 0D)")

projection("g25_quantised_field", "A field of multipliers as whole steps from 1 to 255, half a step up.", y="CAST(least(greatest(floor(u * 300D + 0.5D), 1D), 255D) AS BIGINT)")

#: Target of a tile's error, and bounds of its step; a tile's error, its step now and at first, and the round.
_ERROR, _STEP, _FIRST_STEP, _ROUND = "(w * 2.5D)", "(1 + c8 % 200)", "(1 + c16 % 200)", "(c16 % 3)"
_RAISED = f"{_STEP} * ({_ERROR} / 1.2D)"
_BLENDED = f"(CASE WHEN {_ROUND} = 1 THEN 0.6D * {_RAISED} + 0.4D * {_FIRST_STEP} ELSE {_RAISED} END)"
projection("l03_adjusted_field", "Steps of tiles whose error is over the target, raised by the same ratio (in round 1 mixed with the first ones), by one at least, within bounds.", y=f"CAST(CASE WHEN {_ERROR} <= 1.2D THEN {_STEP} ELSE floor(least(greatest(greatest({_BLENDED}, {_STEP} + 1D), 4D), 180D)) END AS BIGINT)")

#: A value with 16 significant bits: whole number, sign, and halvings.
_WHOLE, _SIGN, _HALVED = "abs(c16 - 32768)", "(CASE WHEN c16 < 32768 THEN 32768 ELSE 0 END)", "(c8 % 42 - 2)"
_EXPONENT = f"(length(bin({_WHOLE})) - 1 - {_HALVED} + 15)"
projection(
    "p17_half_bits", "Values as 16-bit floats, cut off: sign, five bits of exponent, ten of mantissa; small ones without an exponent, too small ones 0, too large ones null.",
    bits=f"CAST(CASE WHEN {_WHOLE} = 0 THEN 0 WHEN {_EXPONENT} >= 31 THEN NULL WHEN {_EXPONENT} < -10 THEN {_SIGN} WHEN {_EXPONENT} <= 0 THEN {_SIGN} + floor({_WHOLE} * pow(2D, 24 - {_HALVED})) "
    f"ELSE {_SIGN} + {_EXPONENT} * 1024 + floor({_WHOLE} * pow(2D, 11 - length(bin({_WHOLE})))) - 1024 END AS BIGINT)",
)

# Coefficients that foretell a quality: of the constant, the target, its hinges at 50, 60, 70, 80 and 85, and the size; of eight features; of these times the
# target; of these times the hinge at 80.
SEED = (
    18.236299968062756, 14.225576735397231, 6.851106604548416, 5.964310698099696, -4.165298017327582, -1.2199460933094541, -18.607663900312122, -5.701052276921821,
    -53.93417957141681, -44.31518225784404, 2.8328625158937566, 9.268970257945522, 3.337965136386378, -2.6861110238041777, 3.468920603273567, -34.44467613388063,
    -57.349554683122214, -15.942396314039918, 0.4188634254074954, 1.1366157440838158, 12.60834299763201, 2.9856010278392433, 2.6055194222082547, -59.37628136420917,
    103.47921161919237, 36.821402449311186, -0.9023333281312831, -14.009579928131277, -8.837165071050778, 3.0575694167432457, -3.6172174158927266, 78.4065070669234,
)
_TARGET = "(least(greatest(q, 40D), 90D))"
_HINGE = lambda k: f"(greatest({_TARGET} - {k}D, 0D) / 10D)"
_SEEN = ("(u)", "(w)", "(ln(1D + c8))", "(u * w)", "(c8 / 255D)", "(c16 / 65535D)", "(c8 % 8)", "(w * c8 / 255D)")
_NORMAL = f"(({_TARGET} - 65D) / 25D)"
_INPUTS = ["1D", _NORMAL, *map(_HINGE, (50, 60, 70, 80, 85)), "((ln(1D + c16) - 13D) / 3D)", *_SEEN, *[f"({f} * {_NORMAL})" for f in _SEEN], *[f"({f} * {_HINGE(80)})" for f in _SEEN]]
projection("m19_foretold_quality", "The quality to start from, foretold from a target, a size and eight features.", digits=6, y="least(greatest(" + " + ".join(f"({c!r}D * {x})" for c, x in zip(SEED, _INPUTS, strict=True)) + ", 1D), 100D)")

_WRITTEN = "CASE l_linenumber WHEN 1 THEN 'NA' WHEN 2 THEN '' WHEN 3 THEN 'nan' WHEN 4 THEN ' 1.5 ' WHEN 5 THEN '1.5d' ELSE CAST(CAST(l_quantity AS INT) AS {s}) END"
_NUMBER = r"^\s*[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?\s*$"


@query("s17_nullable_numbers", f"SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(x, '{_NUMBER}') THEN CAST(trim(x) AS DOUBLE) END AS v FROM (SELECT l_orderkey, l_linenumber, {_WRITTEN.format(s='VARCHAR')} AS x FROM lineitem)")
def nullable_numbers(spark, sf_dir):
    """Written numbers as doubles; nothing, NA, not-a-number and other text as null."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_WRITTEN.format(s="STRING")).alias("x"))
    return x.select("l_orderkey", "l_linenumber", F.when(F.col("x").rlike(_NUMBER), F.trim("x").cast("double")).alias("v"))


#: Names of the six parameters of a cell.
KNOBS = ("p1", "p2", "p3", "p4", "p5", "p6")


def _float_sql(at: int, word: str) -> str:
    """The little-endian 32-bit float at a byte of a hexadecimal string; word reads hexadecimal digits as an integer."""
    byte = lambda k: word.format(f"substr(h, {2 * (at + k) + 1}, 2)")
    bits = f"({byte(0)} + 256 * {byte(1)} + 65536 * ({byte(2)} % 128))"
    power = f"(2 * ({byte(3)} % 128) + CASE WHEN {byte(2)} >= 128 THEN 1 ELSE 0 END)"
    sign = f"(CASE WHEN {byte(3)} >= 128 THEN -1 ELSE 1 END)"
    return f"CASE WHEN length(h) <> 48 THEN NULL WHEN {power} = 0 THEN {sign} * {bits} * pow(2, -149) ELSE {sign} * ({bits} + 8388608) * pow(2, {power} - 150) END"


_FLOATS = ", ".join(_float_sql(4 * k, "('0x' || {})::BIGINT") + f" AS {name}" for k, name in enumerate(KNOBS))


@query("s13_parameter_blobs", f"SELECT doc_id, CAST(k AS INT) AS k, {_FLOATS} FROM (SELECT doc_id, unnest(range((octet_length(encode(text)) + 23) // 24)) AS k, substr(hex(encode(text)), 48 * k + 1, 48) AS h FROM documents)")
def parameter_blobs(spark, sf_dir):
    """A text's bytes as blobs of 24, each six little-endian 32-bit floats; a shorter last one is no blob, and null."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for batch in batches:
            blob = batch.column("blob")
            whole = pc.fill_null(pc.equal(pc.binary_length(blob), 24), False)
            dense = blob.filter(whole)
            data = dense.cast(pa.large_binary()).buffers()
            at = np.frombuffer(data[1], np.int64, len(dense) + 1, dense.offset * 8) if len(dense) else np.zeros(1, np.int64)
            floats = np.frombuffer(data[2], "<f4", 6 * len(dense), int(at[0])) if len(dense) else np.empty(0, "<f4")
            ok = whole.to_numpy(zero_copy_only=False).astype(bool)
            values = np.zeros((batch.num_rows, 6))
            values[ok] = floats.reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), *(pa.array(values[:, k], mask=~ok) for k in range(6))], names=["doc_id", "k", *KNOBS])

    texts = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).filter(F.octet_length("b") > 0)
    cut = texts.select("doc_id", "b", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("b") - 1) / 24).cast("int"))).alias("k"))
    return cut.select("doc_id", "k", F.expr("substring(b, 24 * k + 1, 24)").alias("blob")).mapInArrow(run, "doc_id long, k int, " + ", ".join(f"{k} double" for k in KNOBS))
