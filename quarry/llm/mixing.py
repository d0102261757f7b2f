"""Mixing sources to target weights by iterative proportional fitting (raking).

Token sums by cell (source, language, topic) are raked: in turn, the cells of each margin value are scaled to the
margin's target share, until no share moves. A cell's weight over its tokens gives every document of it the same
calibrated probability; where one would exceed 1, it is set to 1 and the rest are raised, so that the expected tokens
still meet the budget. Documents are drawn independently, by a hash of their doc_id.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, SPACED, batch_column, map_arrow, materialize, slices, text_buffers, word_spans

MARGINS = ("m_source", "m_lang", "m_topic")
OWN = (*MARGINS, "m_tokens", "p", "selected")
#: Topics by form: of a document's bytes, the class of sign that is most over its usual share.
TOPICS = ("prose", "table", "record", "caps", "signs")


def measured(docs: DataFrame) -> DataFrame:
    """docs with m_tokens (words), m_source, m_lang (null: '') and m_topic (docs' own `topic` if there is one)."""

    schema = T.StructType([*docs.schema, T.StructField("m_tokens", T.LongType()), T.StructField("m_topic", T.StringType())])

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_buffers(batch_column(batch, "text"))
        tokens, topic = [], []
        for a, b in slices(offsets):
            own, part = offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]
            _, _, first = word_spans(part, own, SPACED)
            tokens.append(np.diff(first))
            size = np.maximum(np.diff(own), 1)
            at = np.minimum(own, len(part))
            counts = []
            digit, upper, bar = (part >= 48) & (part < 58), (part >= 65) & (part < 91), part == 124
            for kind, usual in ((bar, 0.02), (digit, 0.05), (upper, 0.3), (~ALNUM[part] & SPACED[part], 0.12)):
                total = np.concatenate([[0], np.cumsum(kind)])
                counts.append((total[at[1:]] - total[at[:-1]]) / size / usual)
            x = np.stack(counts, 1)
            topic.append(np.where(x.max(1, initial=0) >= 1, x.argmax(1) + 1, 0))
        names = np.array(TOPICS, object)[np.concatenate(topic)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(tokens), pa.int64()), pa.array(names, pa.string())], schema=_arrow(schema, batch))

    out = map_arrow(docs, f, schema)
    if "topic" in docs.columns:
        out = out.withColumn("m_topic", F.coalesce(F.col("topic").cast("string"), F.lit("")))
    return out.withColumns({"m_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "m_lang": F.coalesce(F.col("lang").cast("string"), F.lit(""))})


def _arrow(schema: T.StructType, batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([*batch.schema, pa.field("m_tokens", pa.int64()), pa.field("m_topic", pa.string())])


def _by_margin(cells: DataFrame, *kept: str) -> DataFrame:
    """A row for each cell and margin: margin, value and the columns kept."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS]))
    return cells.select(each.alias("k"), *kept).select("k.*", *kept)


def targets(cells: DataFrame, temper: float = 0.5) -> DataFrame:
    """Default target shares: each margin's token shares tempered (power `temper`) towards equal ones. margin, value, share."""
    sums = _by_margin(cells, "tokens").groupBy("margin", "value").agg(F.pow(F.sum("tokens").cast("double"), temper).alias("x"))
    total = sums.groupBy("margin").agg(F.sum("x").alias("all"))
    return sums.join(total, "margin").filter("x > 0").select("margin", "value", (F.col("x") / F.col("all")).alias("share"))


def rake(cells: DataFrame, target: DataFrame, rounds: int = 60, tolerance: float = 1e-9, most_local: int = 100_000) -> DataFrame:
    """Cells (m_source, m_lang, m_topic, tokens) with w, their raked share of the tokens.

    Up to most_local cells are raked in one array; more of them as a table, by joins, one written table a round. Targets
    of values without tokens have no effect, and the others of the margin are raised to a sum of 1; values without a target
    get none. The steps are the same. Targets that no weights meet leave some share off: see most_off.
    """
    cells = cells.filter("tokens > 0")
    present = _by_margin(cells).distinct()
    target = target.join(present, ["margin", "value"])
    target = target.join(target.groupBy("margin").agg(F.sum("share").alias("all")), "margin").select("margin", "value", (F.col("share") / F.col("all")).alias("share"))
    if cells.count() <= most_local:
        rows = sorted(cells.select(*MARGINS, "tokens").collect())
        share = {(r["margin"], r["value"]): r["share"] for r in target.collect()}
        w = np.array([r["tokens"] for r in rows], float)
        w /= max(w.sum(), 1)
        index = []
        for k, m in enumerate(MARGINS):
            values = sorted({r[k] for r in rows})
            at = {v: i for i, v in enumerate(values)}
            goal = np.array([share.get((m, v), 0.0) for v in values])
            index.append((np.array([at[r[k]] for r in rows], int), goal))
        for _ in range(rounds):
            moved = 0.0
            for at, goal in index:
                now = np.bincount(at, w, len(goal))
                factor = np.where(now > 0, goal / np.where(now > 0, now, 1), 0)
                moved = max(moved, float(np.abs(now - goal).max(initial=0)))
                w = w * factor[at]
            if moved < tolerance:
                break
        schema = "m_source string, m_lang string, m_topic string, tokens long, w double"
        return cells.sparkSession.createDataFrame([(*r, float(x)) for r, x in zip(rows, w, strict=True)], schema)
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for _ in range(rounds):
        drift = None
        for m in MARGINS:
            goal = target.filter(F.col("margin") == m).select(F.col("value").alias(m), "share")
            sums = now.groupBy(m).agg(F.sum("w").alias("sum_w")).join(goal, m, "left").select(m, "sum_w", F.coalesce("share", F.lit(0.0)).alias("share"))
            now = now.join(sums, m).withColumn("w", F.when(F.col("sum_w") > 0, F.col("w") * F.col("share") / F.col("sum_w")).otherwise(F.lit(0.0))).withColumn(f"d_{m}", F.abs(F.col("sum_w") - F.col("share"))).drop("sum_w", "share")
        now = materialize(now, "rake")
        drift = now.agg(*[F.max(f"d_{m}").alias(m) for m in MARGINS]).first()
        now = now.drop(*[f"d_{m}" for m in MARGINS])
        if max(drift) < tolerance:
            break
    return now.select(*MARGINS, "tokens", "w")


def most_off(raked: DataFrame, target: DataFrame) -> float:
    """The largest distance of a margin value's weight from its target, over the values that have tokens."""
    goal = target.select("margin", "value", "share")
    sums = _by_margin(raked, "w").groupBy("margin", "value").agg(F.sum("w").alias("sum_w")).join(goal, ["margin", "value"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    tops = sums.groupBy("margin").agg(F.sum("share").alias("all"))
    top = F.when(F.col("all") > 0, F.col("all")).otherwise(F.lit(1.0))
    return sums.join(tops, "margin").agg(F.max(F.abs(F.col("sum_w") - F.col("share") / top))).first()[0] or 0.0


def tempered(cells: DataFrame, temper: float = 0.5) -> DataFrame:
    """Cells with w in proportion to tokens times each margin share to the power temper - 1: the weights of the raked form
    whose margins are met by these cells whatever cells are missing."""
    out = cells.filter("tokens > 0")
    total = float(out.agg(F.sum("tokens")).first()[0] or 1)
    factor = F.col("tokens").cast("double")
    for m in MARGINS:
        out = out.join(out.groupBy(m).agg(F.sum("tokens").alias(f"t_{m}")), m)
        factor = factor * F.pow(F.col(f"t_{m}") / F.lit(total), temper - 1)
    out = materialize(out.select(*MARGINS, "tokens", factor.alias("w")), "tempered")
    return out.withColumn("w", F.col("w") / F.lit(float(out.agg(F.sum("w")).first()[0] or 1)))


def margins(cells: DataFrame) -> DataFrame:
    """Shares that cells with w have by margin and value: margin, value, share."""
    return _by_margin(cells, "w").groupBy("margin", "value").agg(F.sum("w").alias("share"))


def weighted(cells: DataFrame, target: DataFrame | None, tolerance: float = 1e-4) -> DataFrame:
    """Cells with w, raked to target. Targets that the cells cannot meet raise. Default ones that they cannot meet, since cells are
    missing, give way to those shares that `tempered` cells have, with a warning: these can be met, and are raked to."""
    goal = materialize(targets(cells), "goal") if target is None else target
    raked = materialize(rake(cells, goal), "raked")
    off = most_off(raked, goal)
    if off > tolerance and target is None:
        warnings.warn(f"raking leaves a default share off by {off:.3g}; the targets are the shares of tempered cells instead", stacklevel=2)
        goal = materialize(margins(tempered(cells)), "goal")
        raked = materialize(rake(cells, goal), "raked")
        off = most_off(raked, goal)
    if off > tolerance:
        raise ValueError(f"raking leaves a target share off by {off:.3g}: no weights of these cells meet all targets, or more rounds are needed")
    return raked


def calibrated(raked: DataFrame, budget: float) -> DataFrame:
    """Cells with p: budget * w / tokens, at most 1, the rest raised by one factor so that sum(p tokens) is the budget.

    The sum is linear in the factor between two cells' tokens / w. Sums of the whole table narrow the factor down on a log
    scale to a stretch without such a place, where it is solved for; nothing is gathered. A budget of all tokens that
    have a weight, or more, gives p = 1.
    """
    raked = materialize(raked, "raked")
    full = F.when(F.col("w") > 0, F.col("tokens") / F.col("w"))
    size = raked.agg(F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("tokens"))), F.lit(0)).alias("t"), F.min(full).alias("low"), F.max(full).alias("top"), F.sum("w").alias("w")).first()
    if budget >= size["t"]:
        return raked.withColumn("p", F.when(F.col("w") > 0, 1.0).otherwise(0.0))
    low, high = float(size["low"]), float(size["top"])
    factor = budget / size["w"]
    if factor > low:
        while high > low * (1 + 1e-13) and raked.filter((full > low) & (full < high)).limit(1).count():
            grid = [low, *(np.exp(np.linspace(np.log(low), np.log(high), 101))[1:-1]).tolist(), high]
            sums = raked.agg(*[F.sum(F.least(F.col("w") * F.lit(x), F.col("tokens").cast("double"))) for x in grid]).first()
            at = max((k for k in range(100) if sums[k] <= budget), default=0)
            if (grid[at], grid[at + 1]) == (low, high):
                break
            low, high = grid[at], grid[at + 1]
        rest = raked.agg(F.sum(F.when(full <= low, F.col("tokens"))).alias("t"), F.sum(F.when(full > low, F.col("w"))).alias("w")).first()
        factor = (budget - float(rest["t"] or 0)) / rest["w"]
    return raked.withColumn("p", F.least(F.col("w") * F.lit(float(factor)) / F.col("tokens"), F.lit(1.0)))


def sample(docs: DataFrame, share: float = 0.5, target: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, lang, source) with m_source, m_lang, m_topic, m_tokens, p and selected.

    share: expected share of all words to be selected. Null languages and sources count as ''. Texts without
    words have p = 0 and are not selected. Rows of one doc_id are selected or not together. Columns with these names
    are replaced.
    """
    docs = measured(docs.drop(*OWN))
    cells = materialize(docs.groupBy(*MARGINS).agg(F.sum("m_tokens").alias("tokens")), "cells")
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    found = calibrated(weighted(cells, target), share * float(total)).select(*MARGINS, "p")
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id").cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    out = docs.join(found, list(MARGINS), "left").withColumn("p", F.when(F.col("m_tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(F.lit(0.0)))
    return out.withColumn("selected", draw < F.col("p"))
