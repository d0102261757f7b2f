"""Filter interaction audit by the multilinear extension of the removal game.

A part's documents are known by the set of filters that they fail. With x_i the share of filter i that is applied, the expected
number of documents removed is a polynomial that is linear in every x_i: the removal polynomial, whose coefficients come from the
counts of the sets. At a corner (each x_i 0 or 1) it is the number that a set of filters removes, which gives what each
step of an order removes and keeps. The integral of its partial derivative by x_i along the diagonal is filter i's Shapley value,
the mean of what it removes over all orders.

Texts are read once, for small rows (part, failed filters, digest, labels); copies meet by the digest's least doc_id, and
only counts by part and set are gathered, so no group of copies meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


class RemovalPolynomial:
    """Coefficient of the product of the x_i of every set of filters; sets are bit masks."""

    def __init__(self, counts: list[int], n: int):
        """counts: documents by the set of filters that they fail. A document of set m is removed with probability
        1 - prod(1 - x_i for i in m)."""
        self.n, self.total = n, sum(counts)
        kept = list(counts)  # sum over the sets that hold each set
        for bit in range(n):
            for s in range(1 << n):
                if not s >> bit & 1:
                    kept[s] += kept[s | 1 << bit]
        self.coefficients = [0] + [(1 if s.bit_count() % 2 else -1) * kept[s] for s in range(1, 1 << n)]
        self.corners = list(self.coefficients)  # at a corner, the products of the sets within it are 1
        for bit in range(n):
            for s in range(1 << n):
                if s >> bit & 1:
                    self.corners[s] += self.corners[s ^ 1 << bit]

    def corner(self, applied: int) -> int:
        """Documents that the filters of a set remove."""
        return self.corners[applied]

    def shapley(self, i: int) -> Fraction:
        """The integral over t from 0 to 1 of the partial derivative by x_i at (t, ..., t)."""
        slope = [0] * self.n  # coefficients of t**0, t**1, ...
        for s, c in enumerate(self.coefficients):
            if s >> i & 1:
                slope[s.bit_count() - 1] += c
        return sum((Fraction(c, power + 1) for power, c in enumerate(slope)), Fraction(0))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_part(all_: list[int], good: list[int], toxic: list[int], names: str) -> list[tuple]:
    """Every step of every order of the filters: order, step, then COUNTS."""
    n = len(names)
    every, (whole, good_, toxic_) = (1 << n) - 1, (RemovalPolynomial(c, n) for c in (all_, good, toxic))
    fails = [whole.corner(1 << i) for i in range(n)]
    only = [whole.corner(every) - whole.corner(every ^ 1 << i) for i in range(n)]
    share = [int(whole.shapley(i) * math.factorial(n)) for i in range(n)]
    rows = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = whole.corner(after) - whole.corner(before)
            rows.append(("".join(names[j] for j in order), step, whole.total - whole.corner(after), removed, fails[i] - removed, only[i], good_.corner(after) - good_.corner(before), toxic_.corner(after) - toxic_.corner(before), share[i]))
            before = after
    return rows


def text_filters() -> dict[str, Column]:
    """What fails the filters A to D, of the columns `text` (no nulls) and `words` (those of the text)."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {"A": n < 50, "B": 100 * distinct.cast("long") < 65 * n.cast("long"), "C": 100 * capitals.cast("long") > 5 * F.length("text").cast("long"), "D": F.col("text").rlike("[#$%&*|]")}


def audit(docs: DataFrame, labels: DataFrame, filters: Callable[[], dict[str, Column]] = text_filters, copies: str = "E") -> DataFrame:
    """Apply filters to docs (doc_id, text, source) in every order: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (its filter's removed, summed over all orders), 5 rows an order of five filters.

    filters: a condition that is true of texts that fail, by letter. The last letter, `copies`, fails a document whose text a smaller doc_id
    has, in the whole table. part: the source, '' where it is null. A null text is empty, and texts of any length are read whole. Repeated rows count each by
    itself; those of a text's least doc_id are no copies of each other, and rows without a doc_id are copies of none and have no
    labels. Where labels (doc_id, quality, toxic) repeat a doc_id, one of its rows with a 1 is enough; nulls are no 1. An empty table gives
    no rows; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    failing = filters()
    names = "".join(failing) + copies
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failing.values())), F.lit(0))
    small = materialize(texts.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")), "failed")
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    firsts = small.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # both keys, so that a text's copies are dealt by their ids
    each = small.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    counts = each.groupBy("part", (F.col("mask") + F.when(copy, 1 << len(failing)).otherwise(0)).alias("mask")).agg(F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sets"))  # a row for each set of filters at most

    def run(batches):
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("sets").to_pylist(), strict=True):
                table = np.zeros((3, 1 << len(names)), np.int64)
                for s in own:
                    table[:, s["mask"]] = s["n"], s["good"], s["toxic"]
                rows = audit_part(*table.tolist(), names)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.string(), pa.int32(), *[pa.int64()] * 7)))], names=["part", "filter_order", "step", *COUNTS])

    return sets.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
