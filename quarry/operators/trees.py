"""Decision trees over residuals, grown level by level: a level is one pass over the texts that counts tokens by open node, property and
bin within the tasks that read them, one sum of these counts, and a split for each node where its counts meet. The driver
holds the trees (a part's has 2 ** DEPTH leaves at most), never samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import trees
from ..functions.rasters import count_stage
from ..functions.trees import BINS, CHOICES, HIGH, LOW, PROPERTIES, TOKENS, Node
from ..registered import query
from ..sources.tables import RASTER_SQL, RESIDUAL_SQL, table

#: Levels of splits, and the bits that a split has to save.
DEPTH, SAVES = 5, 96.0
_NODE = len(CHOICES) * len(PROPERTIES) * BINS * TOKENS


def property_counts(docs):
    """Occurrences of every value of every property: prop, value, n."""

    def f(s, of, keys):
        return np.stack([np.bincount(row, minlength=HIGH - LOW + 1) for row in trees.properties(s, s.neighbours()) - LOW]).reshape(1, -1)

    counted = count_stage(docs.withColumn("all", F.lit("")), f, "all")
    size = HIGH - LOW + 1
    return counted.select(F.floor(F.col("cell") / size).cast("int").alias("prop"), (F.col("cell") % size + LOW).cast("int").alias("value"), "n")


def bin_ends(docs) -> list[np.ndarray]:
    """Upper ends of the bins of each property. y and x have even ones, of 256."""
    counts = np.zeros((len(PROPERTIES), HIGH - LOW + 1), np.int64)
    for r in property_counts(docs).toLocalIterator():  # 13 by 1025 rows at most
        counts[r["prop"], r["value"] - LOW] = r["n"]
    even = np.arange(1, BINS) * 256 // BINS - 1
    return [even, even, *map(trees.thresholds, counts[2:])]


def _routed(forest: dict, key, bins: np.ndarray, slots: list[str]) -> np.ndarray:
    """The open node (its place in slots) that each sample of a key is in, or -1."""
    tree, state = forest[key], np.zeros(bins.shape[1], np.int64)
    paths = sorted(tree, key=len)
    place = {p: i for i, p in enumerate(paths)}
    prop = np.array([-1 if tree[p].prop is None else tree[p].prop for p in paths])
    cut = np.array([tree[p].bin for p in paths])
    child = np.array([[place.get(p + "0", -1), place.get(p + "1", -1)] for p in paths])
    for _ in range(max(map(len, paths))):
        at = np.flatnonzero(prop[state] >= 0)
        own = state[at]
        state[at] = child[own, (bins[prop[own], at] > cut[own]).astype(np.int64)]
    slot = np.full(len(paths), -1)
    for i, p in enumerate(slots):
        slot[place[p]] = i
    return slot[state]


def _level(docs, ends: list[np.ndarray], forest: dict, open_: dict[str | None, list[str]]):
    """Counts of a level's open nodes: lang, cell."""
    most = max(map(len, open_.values()))
    bin_of = [np.searchsorted(e, np.arange(LOW, HIGH + 1), "left").astype(np.int8) for e in ends]
    size = BINS * TOKENS

    def f(s, of, keys):
        a = s.neighbours()
        bins = np.stack([b[row] for b, row in zip(bin_of, trees.properties(s, a) - LOW, strict=True)])
        token = trees.residual_tokens(s, a)
        key_of = of[s.row]
        out = np.zeros((len(keys), most, len(CHOICES), len(PROPERTIES), size), np.int64)
        for k, key in enumerate(keys):
            if not open_.get(key):
                continue
            own = np.flatnonzero(key_of == k)
            slot = _routed(forest, key, bins[:, own], open_[key])
            own, slot = own[slot >= 0], slot[slot >= 0]
            many = len(open_[key])
            # the table of one predictor and property is small enough to stay in a core's cache
            at = [slot * size + t[own] for t in token]
            for q in range(len(PROPERTIES)):
                b = bins[q, own].astype(np.int64) * TOKENS
                for c in range(len(CHOICES)):
                    out[k, :many, c, q] += np.bincount(at[c] + b, minlength=many * size).reshape(many, size)
        return out.reshape(len(keys), -1)

    return count_stage(docs, f, "lang")


def grow(docs, depth: int = DEPTH, saves: float = SAVES) -> dict:
    """A tree for each language of docs (lang, text)."""
    ends = bin_ends(docs)
    langs = [r["lang"] for r in docs.filter(F.length("text") > 0).select("lang").distinct().collect()]
    forest = {k: {"": Node(0, 0, 0.0)} for k in langs}
    open_ = {k: [""] for k in langs}
    for level in range(depth):
        if not any(open_.values()):
            break
        at = {(k, i): forest[k][p].predictor for k in open_ for i, p in enumerate(open_[k])}

        def split(key, t):
            lang, slot = key[0].as_py(), key[1].as_py()
            counts = np.zeros(_NODE, np.int64)
            counts[t.column("cell").to_numpy() % _NODE] = t.column("n").to_numpy()
            found = trees.best_split(counts.reshape(len(CHOICES), len(PROPERTIES), BINS, TOKENS), at[lang, slot], saves)
            whole = counts.reshape(len(CHOICES), len(PROPERTIES), BINS, TOKENS)[at[lang, slot], 0].sum(0)
            bits = float(trees.estimated_bits(whole) + (whole * trees.token_bits(np.arange(TOKENS))).sum())
            row = (lang, slot, int(whole.sum()), bits, *((None,) * 8 if found is None else (found[0], found[1], *found[2], *found[3])))
            return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
        names = ["lang", "slot", "n", "bits", "prop", "bin", "low_predictor", "low_n", "low_bits", "high_predictor", "high_n", "high_bits"]
        counted = _level(docs, ends, forest, open_).withColumn("slot", F.floor(F.col("cell") / _NODE))
        schema = "lang string, slot long, n long, bits double, prop long, bin long, low_predictor long, low_n long, low_bits double, high_predictor long, high_n long, high_bits double"
        following: dict = {k: [] for k in langs}
        for r in counted.groupBy("lang", "slot").applyInArrow(split, schema).collect():  # a row for each open node
            tree, path = forest[r["lang"]], open_[r["lang"]][r["slot"]]
            mine = tree[path].predictor
            if r["prop"] is None:
                tree[path] = Node(mine, r["n"], r["bits"])
                continue
            tree[path] = Node(mine, r["n"], r["bits"], r["prop"], r["bin"], int(ends[r["prop"]][r["bin"]]), r["bits"] - r["low_bits"] - r["high_bits"])
            for turn, side in (("0", "low"), ("1", "high")):
                tree[path + turn] = Node(r[f"{side}_predictor"], r[f"{side}_n"], r[f"{side}_bits"])
                following[r["lang"]].append(path + turn)
        open_ = {k: sorted(v) for k, v in following.items()}
    return forest


def _rows(tree, name=PROPERTIES) -> list[tuple]:
    return [
        (path, number, context, None if x.prop is None else name[x.prop], None if x.prop is None else x.threshold, CHOICES[x.predictor], x.n, round(x.bits, 3), round(x.saved, 3))
        for number, (path, x, context) in enumerate(trees.numbered(tree))
    ]


_FIELDS = "path string, node int, context int, property string, threshold int, predictor string, n long, bits double, saved double"


@query("d20_residual_trees")
def residual_trees(spark, sf_dir):
    """The residuals' tree of each language: which property splits a node and where, or which predictor its samples take."""
    forest = grow(table(spark, sf_dir, "documents").select("lang", "text"))
    return spark.createDataFrame([(k, *r) for k, tree in forest.items() for r in _rows(tree)], "lang string, " + _FIELDS)


@query("d22_joined_tree")
def joined_tree(spark, sf_dir):
    """The languages' trees under splits on the language (by its place in the order of names), no deeper than four levels, leaves numbered
    level by level."""
    forest = grow(table(spark, sf_dir, "documents").select("lang", "text"))
    order = sorted(forest, key=lambda k: (k is not None, k or ""))
    tree = trees.capped(trees.joined([forest[k] for k in order], len(PROPERTIES)), 4) if order else {}
    return spark.createDataFrame(_rows(tree, (*PROPERTIES, "lang")), _FIELDS)


_BINS_SQL = f"""WITH {RASTER_SQL}, {RESIDUAL_SQL}, g AS (SELECT *, w + n - nw AS g, CASE WHEN p % 32 = 0 THEN 0 ELSE lag(w + n - nw) OVER (PARTITION BY doc_id ORDER BY p) END AS before FROM al),
v AS (SELECT unnest({list(PROPERTIES[2:])}) AS property, unnest([abs(n), abs(w), n, w, w - before, g, w - nw, nw - n, n - ne, n - nn, w - ww]) AS v FROM g),
h AS (SELECT property, least(greatest(v, {LOW}), {HIGH}) AS v, count(*) AS n FROM v GROUP BY ALL),
c AS (SELECT property, v, sum(n) OVER (PARTITION BY property ORDER BY v) * {BINS} // sum(n) OVER (PARTITION BY property) AS share FROM h),
e AS (SELECT *, share > coalesce(lag(share) OVER (PARTITION BY property ORDER BY v), 0) AS ends FROM c),
k AS (SELECT property, v, row_number() OVER (PARTITION BY property ORDER BY v) - 1 AS bin, count(*) OVER (PARTITION BY property) AS bins FROM e WHERE ends)
SELECT property, CAST(bin AS INT) AS bin, CAST(v AS INT) AS "end" FROM k WHERE bin + 1 < bins
UNION ALL SELECT property, CAST(b AS INT), CAST((b + 1) * 256 // {BINS} - 1 AS INT) FROM unnest(['y', 'x']) AS p(property), range({BINS - 1}) AS r(b)"""


@query("d19_property_bins", _BINS_SQL)
def property_bins(spark, sf_dir):
    """Upper ends of the bins of every property, by equal shares of its values over all samples."""
    ends = bin_ends(table(spark, sf_dir, "documents").select("text"))
    return spark.createDataFrame([(p, i, int(e)) for p, own in zip(PROPERTIES, ends, strict=True) for i, e in enumerate(own)], "property string, bin int, end int")
