"""Exact near-duplicate classes by n-gram Jaccard similarity: a size-aware heavy-light join.

A document is its set of distinct word shingles (64-bit hashes). Equal sets fall into one class by digest, and one
representative of each goes on.

Light sets (up to a boundary size) are matched by subsets: two sets of sizes a and b link when they share
o = ceil(t (a+b) / (1+t)) shingles, so each lists all its o-subsets for every partner size b, and an equal subset of sets of both
sizes is a link without further check (sets of one size that share a subset meant for another size need not link). Heavy sets are matched by inverted lists of their prefixes: in one order of all shingles, two
linked sets share one of their first n - ceil(t n) + 1; as their first common one leaves o - 1 more behind it in both, a
pair is only checked where its places in both sets allow that. The boundary is where listing subsets would cost more
than the lists, summed over the size histogram of the corpus: the lists of small sets are measured, with the checks that they cause.

Shingles found in many prefixes (shared passages) go last in that order, so that few prefixes hold them. In each list
all sets are first compared with the list's smallest one (a star, as many pairs as list entries). Sets of one list that are
then in one component need no more pairs, which settles most groups of copies without their square. What is left are lists
with sets of different components. The short ones (`short_list` sets) are paired up and checked. The sets of the long ones form
clusters; a cluster is a block, or if large dealt by size and by hash into blocks of bounded bytes, which meet blocks of like size: a
task counts shared shingles for two blocks at once, frequent shingles by a matrix product and rare ones by lists, and
returns one link for each two components that it joins. So no pair is a row, and no link between components is missed.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, batch_column, discard, map_arrow, materialize, mix64, ngram_hashes, release, slices, span_hashes, text_buffers, word_spans
from .components import components

#: Sizes up to which listing subsets is considered at all.
MOST_LIGHT = 24


def needed(a: int, b: int, percent: int) -> int:
    """Shared shingles that sets of sizes a and b need: intersection * 100 >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(column: pa.Array, words: int):
    """Distinct shingle hashes of each row, in ascending order: hashes of all rows, and the number of each row."""
    raw, offsets = text_buffers(column)
    for a, b in slices(offsets):
        own, part = offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]
        starts, ends, first = word_spans(part, own, SPACED)
        h = span_hashes(part, starts, ends)
        n = np.diff(first)
        grams = ngram_hashes(h, words)
        row = np.repeat(np.arange(b - a), n)
        whole = np.zeros(len(h), bool)  # positions where a shingle of one row begins
        if len(grams):
            whole[: len(grams)] = row[: len(grams)] == row[words - 1 :]
        keys, rows = grams[np.flatnonzero(whole)] if len(grams) else np.empty(0, np.uint64), row[whole]
        short = np.flatnonzero((n > 0) & (n < words))
        if len(short):
            extra = np.array([ngram_hashes(h[first[r] : first[r + 1]], int(n[r]))[0] for r in short], np.uint64)
            keys, rows = np.concatenate([keys, extra]), np.concatenate([rows, short])
        order = np.argsort(keys)
        order = order[np.argsort(rows[order], kind="stable")]
        keys, rows = keys[order], rows[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        keys, rows = keys[new], rows[new]
        yield a, keys, np.bincount(rows, minlength=b - a).astype(np.int64)


def _digests(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n and two sums of independent mixes of the set: 128 bits that equal sets share."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, d1, d2 = [], [], []
        for _, keys, sizes in shingle_sets(batch_column(batch, "text"), words):
            total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(keys ^ np.uint64(salt)))]) for salt in (0x1234567, 0xABCDEF0123)]
            at = np.concatenate([[0], np.cumsum(sizes)])
            n.append(sizes)
            d1.append(total[0][at[1:]] - total[0][at[:-1]])
            d2.append(total[1][at[1:]] - total[1][at[:-1]])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(d1).view(np.int64)), pa.array(np.concatenate(d2).view(np.int64))], names=["doc_id", "n", "d1", "d2"])

    return map_arrow(docs.select("doc_id", "text"), f, "doc_id long, n long, d1 long, d2 long")


#: What the check of a pair costs, in entries: cutting and comparing its texts takes 13 times as long as an entry (measured on texts of 20 words), and
#: their bytes, some ten times an entry's, pass two joins.
CHECK = 25.0


def choose_boundary(sizes: dict[int, int], lists: dict[int, float], percent: int) -> int:
    """The largest size to be light: where the sum of subsets below and of lists above is least.

    sizes: number of sets of each size up to MOST_LIGHT + 8; lists: what a set of each size costs in lists, entries and checks.
    """
    best, at = None, 0
    for x in range(0, MOST_LIGHT + 1):
        cost = sum(c * lists[n] for n, c in sizes.items() if 100 * n // percent > x and n in lists)
        for n, c in sizes.items():
            if 0 < n <= x:
                partners = range(-(-percent * n // 100), min(x, 100 * n // percent) + 1)
                cost += c * sum(comb(n, needed(n, b, percent)) for b in partners if needed(n, b, percent) <= n)
        if best is None or cost < best:
            best, at = cost, x
    return at


def _list_costs(small: DataFrame, words: int, percent: int, short_list: int) -> dict[int, float]:
    """What a set costs in inverted lists, by size: its prefix entries, and a check for each other set in their lists, of which a long list causes short_list at most.
    small: distinct sets of the sizes in question and of all sizes that these can link with."""
    entries = _entries(small, words, percent, 0, None).groupBy("key", "n").agg(F.count("*").alias("m"))
    entries = materialize(entries, "small")
    others = entries.groupBy("key").agg(F.sum("m").alias("c"))
    checks = F.least(F.col("c") - 1, F.lit(short_list)) * CHECK / 2  # a pair's check is shared by the two
    by = entries.join(others, "key").groupBy("n").agg(F.sum(F.col("m") * (1 + checks)).alias("cost"))
    out = {r["n"]: float(r["cost"]) for r in by.collect()}  # as many rows as sizes
    discard(entries)
    return out


@cache
def _picks(a: int, o: int) -> np.ndarray:
    """The places of all o-subsets of a members."""
    return np.array(list(combinations(range(a), o)), np.int64)


def _subset_keys(keys: np.ndarray, partner: int, percent: int) -> np.ndarray:
    """Keys of all subsets of the size that a partner of that size must share."""
    a = len(keys)
    o = needed(a, partner, percent)
    if o > min(a, partner):
        return np.empty(0, np.uint64)
    own = mix64(keys ^ np.uint64(0x5DEECE66D))[_picks(a, o)].sum(1, dtype=np.uint64)
    low, high = min(a, partner), max(a, partner)
    return mix64(own + np.uint64(low * 1_000_003 + high))


def _entries(reps: DataFrame, words: int, percent: int, boundary: int, hot: np.ndarray | None) -> DataFrame:
    """key, rep, n, pos, sure: subset keys of light sets, and prefix entries of those that may have a heavy partner.

    pos: place of the key in the set's order, from 1; 0 for ids that are not `alone` (one set only). Of subset keys: 1 if they are for
    partners of another size, else 0.
    """
    shared = reps.sparkSession.sparkContext.broadcast(hot if hot is not None else np.empty(0, np.uint64))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        own_hot = shared.value
        ids = batch_column(batch, "doc_id").to_numpy()
        alone = batch_column(batch, "alone").to_numpy(zero_copy_only=False).astype(bool)
        out_key, out_rep, out_n, out_pos, out_sure = [], [], [], [], []
        for a, keys, sizes in shingle_sets(batch_column(batch, "text"), words):
            at = np.concatenate([[0], np.cumsum(sizes)])
            row = np.repeat(np.arange(len(sizes)), sizes)
            if len(own_hot) and len(keys):
                spot = np.minimum(np.searchsorted(own_hot, keys), len(own_hot) - 1)
                last = own_hot[spot] == keys
                order = np.lexsort((keys, last, row)) if last.any() else slice(None)
                keys = keys[order]
            prefix = sizes - -(-percent * sizes // 100) + 1
            # a set whose partners are all light is matched by subsets alone
            heavy = 100 * sizes // percent > boundary
            place = np.arange(len(keys)) - at[row]
            chosen = (place < prefix[row]) & heavy[row]
            out_key.append(keys[chosen])
            out_rep.append(ids[a + row[chosen]])
            out_n.append(sizes[row[chosen]])
            out_pos.append(np.where(alone[a + row[chosen]], place[chosen] + 1, 0))
            out_sure.append(np.zeros(int(chosen.sum()), bool))
            for r in np.flatnonzero((sizes > 0) & (sizes <= boundary)):
                n = int(sizes[r])
                own = keys[at[r] : at[r + 1]]
                for b in range(-(-percent * n // 100), min(boundary, 100 * n // percent) + 1):
                    found = _subset_keys(own, b, percent)
                    out_key.append(found)
                    out_rep.append(np.full(len(found), ids[a + r]))
                    out_n.append(np.full(len(found), n))
                    out_pos.append(np.full(len(found), int(b != n)))
                    out_sure.append(np.ones(len(found), bool))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        return pa.RecordBatch.from_arrays([pa.array(join(out_key, np.uint64).view(np.int64)), pa.array(join(out_rep, np.int64)), pa.array(join(out_n, np.int32)), pa.array(join(out_pos, np.int32)), pa.array(join(out_sure, bool))], names=["key", "rep", "n", "pos", "sure"])

    return map_arrow(reps.select("doc_id", "text", "alone"), f, "key long, rep long, n int, pos int, sure boolean")


def _may_link(n, pos, other_n, other_pos, percent: int):
    """Whether two sets can link with this key as the first one that they share: it and the keys behind it must do.

    Every two sets that link have such a key, so a pair dropped here is met in another list or does not link.
    """
    need = F.ceil((n + other_n) * percent / F.lit(100 + percent))
    return (pos == 0) | (other_pos == 0) | (F.least(n - pos, other_n - other_pos) + 1 >= need)


def _checked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets link. Both texts meet in one row; a set of many pairs is split by Spark's skew join."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = []
        for name in ("ta", "tb"):
            column = batch_column(batch, name).dictionary_encode()
            own = []
            for _, keys, sizes in shingle_sets(column.dictionary, words):
                at = np.concatenate([[0], np.cumsum(sizes)])
                own += [keys[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            sets.append((own, column.indices.to_pylist()))
        keep = np.zeros(batch.num_rows, bool)
        for k, (i, j) in enumerate(zip(sets[0][1], sets[1][1], strict=True)):
            x, y = sets[0][0][i], sets[1][0][j]
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            keep[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
        return pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    met = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return map_arrow(met, f, "a long, b long")


_BLOCK = "block long, ids binary, comps binary, sizes binary, tokens binary"


def _blocks(docs: DataFrame, words: int) -> DataFrame:
    """Sets of docs (doc_id, text, block, component) in one row for each block."""

    def f(table: pa.Table) -> pa.Table:
        sizes, tokens = [], []
        for _, keys, n in shingle_sets(batch_column(table, "text"), words):
            sizes.append(n)
            tokens.append(keys)
        row = [table.column("block")[0].as_py(), *(batch_column(table, c).to_numpy().astype("<i8").tobytes() for c in ("doc_id", "component")), np.concatenate(sizes).astype("<i8").tobytes(), np.concatenate(tokens).astype("<u8").tobytes()]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "ids", "comps", "sizes", "tokens"])

    return docs.select("block", "doc_id", "component", "text").groupBy("block").applyInArrow(f, _BLOCK)


def shared_counts(a_tokens: np.ndarray, a_rows: np.ndarray, n_a: int, b_tokens: np.ndarray, b_rows: np.ndarray, n_b: int, frequent: int = 12) -> np.ndarray:
    """Matrix of the numbers of tokens that rows of a share with rows of b; tokens of a row are distinct."""
    keys, b_at = np.unique(b_tokens, return_inverse=True)
    spot = np.minimum(np.searchsorted(keys, a_tokens), max(0, len(keys) - 1))
    both = keys[spot] == a_tokens if len(keys) else np.zeros(len(a_tokens), bool)
    spot, a_rows = spot[both], a_rows[both]
    often = np.bincount(b_at, minlength=len(keys))
    used = np.zeros(len(keys), bool)
    used[spot] = True
    counts = np.zeros((n_a, n_b), np.float32)
    heavy = np.flatnonzero(used & (often >= frequent))
    number = np.full(len(keys), -1)
    for k in range(0, len(heavy), 2048):
        own = heavy[k : k + 2048]
        number[:] = -1
        number[own] = np.arange(len(own))
        left, right = np.zeros((n_a, len(own)), np.float32), np.zeros((len(own), n_b), np.float32)
        x, y = number[spot], number[b_at]
        left[a_rows[x >= 0], x[x >= 0]] = 1
        right[y[y >= 0], b_rows[y >= 0]] = 1
        counts += left @ right
    light = used & (often < frequent)
    order = np.argsort(b_at, kind="stable")
    start = np.concatenate([[0], np.cumsum(often)])
    mine = light[spot]
    x, r = spot[mine], a_rows[mine]
    each = often[x]
    at = np.repeat(start[x] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    flat = np.repeat(r, each) * n_b + b_rows[order[at]]
    return counts + np.bincount(flat, minlength=n_a * n_b).reshape(n_a, n_b)


def _linked_blocks(pairs: DataFrame, percent: int, step: int = 256) -> DataFrame:
    """Links between components of two blocks (columns of the blocks, suffixed _x and _y): a, b."""

    def f(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part = {c: np.frombuffer(batch.column(c)[k].as_buffer(), "<u8" if c.startswith("tokens") else "<i8") for c in batch.schema.names}
                rows = {s: np.repeat(np.arange(len(part[f"ids_{s}"])), part[f"sizes_{s}"]) for s in "xy"}
                at = np.concatenate([[0], np.cumsum(part["sizes_x"])])
                n_y = len(part["ids_y"])
                joined: set = set()
                out_a, out_b = [], []
                for i in range(0, len(part["ids_x"]), step):
                    j = min(i + step, len(part["ids_x"]))
                    own = slice(at[i], at[j])
                    shared = shared_counts(part["tokens_x"][own], rows["x"][own] - i, j - i, part["tokens_y"], rows["y"], n_y)
                    union = part["sizes_x"][i:j, None] + part["sizes_y"][None] - shared
                    ok = (100 * shared >= percent * union) & (part["comps_x"][i:j, None] != part["comps_y"][None])
                    x, y = np.nonzero(ok)
                    for p, q, u, v in zip((x + i).tolist(), y.tolist(), part["comps_x"][x + i].tolist(), part["comps_y"][y].tolist(), strict=True):
                        edge = (u, v) if u < v else (v, u)
                        if edge not in joined:
                            joined.add(edge)
                            out_a.append(part["ids_x"][p])
                            out_b.append(part["ids_y"][q])
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
        release()

    names = [f"{c}_{s}" for s in "xy" for c in ("ids", "comps", "sizes", "tokens")]
    return pairs.select(*names).mapInArrow(f, "a long, b long")


def _cluster_links(listed: DataFrame, texts: DataFrame, words: int, percent: int, block_bytes: int) -> DataFrame:
    """Links between components among the sets of long lists. listed: rep, n, pivot, component."""
    cluster = components(listed.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("long")
    # a doc_id with several sets takes part with each of its sizes
    nodes = listed.select("rep", "n", F.col("component").alias("comp")).distinct().join(cluster.withColumnRenamed("component", "cluster"), F.col("rep") == F.col("node")).select("rep", "n", "comp", "cluster", band.alias("band"))
    nodes = materialize(nodes, "nodes")
    small = nodes.groupBy("cluster").agg((F.sum("n") * 8).alias("b")).select("cluster", (F.col("b") <= block_bytes).alias("small"))
    nodes = nodes.join(small, "cluster").withColumn("band", F.when(F.col("small"), F.lit(0)).otherwise(F.col("band"))).drop("small")
    one = nodes.groupBy("cluster", "band", "comp").agg((F.sum("n") * 8).alias("bytes"), F.count("*").alias("m"))
    kind = one.withColumn("kind", F.when(F.col("bytes") >= block_bytes, F.col("comp")).otherwise(F.lit(-1)))
    dealt = kind.groupBy("cluster", "band", "kind").agg(F.ceil(F.sum("bytes") / F.lit(block_bytes)).alias("salts"))
    dealt = kind.select("cluster", "band", "comp", "kind").join(dealt, ["cluster", "band", "kind"])
    nodes = nodes.join(dealt, ["cluster", "band", "comp"]).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
    nodes = materialize(nodes.withColumn("block", F.xxhash64("cluster", "band", "kind", "salt")), "nodes")
    content = materialize(_blocks(nodes.select(F.col("rep").alias("doc_id"), F.col("comp").alias("component"), "block").join(texts, "doc_id"), words), "blocks")
    about = nodes.groupBy("block", "cluster", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    x, y = about.alias("x"), about.alias("y")
    like = ((F.col("x.band") == F.col("y.band")) & (F.col("x.block") <= F.col("y.block"))) | (F.col("y.band") == F.col("x.band") + 1)
    differ = ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))
    met = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & like & differ).select(F.col("x.block").alias("block_x"), F.col("y.block").alias("block_y"))
    met = materialize(met.filter("block_x != block_y"), "met")
    suffixed = lambda *ends: content.select(*[F.col(c).alias(f"{c}_{s}") for s in ends for c in content.columns])
    own = _linked_blocks(suffixed("x", "y"), percent)
    return own.unionByName(_linked_blocks(met.join(suffixed("x"), "block_x").join(suffixed("y"), "block_y"), percent))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, hot_entries: int = 20, most_hot: int = 2_000_000, short_list: int = 32, block_bytes: int = 4 << 20) -> DataFrame:
    """Classes of near-duplicate rows of docs (doc_id long, text).

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A set is the distinct shingles of `words`
    words, or the whole sequence if there are fewer; null and wordless texts have empty sets and link with nothing. Rows link
    when 100 * intersection >= percent * union. Returns one row per row of docs: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links, its own included) and n_equal (rows with an equal set, itself included; 1 for an empty
    set). Links are not counted: once two sets are in one component, no further links between them are sought. Rows with
    a null doc_id take no part and are left out; repeated doc_ids count as one node for each distinct set they have. Texts of any
    length are taken whole, other columns are not read, an empty table gives no rows. MOST_LIGHT, hot_entries, most_hot,
    short_list and block_bytes change what the join costs, never its rows.

    Equality of shingles is that of their 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    digests = materialize(_digests(docs, words), "digests")
    classes = digests.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_equal"))
    member = materialize(digests.join(classes, ["n", "d1", "d2"], "left"), "members")
    # a doc_id with several distinct sets stands for each of them: its links join them into one class
    rep_ids = member.filter("doc_id = rep").select("doc_id", "n").distinct()
    one_set = (F.min("d1") == F.max("d1")) & (F.min("d2") == F.max("d2"))
    known = member.filter("n > 0").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("rep")).alias("is_rep"), one_set.alias("alone")).filter("is_rep")
    reps = docs.join(known.select("doc_id", "alone"), "doc_id")

    histogram = {r["n"]: r["c"] for r in rep_ids.filter(F.col("n") <= MOST_LIGHT + 8).groupBy("n").agg(F.count("*").alias("c")).collect()}
    most = 100 * (MOST_LIGHT + 8) // percent  # sizes that sets of the histogram can link with
    small = docs.join(rep_ids.filter((F.col("n") > 0) & (F.col("n") <= most)).select("doc_id").distinct(), "doc_id", "left_semi").withColumn("alone", F.lit(False))
    total = _list_costs(small, words, percent, short_list) if histogram else {}
    boundary = choose_boundary(histogram, {n: total[n] / c for n, c in histogram.items() if n in total}, percent)

    # copies are counted too: that changes the order of shingles at most
    often = materialize(_entries(docs.withColumn("alone", F.lit(True)), words, percent, boundary, None).filter("NOT sure").groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= hot_entries), "often")
    counts = often.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count("*").alias("m")).orderBy(F.desc("k")).collect()
    least, room = None, most_hot
    for row in counts:  # the most frequent keys first, as many as the bound allows; any order of shingles gives right results
        room -= row["m"]
        if room < 0:
            break
        least = 2.0 ** row["k"]
    found = np.empty(0, np.int64)
    if least is not None:
        found = often.filter(F.col("c") >= least).select("key").toPandas()["key"].to_numpy()
    entries = materialize(_entries(reps, words, percent, boundary, np.sort(found.view(np.uint64))), "entries")

    # lists with one set are no use
    place = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")
    heads = F.min("rep").alias("pivot"), F.min_by(place, "rep").alias("p_place"), F.count("*").alias("c")
    first = entries.filter("NOT sure OR pos = 0").groupBy("key", "sure").agg(*heads).filter("c > 1")
    # a subset for two sizes says nothing of sets of one of them; with both, each links with those of the other size, so all are one class
    both = entries.filter("sure AND pos = 1").groupBy("key", "sure").agg(*heads, F.min("n").alias("n_low"), F.max("n").alias("n_high")).filter("n_low < n_high")
    first = first.select("key", "sure", "pivot", "p_place").unionByName(both.select("key", "sure", "pivot", "p_place"))
    listed = materialize(entries.join(first, ["key", "sure"]), "lists")
    discard(entries)
    texts = materialize(docs.join(listed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    pivot_size = rep_ids.groupBy(F.col("doc_id").alias("pivot")).agg(F.min("n").alias("pn_low"), F.max("n").alias("pn_high"))
    p_n, p_pos = F.shiftright("p_place", 32), F.col("p_place").bitwiseAND(F.lit((1 << 32) - 1))
    star = listed.filter("rep != pivot").filter(F.col("sure") | _may_link(F.col("n"), F.col("pos"), p_n, p_pos, percent)).groupBy("pivot", "rep").agg(F.max("sure").alias("sure"), F.max("n").alias("n"), F.min("n").alias("n_low"))
    star = star.join(pivot_size, "pivot").filter((F.col("n") * 100 >= F.col("pn_low") * percent) & (F.col("pn_high") * 100 >= F.col("n_low") * percent))
    star = materialize(star.select(F.col("pivot").alias("a"), F.col("rep").alias("b"), "sure"), "star")
    links = star.filter("sure").select("a", "b").unionByName(_checked(star.filter("NOT sure").select("a", "b"), texts, words, percent))
    links = materialize(links, "found")

    label = components(links)
    named = listed.join(label, F.col("rep") == F.col("node"), "left").select("key", "sure", "rep", "n", "pos", "pivot", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("key", "sure").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo != hi").select("key", "sure", "m")
    open_lists = materialize(named.join(mixed, ["key", "sure"]), "open")
    short = open_lists.filter(F.col("sure") | (F.col("m") <= short_list))
    one, two = short.alias("x"), short.alias("y")
    cross = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.sure") == F.col("y.sure")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent))
    cross = cross.filter(F.col("x.sure") | _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent))
    cross = cross.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.max("x.sure").alias("sure"))
    cross = materialize(cross.join(star.select("a", "b"), ["a", "b"], "left_anti"), "cross")
    long = open_lists.filter(~F.col("sure") & (F.col("m") > short_list)).select("rep", "n", "pivot", "component")
    blocks = _cluster_links(long, texts, words, percent, block_bytes)
    more = cross.filter("sure").select("a", "b").unionByName(_checked(cross.filter("NOT sure").select("a", "b"), texts, words, percent))
    links = materialize(links.unionByName(more).unionByName(blocks), "found")

    label = components(links.unionByName(member.filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    named = member.join(label, member["doc_id"] == label["node"], "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))
