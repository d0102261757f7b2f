"""Benchmark decontamination by Wu-Manber multi-pattern search.

Documents and items are brought to one form (lower-case words, one space between, one at each end), so a window of
consecutive item words is a byte string to find. Windows are grouped by length; each group has a shift table over
hashed blocks of bytes. A block that no window holds lets the search skip almost the length of the shortest window;
where the shift is 0, the bucket of the block's hash names the windows to compare byte by byte. Many cursors, one for
each stretch of text, move in step, so that numpy does the work of the inner loop.

The items are read in blocks of bounded bytes (a block of 4 MB has half a million windows, 25 MB in a worker); one block at a time is broadcast and searched for, and between two blocks the
rows are written with the places found so far, so a worker holds the windows of one block whatever the benchmark's size. The
words of documents never move: the operator has no shuffle.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, batch_column, first_of_row, lower_ascii, map_arrow, materialize, slices, span_hashes, text_buffers, word_spans

WINDOW = 13
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 18
#: Bytes of text for each cursor.
STRETCH = 4096


def normal_form(raw: np.ndarray, offsets: np.ndarray):
    """The texts' words with one space between, before and after; start of each word in it; words of each row."""
    starts, ends, first = word_spans(raw, offsets, ALNUM)
    if not len(starts):
        return np.full(8, 32, np.uint8), starts, np.zeros(len(offsets) - 1, np.int64), first
    sizes = ends - starts + 1
    row = first_of_row(first, len(starts))
    at = np.concatenate([[0], np.cumsum(sizes)])
    at = at[:-1] + row + 1  # one more space for each row begun
    out = np.full(int(at[-1] + sizes[-1]) + 8, 32, np.uint8)
    inside = ALNUM[raw]
    take = np.repeat(at - starts, ends - starts)
    where = np.flatnonzero(inside)
    out[where + take] = lower_ascii(raw[where])
    return out, at, np.diff(first), first


def _blocks(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes (8 at most) from each position on, as a number."""
    view = np.ndarray(max(0, len(data) - 7), "<u8", buffer=data.data, strides=(1,))
    return view[at] & np.uint64((1 << 8 * size) - 1)


def _slot(blocks: np.ndarray) -> np.ndarray:
    return (blocks * _MIX) >> np.uint64(64 - _TABLE_BITS)


class Group:
    """Windows of similar length with their shift table and suffix buckets. A window is a stretch of the items' own text: nothing of it is
    copied. numbers: those of the windows; start, size: their stretches in `data`."""

    def __init__(self, data: np.ndarray, numbers: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.m = int(size.min())
        self.size = min(8, max(2, self.m // 2))
        self.shift = np.full(1 << _TABLE_BITS, self.m - self.size + 1, np.int32)
        for j in range(self.m - self.size + 1):  # later blocks have smaller shifts
            self.shift[_slot(_blocks(data, start + j, self.size))] = self.m - self.size - j
        suffix = _blocks(data, start + self.m - self.size, self.size)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.numbers, self.start, self.length = suffix[order], numbers[order], start[order], size[order]

    def search(self, data: np.ndarray, text: bytes, n: int, items: bytes):
        """(position, window number) of every occurrence in the first n bytes."""
        last = n - self.m
        if last < 0:
            return
        at = np.arange(0, last + 1, STRETCH)
        stop = np.minimum(at + STRETCH, last + 1)
        while len(at):
            block = _blocks(data, at + self.m - self.size, self.size)
            shift = self.shift[_slot(block)]
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                low = np.searchsorted(self.suffix, block[zero], "left")
                high = np.searchsorted(self.suffix, block[zero], "right")
                for k in np.flatnonzero(high > low):
                    p = int(at[zero[k]])
                    for i in range(low[k], high[k]):
                        a = int(self.start[i])
                        if text.startswith(items[a : a + int(self.length[i])], p):
                            yield p, int(self.numbers[i])
            at = at + np.maximum(shift, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]


class Matcher:
    """All windows of some items, (item id, text): the items' text in one form, and for each distinct window its stretch there, its words
    and the items that have it (`owner` from owner_at on). Some 40 bytes a window."""

    def __init__(self, items: list[tuple], window: int):
        raw, offsets = text_buffers(pa.array([text or "" for _, text in items], pa.string()))
        form, at, counts, first = normal_form(raw, offsets)
        self.ids, self.text = [item for item, _ in items], form.tobytes()
        row = first_of_row(first, len(at))
        left = first[row + 1] - np.arange(len(at)) if len(at) else np.empty(0, np.int64)  # words from each on
        begins = (left >= window) | (np.arange(len(at)) == first[row]) if len(at) else np.empty(0, bool)
        begin = np.flatnonzero(begins)
        words = np.minimum(left[begin], window)
        start = at[begin] - 1
        last = begin + words - 1
        ends_row = last + 1 == first[row[begin] + 1] if len(begin) else np.empty(0, bool)
        following = np.append(at, 0)[np.minimum(last + 1, len(at))]
        row_end = np.append(at, 0)[first[row[begin] + 1] - 1] if len(begin) else np.empty(0, np.int64)
        size = np.where(ends_row, self._word_ends(form, row_end) + 1, following) - start
        key = np.empty(len(begin), np.uint64)
        for k in range(0, len(begin), 1 << 16):  # windows in the order of the text
            a, b = int(start[k]), int((start + size)[k : k + (1 << 16)].max())
            key[k : k + (1 << 16)] = span_hashes(form[a:b], start[k : k + (1 << 16)] - a, (start + size)[k : k + (1 << 16)] - a, fold=False)
        order = np.argsort(key, kind="stable")
        start, size, words, item, key = start[order], size[order], words[order], row[begin][order], key[order]
        new = np.ones(len(order), bool)
        for k in np.flatnonzero(key[1:] == key[:-1]).tolist():  # equal hashes: the same window, unless the bytes say otherwise
            a, b = int(start[k]), int(start[k + 1])
            new[k + 1] = self.text[a : a + int(size[k])] != self.text[b : b + int(size[k + 1])]
        self.owner_at = np.append(np.flatnonzero(new), len(order))
        self.owner, self.words = item.astype(np.int32), words[new].astype(np.int32)
        start, size = start[new], size[new].astype(np.int32)
        kind = np.minimum(7, np.frexp(size.astype(np.float64))[1])
        self.groups = []
        for k in np.unique(kind):
            own = np.flatnonzero(kind == k)
            self.groups.append(Group(form, own.astype(np.int32), start[own], size[own]))

    @staticmethod
    def _word_ends(form: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the words that begin at these places end."""
        blank = np.flatnonzero(form == 32)
        return blank[np.searchsorted(blank, at)]

    def find(self, raw: np.ndarray, offsets: np.ndarray):
        """Words of each row, hit words of each row, and the items found in each row."""
        form, at, n_words, first = normal_form(raw, offsets)
        hit = np.zeros(len(at) + 1, np.int64)
        items: dict[int, set] = defaultdict(set)
        text = form.tobytes()
        for group in self.groups:
            for position, number in group.search(form, text, len(form) - 8, self.text):
                word = int(np.searchsorted(at, position + 1))
                hit[word] += 1
                hit[min(word + int(self.words[number]), len(at))] -= 1
                own = self.owner[self.owner_at[number] : self.owner_at[number + 1]]
                items[int(np.searchsorted(first, word, "right")) - 1].update(self.ids[i] for i in own.tolist())
        return n_words, np.cumsum(hit)[:-1] > 0, items, first


def _blocks_of_items(benchmark: DataFrame, block_bytes: int):
    """Items (id, text) in lists of about block_bytes, which the driver holds one at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 8
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


#: Runs of hit words (first word, the word after) and items found, as far as the blocks have been searched.
_SOFAR = T.StructType([T.StructField("runs", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
MARKS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20, keep: bool = False) -> DataFrame:
    """Mark the rows of docs (doc_id, text) that hold passages of benchmark (item_id, text).

    Words are runs of ASCII letters and digits and of all non-ASCII characters, with A-Z in lower case. A document
    word inside an occurrence of a window (`window` consecutive words of an item; all its words if it has fewer) is
    hit. Returns doc_id, n_words, n_hit, n_items, items_sha256 (of the found item_ids, sorted as strings and joined
    by commas) and contaminated: some hits, and a twentieth of the words at least; with keep, after all columns of docs, of
    which those with these names are replaced (see common.beside to keep them). Null, empty and wordless texts have
    no words and are clean, texts of any length are searched whole; an item without words matches nothing; repeated rows, and
    rows without a doc_id, are marked each by itself; of items that share an id or a window, each id counts once. With an empty
    benchmark all rows are clean; empty docs give no rows.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in MARKS] if keep else ["doc_id"]
    held = "sofar_"
    while held in {c.lower() for c in docs.columns}:
        held += "_"
    rows = docs.select(*dict.fromkeys([*kept, "text"])).withColumn(held, F.lit(None).cast(_SOFAR))
    blocks = _blocks_of_items(benchmark, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(Matcher(block, window))
        if following:
            rows = materialize(_searched(rows, shared, kept, held, last=False), "searched")
            shared.destroy()
        else:
            rows = _searched(rows, shared, kept, held, last=True)
        block = following or None
    return rows


def _searched(rows: DataFrame, shared, kept: list[str], held: str, last: bool) -> DataFrame:
    """Rows with what a block's windows add to the places found; after the last block, with the marks."""
    columns = [c for c in rows.columns if c != held]

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_buffers(batch_column(batch, "text"))
        before = batch.column(held).to_pylist()
        words, hits, counts, digests, sofar = [], [], [], [], []
        for a, b in slices(offsets):
            own, part = offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]
            n_words, hit, named, first = shared.value.find(part, own)
            for row in range(b - a):
                items = set(map(str, named.get(row, ())))
                found = hit[first[row] : first[row + 1]]
                if before[a + row] is not None:
                    items |= set(before[a + row]["items"])
                    for x, y in np.frombuffer(before[a + row]["runs"], "<i8").reshape(-1, 2).tolist():
                        found[x:y] = True
                if last:
                    ids = sorted(items)
                    hits.append(int(found.sum()))
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                else:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]))).astype("<i8")
                    sofar.append({"runs": edges.tobytes(), "items": sorted(items)} if len(edges) else None)
            words.append(n_words)
        if not last:
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sofar, pa.struct([("runs", pa.binary()), ("items", pa.list_(pa.string()))]))], names=[*columns, held])
        n, h = np.concatenate(words), np.array(hits, np.int64)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array((h > 0) & (20 * h >= n))],
            names=[*kept, *MARKS],
        )

    if not last:
        return map_arrow(rows, mark, T.StructType([*(rows.schema[c] for c in columns), T.StructField(held, _SOFAR)]))
    marks = [T.StructField(c, T.LongType()) for c in MARKS[:3]] + [T.StructField(MARKS[3], T.StringType()), T.StructField(MARKS[4], T.BooleanType())]
    return map_arrow(rows, mark, T.StructType([*(rows.schema[c] for c in kept), *marks]))
