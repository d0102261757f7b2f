"""Ranked lexical search by windowed bucket scoring.

`build` writes an inverted index. Documents are put in order of their ids; those of a fixed range of ids are a window, and each window
has its own postings: for every term the places of its documents in the window, with the occurrences. `search` reads the
windows in order. For one of them it has a score for each place (an array that fits a core's first cache) and a bit for each
place that some term of the item occurs at. A term's postings are scattered into the scores and its bits into the bit set; then
the set bits are harvested: scores that beat the least one of the item's heap go into it. So an item never holds more than a window's
scores and its best documents; the heaps of all tasks are merged by Spark.

Terms are known by 64-bit hashes. Scores are whole numbers, so the order of addition does not matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, batch_column, first_of_row, map_arrow, release, scratch_path, slices, span_hashes, text_buffers, word_spans

#: Ids of a window, and places of one: rows beyond them, which repeat ids, go to a further window of the same range.
WINDOW = 4096
#: Words of a window at most, but for those of a single document.
MOST_WORDS = 1 << 21
#: Stands for a missing doc_id, which comes after all others.
NO_ID = np.iinfo(np.int64).max

INDEX = "window long, n_docs long, n_terms long, doc_id binary, length binary, term binary, df binary, place binary, tf binary"


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of the rows, and the terms of each row."""
    starts, ends, first = word_spans(raw, offsets, ALNUM)
    return span_hashes(raw, starts, ends), np.diff(first)


class _Open:
    """The window that is being filled."""

    def __init__(self):
        self.window, self.ids, self.lengths, self.terms, self.n_words = None, [], [], [], 0

    def add(self, doc_id: int, terms: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.terms.append(terms)
        self.n_words += len(terms)

    def row(self) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        term, inverse = np.unique(np.concatenate(self.terms), return_inverse=True)
        key, tf = np.unique(inverse * WINDOW + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
        of, place = key // WINDOW, key % WINDOW
        columns = [np.array(self.ids, "<i8"), lengths.astype("<i8"), term.astype("<u8"), np.bincount(of, minlength=len(term)).astype("<i4"), place.astype("<u2"), tf.astype("<i4")]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.window], pa.int64()), pa.array([len(lengths)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
            names=[c.split()[0] for c in INDEX.split(", ")],
        )


def build(docs: DataFrame, path: str | None = None) -> str:
    """Write the index of docs (doc_id, text); its folder. See search for what counts as a document."""
    path = path or scratch_path(docs.sparkSession, "postings")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Open()
        for batch in batches:
            raw, offsets = text_buffers(batch_column(batch, "text"))
            ids = batch_column(batch, "doc_id").to_numpy()
            for a, b in slices(offsets):
                terms, counts = _terms(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.cumsum(counts) - counts
                for k in np.flatnonzero(counts).tolist():
                    window = int(ids[a + k]) // WINDOW
                    if now.ids and (window != now.window or len(now.ids) == WINDOW or now.n_words + counts[k] > MOST_WORDS):
                        yield now.row()
                        now = _Open()
                    now.window = window
                    now.add(int(ids[a + k]), terms[at[k] : at[k] + counts[k]])
        if now.ids:
            yield now.row()
        release()

    # rows that repeat an id (or have none) spread by their texts
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ordered.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)
    return path


class _Block:
    """Terms of a block of items: hashes in order, and for each item the numbers of its terms with their repeats."""

    def __init__(self, items: list[str]):
        raw, offsets = text_buffers(pa.array(items, pa.string()))
        terms, counts = _terms(raw, offsets)
        self.terms, number = np.unique(terms, return_inverse=True)
        key, repeats = np.unique(first_of_row(np.concatenate([[0], np.cumsum(counts)]), len(terms)) * max(1, len(self.terms)) + number, return_counts=True)
        edge = np.searchsorted(key, np.arange(len(items) + 1) * max(1, len(self.terms)))
        self.items = [(key[a:b] - i * max(1, len(self.terms)), repeats[a:b]) for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))]

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of this block's terms that a window has, and where they are there."""
        at = np.minimum(np.searchsorted(terms, self.terms), max(0, len(terms) - 1))
        own = np.flatnonzero(terms[at] == self.terms) if len(terms) else np.empty(0, np.int64)
        return own, at[own]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, _Block]]:
    """Ids and terms of the items, in blocks of about block_bytes, one at a time in the driver."""
    texts = items.select("item_id", "text").filter("text IS NOT NULL").distinct().groupBy("item_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("text"))
    ids, own, size = [], [], 0
    for r in texts.toLocalIterator():
        ids.append(r["item_id"])
        own.append(r["text"])
        size += len(r["text"]) + 8
        if size >= block_bytes:
            yield ids, _Block(own)
            ids, own, size = [], [], 0
    if ids:
        yield ids, _Block(own)


def _frequencies(index: DataFrame, shared) -> np.ndarray:
    """Documents that hold each of the block's terms: every task adds up its windows."""

    def run(batches):
        block = shared.value
        total = np.zeros(len(block.terms), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                own, at = block.found(np.frombuffer(batch.column("term")[k].as_buffer(), "<u8"))
                total[own] += np.frombuffer(batch.column("df")[k].as_buffer(), "<i4")[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["number", "df"])

    out = np.zeros(len(shared.value.terms), np.int64)
    for r in index.select("term", "df").mapInArrow(run, "number long, df long").groupBy("number").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["number"]] = r["df"]
    return out


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term with weight 1 adds to a document, by its occurrences there and the document's length."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class _Scorer:
    """Scores of one window at a time, and the best documents of every item so far."""

    def __init__(self, block: _Block, weight: np.ndarray, n: int, total: int, k: int):
        self.block, self.weight, self.n, self.total, self.k = block, weight, n, total, k
        self.heaps: list[list] = [[] for _ in block.items]
        self.scores = np.zeros(WINDOW, np.int64)
        self.bits = np.zeros(WINDOW // 64, np.uint64)

    def window(self, doc_ids, length, terms, df, place, tf) -> None:
        own, at = self.block.found(terms)
        end = np.cumsum(df)
        m = 75 + (25 * length * self.n) // self.total
        postings = {}
        for number, a in zip(own.tolist(), at.tolist(), strict=True):
            where = place[end[a] - df[a] : end[a]]
            marks = np.zeros(WINDOW, np.uint8)
            marks[where] = 1
            postings[number] = where, self.weight[number] * _impact(tf[end[a] - df[a] : end[a]].astype(np.int64), m[where]), np.packbits(marks, bitorder="little").view("<u8")
        for i, (numbers, repeats) in enumerate(self.block.items):
            self.bits[:] = 0
            for number, times in zip(numbers.tolist(), repeats.tolist(), strict=True):
                if number in postings:
                    where, add, marks = postings[number]
                    self.scores[where] += times * add  # a place occurs once in a term's postings
                    self.bits |= marks
            self.harvest(i, doc_ids)

    def harvest(self, item: int, doc_ids: np.ndarray) -> None:
        """Move the scores at set bits into the item's heap, and clear them."""
        at = np.flatnonzero(np.unpackbits(self.bits.view(np.uint8), bitorder="little"))
        if not len(at):
            return
        heap, found = self.heaps[item], self.scores[at]
        self.scores[at] = 0
        least = heap[0][0] if len(heap) == self.k else 0
        beats = found >= max(least, 1)
        at, found = at[beats], found[beats]
        if len(at) > self.k:  # no more than k of a window can stay: those with the largest scores, and all their ties
            bound = np.partition(found, len(found) - self.k)[len(found) - self.k]
            at, found = at[found >= bound], found[found >= bound]
        for score, doc in zip(found.tolist(), doc_ids[at].tolist(), strict=True):
            entry = score, -doc
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _scored(index: DataFrame, shared, k: int) -> DataFrame:
    """The best documents of each task for each item of a block: item, doc_id, score."""

    def run(batches):
        block, weight, n, total = shared.value
        scorer = _Scorer(block, weight, n, total, k)
        for batch in batches:
            columns = [(batch.column(c), kind) for c, kind in (("doc_id", "<i8"), ("length", "<i8"), ("term", "<u8"), ("df", "<i4"), ("place", "<u2"), ("tf", "<i4"))]
            for r in range(batch.num_rows):
                scorer.window(*(np.frombuffer(c[r].as_buffer(), kind) for c, kind in columns))
        found = [(i, -d, s) for i, heap in enumerate(scorer.heaps) for s, d in heap]
        release()
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])

    return index.select("doc_id", "length", "term", "df", "place", "tf").mapInArrow(run, "item long, doc_id long, score long")


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 20, block_bytes: int = 1 << 20) -> DataFrame:
    """The k documents of the index at path with the highest scores for each of items (item_id, text): item_id, rank (int, from 1),
    doc_id, score; equal scores by ascending doc_id, scores above 0 alone.

    Terms are runs of ASCII letters and digits and of all non-ASCII characters, with A-Z in lower case. Each row of the indexed
    table with a term is a document, so repeated rows are ranked each by itself, next to each other; those without a doc_id rank after
    their equals; null, empty and wordless texts are no documents, and texts of any length are indexed whole. Rows of items that
    share an id are one item with the terms of their distinct texts; an item without a term, or with a null text, finds nothing.
    Empty tables give no rows. The driver holds the terms of one block of items (about block_bytes of text) at a time, and
    their frequencies; each block reads the index once more.
    """
    index = spark.read.parquet(path)
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = []
    id_field = items.schema["item_id"]
    for ids, block in _blocks(items, block_bytes) if n else ():
        shared = spark.sparkContext.broadcast(block)
        df = _frequencies(index, shared)
        shared.destroy()
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        top = _scored(index, spark.sparkContext.broadcast((block, weight, n, total)), k)
        best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = top.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {id_field.dataType.simpleString()}")
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {id_field.dataType.simpleString()}, rank int, doc_id long, score long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
