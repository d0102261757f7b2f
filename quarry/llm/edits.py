"""Edit-aware token counts.

Each document's text is kept as leaves of a segment tree: runs of pre-token pieces with their bytes and token counts. An
edit finds its leaves by descending the byte sums, rewrites them together with one leaf on each side (an edit can change how
the text next to it is cut), re-encodes that region alone, and updates the sums above it. Edits of one round, one for each
document of a group, are encoded together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_column, slices, text_buffers
from .repair import WordEncoder, encoder_for, load_tokenizer

#: Pieces of a new leaf.
PIECES = 32


class DocumentTree:
    """Leaves of one text; sums of bytes and of tokens over a complete binary tree. A leaf may be empty: room for others to be split."""

    def __init__(self, leaves: list[bytes], counts: list[int]):
        self._build(leaves or [b""], counts or [0])

    def _build(self, leaves: list[bytes], counts: list[int]) -> None:
        self.leaves = leaves
        self.n = 1 << (len(leaves) - 1).bit_length()
        self.size = [0] * (2 * self.n)
        self.tokens = [0] * (2 * self.n)
        self.size[self.n : self.n + len(leaves)] = map(len, leaves)
        self.tokens[self.n : self.n + len(counts)] = counts
        for i in range(self.n - 1, 0, -1):
            self.size[i] = self.size[2 * i] + self.size[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_bytes(self) -> int:
        return self.size[1]

    def leaf_at(self, byte: int) -> tuple[int, int]:
        """The leaf that holds the byte (the last one for the end of the text), and where in it."""
        i = 1
        while i < self.n:
            i *= 2
            if byte >= self.size[i] and self.size[i + 1]:
                byte -= self.size[i]
                i += 1
        return i - self.n, byte

    def region(self, start: int, end: int, new: bytes) -> tuple[int, int, bytes]:
        """First and last leaf to rewrite for the edit, and their new bytes."""
        first, inside = self.leaf_at(start)
        last, _ = self.leaf_at(max(start, end - 1))
        low = first - 1
        while low > 0 and not self.size[self.n + low]:
            low -= 1
        high = last + 1
        while high < len(self.leaves) - 1 and not self.size[self.n + high]:
            high += 1
        low, high = max(0, low), min(high, len(self.leaves) - 1)
        before = b"".join(self.leaves[low:first])
        old = b"".join(self.leaves[low : high + 1])
        at = len(before) + inside
        return low, high, old[:at] + new + old[at + end - start :]

    def rewrite(self, low: int, high: int, data: bytes, starts: np.ndarray, counts: np.ndarray) -> None:
        """Put data, cut into pieces at starts, into the leaves from low to high, and update the sums above.

        Where these leaves would hold over 2 * PIECES pieces each, they are split into leaves of PIECES, and the tree is built anew. Some
        empty leaves follow (the square root of all), so that comes to pass once in so many splits of a place.
        """
        slots = high - low + 1
        if len(starts) > 2 * PIECES * slots:
            at = [*starts[::PIECES].tolist(), len(data)]
            own = [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
            sums = np.add.reduceat(counts, np.arange(0, len(counts), PIECES)).tolist()
            before, after = self._filled(0, low), self._filled(high + 1, len(self.leaves))
            room = 8 + math.isqrt(len(before[0]) + len(own) + len(after[0]))
            self._build([*before[0], *own, *[b""] * room, *after[0]], [*before[1], *sums, *[0] * room, *after[1]])
            return
        share = max(PIECES, -(-len(starts) // slots))
        for k in range(slots):
            own = starts[k * share : (k + 1) * share]
            end = starts[(k + 1) * share] if (k + 1) * share < len(starts) else len(data)
            self.leaves[low + k] = data[own[0] : end] if len(own) else b""
            self.size[self.n + low + k] = len(self.leaves[low + k])
            self.tokens[self.n + low + k] = int(counts[k * share : (k + 1) * share].sum())
        a, b = (self.n + low) // 2, (self.n + high) // 2
        while a:
            for i in range(a, b + 1):
                self.size[i] = self.size[2 * i] + self.size[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            a, b = a // 2, b // 2

    def _filled(self, low: int, high: int) -> tuple[list[bytes], list[int]]:
        """The leaves from low up to high that are not empty, and their tokens."""
        own = [k for k in range(low, high) if self.leaves[k]]
        return [self.leaves[k] for k in own], [self.tokens[self.n + k] for k in own]

    def text(self) -> bytes:
        return b"".join(self.leaves)


def trees(encoder: WordEncoder, raw: np.ndarray, offsets: np.ndarray) -> list[DocumentTree]:
    """One tree for each row."""
    starts, counts = encoder.count(raw, offsets)
    data, out = raw.tobytes(), []
    first = np.searchsorted(starts, offsets)
    total = np.concatenate([[0], np.cumsum(counts)])
    for r in range(len(offsets) - 1):
        cut = np.arange(first[r], first[r + 1], PIECES)
        at = [*starts[cut].tolist(), int(offsets[r + 1])] if len(cut) else [int(offsets[r])]
        sums = np.diff(total[np.append(cut, first[r + 1])]).tolist() if len(cut) else []
        out.append(DocumentTree([data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], sums))
    return out


def _clip(tree: DocumentTree, start: int, end: int) -> tuple[int, int]:
    """The edit within the text, moved back to where characters begin."""
    total = tree.n_bytes

    def whole(byte: int) -> int:
        byte = min(max(0, byte), total)
        while 0 < byte < total:
            leaf, inside = tree.leaf_at(byte)
            if tree.leaves[leaf][inside] & 0xC0 != 0x80:
                break
            byte -= 1
        return byte

    start = whole(start)
    return start, max(start, whole(end))


def count_edits(docs: DataFrame, edits: DataFrame, tokenizer_path: str, group_bytes: int = 8 << 20, load=load_tokenizer) -> DataFrame:
    """Token counts of docs (doc_id long, text) before and after their edits (doc_id, seq, start, end, new).

    Edits of a document are applied in the order of seq (ties: start, end, new), each to the text the ones before left: bytes
    start to end are replaced by new. Positions beyond the text are clipped to it, those within a character moved back to its
    beginning; null positions are 0, a null new is empty. A null text is empty, and can be edited. Edits of unknown documents
    are ignored; repeated rows of a doc_id are all edited. Returns doc_id, tokens_before, tokens_after, n_edits,
    n_bytes (after), reencoded_bytes (of all regions that the edits touched). Rows with a null doc_id have no edits. A group holds
    about group_bytes of texts and edits; a document's own edits, which follow each other, are never parted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    edits = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce(F.col("start").cast("long"), F.lit(0)).alias("start"), F.coalesce(F.col("end").cast("long"), F.lit(0)).alias("end"), F.coalesce(F.col("new").cast("string"), F.lit("")).alias("new")).filter("doc_id IS NOT NULL")
    total = (docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0) + (edits.agg(F.sum(F.octet_length("new") + 64).alias("b")).first()["b"] or 0)
    n = max(4, -(-int(total) // group_bytes))
    key = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        encoder = encoder_for(tokenizer_path, load)
        script: dict[int, list] = {}
        for d, *edit in sorted(zip(*(right.column(c).to_pylist() for c in ("doc_id", "seq", "start", "end", "new")), strict=True)):
            script.setdefault(d, []).append(edit)
        ids = left.column("doc_id").to_pylist()
        raw, offsets = text_buffers(batch_column(left, "text"))
        out = []
        for a, b in slices(offsets):
            own = trees(encoder, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            before = [t.n_tokens for t in own]
            todo = [script.get(ids[a + k], []) for k in range(b - a)]
            again = [0] * (b - a)
            for step in range(max(map(len, todo), default=0)):
                at, regions = [], []
                for k, edit in enumerate(todo):
                    if step < len(edit):
                        _, start, end, new = edit[step]
                        low, high, data = own[k].region(*_clip(own[k], start, end), new.encode())
                        at.append((k, low, high))
                        regions.append(data)
                        again[k] += len(data)
                ends = np.cumsum([0, *map(len, regions)])
                joined = np.frombuffer(b"".join(regions), np.uint8)
                starts, counts = encoder.count(joined, ends)
                first = np.searchsorted(starts, ends)
                for i, (k, low, high) in enumerate(at):
                    own[k].rewrite(low, high, regions[i], starts[first[i] : first[i + 1]] - ends[i], counts[first[i] : first[i + 1]])
            out += [(ids[a + k], before[k], own[k].n_tokens, len(todo[k]), own[k].n_bytes, again[k]) for k in range(b - a)]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names=["doc_id", "tokens_before", "tokens_after", "n_edits", "n_bytes", "reencoded_bytes"])

    return docs.withColumn("g", key).groupBy("g").cogroup(edits.withColumn("g", key).groupBy("g")).applyInArrow(f, "doc_id long, tokens_before long, tokens_after long, n_edits long, n_bytes long, reencoded_bytes long")
