"""Corpus-wide counts by request and answer.

Rows are dealt to groups of bounded text. Each group asks, once for each of its distinct keys, how often the corpus
has the key; keys travel sorted and split into byte planes, so that the shuffle compresses them. A bucket of the key
space adds the counts of all groups and answers each group's list. Nothing passes through the driver, a frequent key
is added up within its group first, and no group or bucket grows with the corpus: their numbers do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUEST = "bucket int, g int, keys binary, counts binary"


def dealt(docs: DataFrame, group_bytes: int) -> tuple[DataFrame, int]:
    """docs (doc_id, text, ...) with a group number g; and the number of groups, in proportion to all text."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(4, -(-int(total) // group_bytes))
    return docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in eight planes of bytes, the highest first."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return steps.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def unique_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs, or the sum of its weights."""
    if weights is None:
        found, counts = np.unique(keys, return_counts=True)
        return found, counts.astype(np.int64)
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else np.empty(0, np.int64)


def bucket_rows(g: int, keys: np.ndarray, counts: np.ndarray, n_buckets: int, base: int = 0) -> list[tuple]:
    """One row for each bucket: ranges of the sorted keys. base: number of the first bucket."""
    edges = (np.arange(1, n_buckets, dtype=np.float64) * (2.0**64 / n_buckets)).astype(np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    return [
        (base + b, g, pack(keys[i:j]), counts[i:j].astype("<u4").tobytes())
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        if j > i
    ]


def added(table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """A bucket's requests: groups, their keys, and the distinct keys with the counts of all groups."""
    groups = table.column("g").to_pylist()
    lists = [unpack(x) for x in table.column("keys").to_pylist()]
    counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("counts").to_pylist()]
    keys, totals = unique_counts(np.concatenate(lists), np.concatenate(counts))
    return groups, lists, keys, totals


def answers(table, kind: str = "<i8") -> tuple[np.ndarray, np.ndarray]:
    """A group's answers as sorted keys and totals (written as `kind`)."""
    if not table.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = np.concatenate([unpack(x) for x in table.column("keys").to_pylist()])
    totals = np.concatenate([np.frombuffer(x, kind) for x in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], totals[order]


def look_up(keys: np.ndarray, totals: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Totals of the wanted keys, 0 for unknown ones."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, totals[at], 0)
