"""Repeated passages by content-defined chunking with a gear rolling hash.

The gear hash of a byte is that of the last 16 bytes of its row. Of every 40 neighbouring bytes of a row, a cut falls after the one
with the smallest hash, the last one of equals; so chunks have 40 bytes at most, cuts depend on nearby bytes alone, and
chunks line up again soon after an insertion. Two equal stretches of 95 bytes have a whole chunk in common, from the 55th
byte on, and up to the 40th byte from the end, whatever they hold.

Chunk digests are counted over the corpus (see ledger), with the smallest doc_id that has each. Runs of repeated chunks, with
64 bytes at either side, are the regions that can hold a passage. A repetition of 51 words has 12 stretches of 40 words; of
the stretches of a region that has so many, those are counted over the corpus that have the smallest hash of 12 neighbours. A run is
a repeated passage if such a stretch of its region is found in two rows: so every repetition of 51 words is found, and no
run is named for less than 40.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ledger
from .common import SPACED, batch_column, materialize, slices, span_hashes, text_buffers, word_spans

_GEAR = np.random.Generator(np.random.PCG64(99)).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Neighbouring bytes of which one is followed by a cut.
WINDOW = 40
#: Bytes from a run's ends to those of the repetition it is part of, at most.
REACH = 64
#: Neighbouring stretches of words of which one is counted.
STRETCHES = 12


def gear_hash(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """h(i) = sum of gear[byte i-k] << k over the last 16 bytes of i's row, by doubling the span four times.

    place: distance of every byte from the begin of its row."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        more = h.copy()
        more[k:] += np.where(place[k:] >= k, h[:-k] << np.uint32(k), np.uint32(0))
        h = more
    return h


def least_of(hashes: np.ndarray, window: int, left: np.ndarray) -> np.ndarray:
    """Places of the smallest of every `window` neighbours, the last of equal ones; left: how many of the same row are
    left from each place on, itself included."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    top = np.uint64(0xFFFFFFFF)
    key = (hashes.astype(np.uint64) << np.uint64(32)) | (top - np.arange(len(hashes), dtype=np.uint64))
    span = 1
    while 2 * span <= window:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    rest = window - span
    key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
    found = (top - (key & top)).astype(np.int64)[left[: len(key)] >= window]
    return found[np.diff(found, prepend=-1) != 0]


def chunks(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """Start and end of every chunk, and its row."""
    if not len(raw):
        return (np.empty(0, np.int64),) * 3
    sizes = np.diff(offsets)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], sizes)
    cuts = least_of(gear_hash(raw, place), window, np.repeat(sizes, sizes) - place) + 1
    starts = np.union1d(offsets[:-1][sizes > 0], cuts[cuts < len(raw)])
    return starts, np.append(starts[1:], len(raw)), np.searchsorted(offsets, starts, "right") - 1


def _chunked(column: pa.Array):
    raw, offsets = text_buffers(column)
    for a, b in slices(offsets):
        own, part = offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]
        starts, ends, row = chunks(part, own)
        yield a, part, own, starts, ends, row, span_hashes(part, starts, ends, fold=False)


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _stretches(part: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, words: int):
    """Counted stretches of the regions around runs (starts, ends, row): key, start, end, run.

    A region runs to the words within REACH of its run; regions of fewer than words + STRETCHES - 1 words have none."""
    first, last, of_row = word_spans(part, own, SPACED)
    low = np.maximum(np.searchsorted(first, starts - REACH), of_row[row])
    high = np.minimum(np.searchsorted(last, ends + REACH, "right"), of_row[row + 1])
    n = np.maximum(high - low - words + 1, 0)
    n[n < STRETCHES] = 0
    run = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = low[run] + number
    key = span_hashes(part, first[at], last[at + words - 1], fold=False) if len(at) else np.empty(0, np.uint64)
    picked = least_of(key >> np.uint64(32), STRETCHES, n[run] - number)
    return key[picked], first[at[picked]], last[at[picked] + words - 1], run[picked]


_KINDS = {"bucket": pa.int32(), "g": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "owners": pa.binary()}
_MARKED = "bucket int, g int, keys binary, counts binary, doc_id long, runs binary, stretches binary"


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def repeated_passages(docs: DataFrame, words: int = 51, group_bytes: int = 16 << 20) -> DataFrame:
    """Passages of docs (doc_id long, text) that other rows have too: a row for each row of docs that holds any.

    Every repetition of `words` words (runs of bytes other than ASCII white space, equal byte by byte) in two rows is part
    of a passage of both, but for up to 64 bytes at either end; no passage is named without a repetition of words - 11. Its span
    is that of neighbouring chunks that two rows have, and of the counted stretches found twice. The row with
    the smallest doc_id keeps a chunk; elsewhere it may go. Returns doc_id, n_spans, repeated_bytes, removable_bytes, spans
    (start, end: bytes of the UTF-8 text; first_doc: the smallest doc_id that has the span's first repeated chunk).

    Rows with a null doc_id or a null or empty text have no passages; repeated rows repeat each other; a repetition within one row
    alone is none. Texts of any length are taken whole, other columns are not read, an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    docs, n = ledger.dealt(docs, group_bytes)
    stretch = words - STRETCHES + 1

    def ask(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        ids = batch_column(table, "doc_id").to_numpy()
        keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for a, _, _, _, _, row, digest in _chunked(batch_column(table, "text")):
            order = np.lexsort((digest, row))
            k, r = digest[order], row[order]
            new = _first_of(k, r)
            keys.append(k[new])
            owners.append(ids[a + r[new]])
        k, o = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        first = np.flatnonzero(_first_of(k)) if len(k) else np.empty(0, np.int64)
        own, at, out = o[first], 0, []
        for bucket, g_, packed, c in ledger.bucket_rows(g, k[first], np.diff(np.append(first, len(k))), n):
            size = len(c) // 4
            out.append((bucket, g_, packed, c, own[at : at + size].astype("<i8").tobytes()))
            at += size
        return _table(out, _KINDS)

    def settle(table: pa.Table) -> pa.Table:
        """Answers name only the repeated chunks of a group, with their first owner."""
        groups, lists, keys, totals = ledger.added(table)
        owners = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("owners").to_pylist()])
        flat = np.concatenate(lists)
        order = np.lexsort((owners, flat))
        least_owner = owners[order][np.searchsorted(flat[order], keys)]
        rows = []
        for g, x in zip(groups, lists, strict=True):
            at = np.searchsorted(keys, x)
            twice = totals[at] > 1
            if twice.any():
                rows.append((g, ledger.pack(x[twice]), least_owner[at[twice]].astype("<i8").tobytes()))
        return _table(rows, {"g": pa.int32(), "keys": pa.binary(), "counts": pa.binary()})

    asked = docs.groupBy("g").applyInArrow(ask, ledger.REQUEST + ", owners binary")
    told = materialize(asked.groupBy("bucket").applyInArrow(settle, "g int, keys binary, counts binary"), "chunks")

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        """A group's runs and counted stretches by row, and what it asks of the stretches."""
        keys, owners = ledger.answers(right)
        ids = batch_column(left, "doc_id").to_numpy()
        rows, asks = [], [np.empty(0, np.uint64)]
        for a, part, own, starts, ends, row, digest in _chunked(batch_column(left, "text")) if len(keys) else ():
            at = np.minimum(np.searchsorted(keys, digest), len(keys) - 1)
            twice = keys[at] == digest
            owner = np.where(twice, owners[at], -1)
            first = np.flatnonzero(_first_of(twice, row))
            last = np.append(first[1:], len(row)) - 1
            first, last = first[twice[first]], last[twice[first]]
            gone = np.concatenate([[0], np.cumsum((ends - starts) * (twice & (owner != ids[a + row])))])
            key, s, e, run = _stretches(part, own, starts[first], ends[last], row[first], stretch)
            used = np.unique(run)
            for r in np.unique(row[first[used]]):
                mine = used[row[first[used]] == r]
                runs = np.stack([starts[first[mine]] - own[r], ends[last[mine]] - own[r], gone[last[mine] + 1] - gone[first[mine]], owner[first[mine]]], 1)
                has = np.flatnonzero(np.isin(run, mine))
                asks.append(np.unique(key[has]))
                spans = np.stack([key[has].view(np.int64), s[has] - own[r], e[has] - own[r], np.searchsorted(mine, run[has])], 1)
                rows.append((None, left.column("g")[0].as_py(), None, None, int(ids[a + r]), runs.astype("<i8").tobytes(), spans.astype("<i8").tobytes()))
        k, c = ledger.unique_counts(np.concatenate(asks))
        rows += [(*x, None, None, None) for x in ledger.bucket_rows(left.column("g")[0].as_py() if left.num_rows else 0, k, c, n)]
        return _table(rows, {**{c: _KINDS[c] for c in ("bucket", "g", "keys", "counts")}, "doc_id": pa.int64(), "runs": pa.binary(), "stretches": pa.binary()})

    marked = materialize(docs.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(mark, _MARKED), "runs")

    def confirm(table: pa.Table) -> pa.Table:
        groups, lists, keys, totals = ledger.added(table)
        rows = [(g, ledger.pack(x[totals[np.searchsorted(keys, x)] > 1])) for g, x in zip(groups, lists, strict=True)]
        return _table([r for r in rows if r[1]], {"g": pa.int32(), "keys": pa.binary()})

    found = marked.filter("bucket IS NOT NULL").select("bucket", "g", "keys", "counts").groupBy("bucket").applyInArrow(confirm, "g int, keys binary")

    def name(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.empty(0, np.uint64), *map(ledger.unpack, right.column("keys").to_pylist())]))
        out = []
        spans_of = [np.frombuffer(x, "<i8").reshape(-1, 4) for x in left.column("stretches").to_pylist()]
        asked = np.concatenate([x[:, 0] for x in spans_of]).view(np.uint64) if spans_of else np.empty(0, np.uint64)
        twice = np.split(ledger.look_up(keys, np.ones(len(keys), np.int64), asked) > 0, np.cumsum([len(x) for x in spans_of])[:-1])
        for doc, r, s, both in zip(left.column("doc_id").to_pylist(), left.column("runs").to_pylist(), spans_of, twice, strict=True):
            if not both.any():
                continue
            runs, s = np.frombuffer(r, "<i8").reshape(-1, 4).copy(), s[both]
            np.minimum.at(runs[:, 0], s[:, 3], s[:, 1])
            np.maximum.at(runs[:, 1], s[:, 3], s[:, 2])
            spans: list[dict] = []
            gone = 0
            for start, end, own, first in runs[np.unique(s[:, 3])].tolist():
                gone += own
                if spans and start <= spans[-1]["end"]:
                    spans[-1]["end"] = max(end, spans[-1]["end"])
                else:
                    spans.append({"start": start, "end": end, "first_doc": first})
            out.append((doc, len(spans), sum(x["end"] - x["start"] for x in spans), gone, spans))
        return _table(out, {"doc_id": pa.int64(), "n_spans": pa.int64(), "repeated_bytes": pa.int64(), "removable_bytes": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc", pa.int64())]))})

    rows = marked.filter("bucket IS NULL").select("g", "doc_id", "runs", "stretches")
    return rows.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(name, "doc_id long, n_spans long, repeated_bytes long, removable_bytes long, spans array<struct<start: long, end: long, first_doc: long>>")
