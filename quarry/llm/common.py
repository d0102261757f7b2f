"""Shared folder, Arrow batches and vectorised word handling used by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised helpers; bounds a worker's memory.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: A byte that belongs to a word: no ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: A byte that belongs to a word: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one for a local master; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors.

    The shuffle files behind it are of no more use; Spark drops them when the driver's garbage is collected, so that is asked for.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote; nothing may read df, or a frame made of it, any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def beside(docs: DataFrame, names: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that f keeps, with the columns of docs as they were: those that bear one of the names that f writes
    are put aside meanwhile."""
    aside = {c: f"aside_{k}_" for k, c in enumerate(docs.columns) if c.lower() in names}
    kept = f(docs.withColumnsRenamed(aside))
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def word_spans(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (one more at the end)."""
    inside = member[raw]
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans (A-Z lower-cased if fold): a rolling polynomial, so the cost is one pass."""
    if not len(raw):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    codes = (_BYTE_CODE[_LOWER] if fold else _BYTE_CODE)[raw]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions run over the whole array, len(words) - n + 1 of them."""
    count = max(0, len(words) - n + 1)
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + words[k : k + count])
    return h


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, and the next one may be of another stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """mapInArrow over one batch at a time."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if out is not None:
                    yield out
                del out
        release()

    return df.mapInArrow(run, schema)


def arrow_schema(fields: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(k, v) for k, v in fields.items()])


def batch_column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    col = table.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def first_of_row(offsets: np.ndarray, n: int) -> np.ndarray:
    """Row number of each of the n items that offsets deal to rows."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) if n else np.empty(0, np.int64)


def is_train(id_column, k: int):
    """False for the k-th part of the rows held out: crc32 of the id's text divides by k."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % k != 0, F.lit(True))
