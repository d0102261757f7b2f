"""WARC archives with payload deduplication, and a two-level capture index.

Records are written by the tasks to the shared folder, each as a gzip member of its own, so that a record is a range of
bytes. The index sorts the captures by reversed-host URL key into compressed blocks, one after another in the files of the index;
a sparse directory, a table of its own, holds each block's first and last key and its range of bytes. A look-up
finds the parts of the directory, then the blocks by binary search, and reads the ranges of those blocks and records alone.

An attempt that fails leaves a file that no index entry names.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

#: A WARC date has to be given; captures carry none.
DATE = "1970-01-01T00:00:00Z"
_BLOCK = "part int, block int, first_key string, last_key string, n int, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host parts reversed, then path and query: com,example)/a?b. Scheme, port, user, fragment and a leading www go."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
    except ValueError:
        return f"){url}"
    labels = host.removeprefix("www.").split(".") if host else []
    return ",".join(reversed(labels)) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A WARC record; a revisit (refers_to given) has no payload. Names and digests follow WARC 1.1."""
    kind = "revisit" if refers_to is not None else "response"
    body = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


def _open(folder: str):
    return pa.fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str | None = None, least: int = 1000, roll: int = 64 << 20) -> tuple[str, str]:
    """Archive pages (page_id, url, html) and index them. Returns the folders of the archives and of the index.

    A null html is an empty payload, a null url an empty one. Of equal payloads of at least `least` bytes, the one with the
    largest page_id is the response, the others are revisits of it; rows that share that page_id too are all responses,
    and rows with a null page_id are revisits of one that has an id. Repeated rows are records each, other columns are not
    read, and an empty table gives an empty index. Payloads are archived where they are: only ids and digests
    are grouped, and the revisits found, a small table or one dealt by page_id, meet the pages.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    page = F.col("page_id").cast("long")
    pages = pages.select(page.alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.encode("html", "UTF-8"))})
    ids = materialize(pages.filter(F.col("size") >= least).select("page_id", "digest").distinct(), "payloads")
    keep = ids.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("c")).filter("c > 1 AND keep IS NOT NULL").select("digest", "keep")
    revisits = ids.join(keep, "digest").filter("NOT page_id <=> keep").select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "keep")
    revisits = materialize(revisits, "revisits")  # its size is known then: Spark broadcasts a small one
    told = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").withColumn("refers_to", F.col("keep"))
    told = told.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))

    def run(batches):
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        out = name = None
        at = 0
        for batch in batches:
            rows = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at = store.open_output_stream(f"{base}/{name}", compression=None), 0
                page_id, url, html, size, digest, refers = r
                data = gzip.compress(record(page_id, url, (html or "").encode(), size, digest, refers), 1, mtime=0)
                out.write(data)
                rows.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
                if at >= roll:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    captures = told.select("page_id", "url", "html", "size", "digest", "refers_to").mapInArrow(run, "key string, page_id long, file string, offset long, length long")
    captures = materialize(captures, "captures")  # the files that count are those of the attempts that ended
    return folder, index(captures)


def index(captures: DataFrame, block: int = 512) -> str:
    """Blocks of the captures (key, page_id, file, offset, length) in the order of key and page_id, in files of a new folder
    (blocks), and their directory (a table: directory). Returns the folder. A key with many captures fills many blocks."""
    path = scratch_path(captures.sparkSession, "cdx")

    def run(batches):
        from pyspark import TaskContext

        store, base = _open(path)
        store.create_dir(f"{base}/blocks", recursive=True)
        part, number, at, held = TaskContext.get().partitionId(), 0, 0, []
        name = f"{uuid.uuid4().hex}.cdx.gz"
        out = None

        def flush(rows):
            nonlocal out, number, at
            if out is None:
                out = store.open_output_stream(f"{base}/blocks/{name}", compression=None)
            data = gzip.compress("\n".join("\t".join([json.dumps(k), *map(str, rest)]) for k, *rest in rows).encode(), 6, mtime=0)
            out.write(data)
            row = (part, number, rows[0][0], rows[-1][0], len(rows), name, at, len(data))
            number, at = number + 1, at + len(data)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["part", "block", "first_key", "last_key", "n", "file", "offset", "length"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True)
            while len(held) >= block:
                yield flush(held[:block])
                held = held[block:]
        if held:
            yield flush(held)
        if out is not None:
            out.close()

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    ordered.mapInArrow(run, _BLOCK).write.parquet(f"{path}/directory")
    return path


def entries(data: bytes) -> list[tuple]:
    """The captures of a block: key, page_id, file, offset, length."""
    out = []
    for line in gzip.decompress(data).decode().split("\n"):
        key, page_id, name, offset, length = line.rsplit("\t", 4)
        out.append((json.loads(key), None if page_id == "None" else int(page_id), name, int(offset), int(length)))
    return out


_ENTRY = "key string, page_id long, file string, offset long, length long"
_NAMED = "file string, offset long, length long, wanted array<string>"


#: Blocks of the directory that are searched together.
STRETCH = 256


def _stretches(directory: DataFrame, most: int = 1 << 20) -> list[tuple]:
    """The first level: part, stretch, first and last key of every STRETCH blocks, in the order of keys. One row for some
    130 000 captures; more than `most` rows are an error, as the level is broadcast."""
    rows = directory.groupBy("part", F.floor(F.col("block") / STRETCH).alias("stretch")).agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"))
    rows = [tuple(r) for r in rows.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"the first level of the index has over {most} rows: raise STRETCH")
    return sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1]))


def named_blocks(wanted: DataFrame, index_path: str) -> DataFrame:
    """Blocks that may hold the keys (column wanted, distinct): file, offset, length, and the keys wanted of each.

    Keys are searched in the first level, which is broadcast, in the tasks that read them, and dealt to its stretches; there
    they meet the directory's rows and are searched again. A key with many captures goes to all stretches that have it.
    """
    directory = wanted.sparkSession.read.parquet(f"{index_path}/directory")
    top = wanted.sparkSession.sparkContext.broadcast(_stretches(directory))

    def deal(batches):
        rows = top.value
        lows, highs = [r[2] for r in rows], [r[3] for r in rows]
        for batch in batches:
            out = [(rows[k][0], rows[k][1], key) for key in batch.column("wanted").to_pylist() for k in range(bisect_left(highs, key), bisect_right(lows, key))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True)], names=["part", "stretch", "wanted"])

    def run(left, right):
        right = right.sort_by("block")
        firsts, lasts, files, offsets, lengths = (right.column(c).to_pylist() for c in ("first_key", "last_key", "file", "offset", "length"))
        found: dict[int, list[str]] = {}
        for key in sorted(left.column("wanted").to_pylist()):
            for at in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                found.setdefault(at, []).append(key)
        columns = [[files[k] for k in found], [offsets[k] for k in found], [lengths[k] for k in found], list(found.values())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["file", "offset", "length", "wanted"])

    dealt = wanted.mapInArrow(deal, "part int, stretch long, wanted string")
    rows = directory.withColumn("stretch", F.floor(F.col("block") / STRETCH))
    return dealt.groupBy("part", "stretch").cogroup(rows.groupBy("part", "stretch")).applyInArrow(run, _NAMED)


def look_up(urls: DataFrame, index_path: str) -> DataFrame:
    """Captures of the urls (column url): the blocks that the directory names for their keys, and there a binary search.

    A url without captures gives no row; repeated urls, and urls with one key, count once. A null url has the key of an empty one.
    """

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], names=["wanted"])

    wanted = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(keyed, "wanted string").distinct()

    def run(batches):
        store, base = _open(f"{index_path}/blocks")
        for batch in batches:
            for file, offset, length, keys in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "wanted")), strict=True):
                with store.open_input_file(f"{base}/{file}") as source:
                    own = entries(source.read_at(length, offset))
                have, found = [e[0] for e in own], []
                for key in keys:
                    found += own[bisect_left(have, key) : bisect_right(have, key)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])

    return named_blocks(wanted, index_path).mapInArrow(run, _ENTRY)


def read(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Each record's range is read by itself, in the order of the files. The digest of a response is that of the bytes read.
    """

    def run(batches):
        store, base = _open(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    name, source = file, store.open_input_file(f"{base}/{file}")
                fields, body = parse(gzip.decompress(source.read_at(length, offset)))
                own = lambda k: fields[k][len("<urn:page:") : -1]  # noqa: B023, E731
                page = own("WARC-Record-ID")
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(body).hexdigest()
                rows.append((None if page == "None" else int(page), json.loads(f'"{fields["WARC-Target-URI"]}"'), int(fields["X-Payload-Length"]) if revisit else len(body), digest, fields["WARC-Type"], int(own("WARC-Refers-To")) if revisit else None, None if revisit else body.decode()))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    places = materialize(captures.select("file", "offset", "length"), "places")  # the ranges are found by a sample: look up once
    ordered = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")
