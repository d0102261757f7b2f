"""Language-model scores from a log-frequency Bloom filter.

Every bigram and trigram of the training documents is counted (see ledger). One seen c times is a member of levels
1..1+floor(log2 c); each level is a Bloom filter of its own, cut into segments by hash. Scoring probes the levels in
turn until one misses, which gives the quantised count. Each order is smoothed by the next lower one, which weighs as
much as `prior` sightings of the context (Dirichlet smoothing), down to the words, whose counts are exact:

    P(w|u,v) = (c(u,v,w) + prior[1] P(w|v)) / (c(u,v) + prior[1])
    P(w|v) = (c(v,w) + prior[0] P(w)) / (c(v) + prior[0]),   P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

With exact counts these add up to 1 for any context, and unseen contexts leave the lower order as it is. A count is at
most that of any shorter n-gram in it.

A text's first word follows the end token and has no trigram. Buckets of the key space add up what the training documents show,
and each writes its segment of the filter, with every level, and its words with their exact counts, to a file of the shared folder.
Workers map these files into memory, all of them or a bounded group at a time, and probe them where the documents are: only the
training documents' counts are shuffled, nothing passes through the driver, and a worker's memory does not grow with the filter.
"""

from __future__ import annotations

import json
import math
import uuid
from urllib.parse import urlsplit
from urllib.request import url2pathname

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ledger
from .common import SPACED, batch_column, map_arrow, materialize, mix64, scratch_path, slices, span_hashes, text_buffers, word_spans

END = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text handled at once where n-grams are probed.
PROBED = 4 << 20
_PAIR, _TRIPLE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93)


def token_hashes(column: pa.Array):
    """For slices of the rows: first row, token hashes (words, then one end token for each row), tokens of each row."""
    raw, offsets = text_buffers(column)
    for a, b in slices(offsets):
        own = offsets[a : b + 1] - offsets[a]
        part = raw[offsets[a] : offsets[b]]
        starts, ends, first = word_spans(part, own, SPACED)
        words = np.diff(first)
        out = np.full(len(starts) + len(words), END)
        out[np.arange(len(starts)) + np.repeat(np.arange(len(words)), words)] = span_hashes(part, starts, ends)
        yield a, out, words + 1


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first of a text follows the end token of the text before."""
    before = np.concatenate([[END], tokens[:-1]])
    return mix64(before * _PAIR + tokens)


def gram_hashes(tokens: np.ndarray, sizes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pairs that end in each token, those of the triples, and which tokens have one: all but a text's first."""
    pairs = pair_hashes(tokens)
    triples = mix64(np.concatenate([[END], pairs[:-1]]) * _TRIPLE + tokens)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes) - sizes] = False
    return pairs & mask, triples & mask, inner


def key_mask(text_bytes: int) -> np.uint64:
    """The bits of an n-gram's hash that make its key: so many that, of all n-grams of so much text, some one in a thousand shares its key."""
    bits = min(64, max(40, math.ceil(math.log2(max(text_bytes, 1))) + 10))
    return np.uint64((1 << 64) - (1 << 64 - bits))


class LevelFilter:
    """Bloom filters of one segment, one for each level."""

    def __init__(self, levels: dict[int, np.ndarray], probes: int):
        self.levels, self.probes = levels, probes

    @staticmethod
    def positions(keys: np.ndarray, size: int, level: int, probe: int) -> np.ndarray:
        h = mix64(keys + np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return (((h & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * step) & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)

    @classmethod
    def build(cls, keys: np.ndarray, level: int, bits_per_key: int, probes: int) -> bytes:
        size = max(64, int(len(keys)) * bits_per_key)
        bits = np.zeros(-(-size // 8) * 8, bool)
        for probe in range(probes):
            bits[cls.positions(keys, len(bits), level, probe)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def quantised(self, keys: np.ndarray) -> np.ndarray:
        """Level reached by each key: 0 if the lowest level misses."""
        reached = np.zeros(len(keys), np.int8)
        alive = np.arange(len(keys))
        for level in sorted(self.levels):
            data = self.levels[level]
            for probe in range(self.probes):
                at = self.positions(keys[alive], 8 * len(data), level, probe)
                byte = data[(at >> np.uint64(3)).astype(np.int64)]
                alive = alive[(byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if not len(alive):
                break
            reached[alive] = level
        return reached


#: Count that a level stands for: the middle of [2^(q-1), 2^q), and 0 if unseen.
LEVEL_COUNTS = np.array([0.0] + [1.5 * 2.0 ** (q - 1) - 0.5 for q in range(1, 65)])


def edges(n: int) -> np.ndarray:
    """Where the buckets of the key space end, but the last."""
    return (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)


def learn(docs: DataFrame, n: int, mask: np.uint64, bits_per_key: int = 16, probes: int = 4, chunk_bytes: int = 16 << 20) -> DataFrame:
    """Count the words and n-grams of docs (text) and write n segments: bucket, file (below the folder `folder`), words (distinct), total (of their
    counts), grams (distinct), bytes (of its filter).

    A task counts chunk_bytes of text before it passes counts on. A file: JSON of its arrays, then words' hashes in order and their counts, and
    the filter of each level.
    """
    folder = scratch_path(docs.sparkSession, "model")

    def ask(batches):
        words, grams, size = [], [], 0

        def out():
            rows = []
            for base, parts in ((0, words), (n, grams)):
                keys = np.sort(np.concatenate(parts))
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                rows += ledger.bucket_rows(0, keys[first], np.diff(np.append(first, len(keys))), n, base)
            words.clear()
            grams.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] % n for r in rows], pa.int32()), pa.array([int(r[0] >= n) for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["bucket", "g", "keys", "counts"])

        for batch in batches:
            for _, tokens, sizes in token_hashes(batch_column(batch, "text")):
                pairs, triples, inner = gram_hashes(tokens, sizes, mask)
                words.append(tokens)
                grams += [pairs, triples[inner]]
                size += 7 * len(tokens)
                if size >= chunk_bytes:
                    yield out()
                    size = 0
        if words:
            yield out()

    def settle(table):
        bucket = table.column("bucket")[0].as_py()
        found = []
        for kind in (0, 1):
            own = table.filter(pc.equal(table["g"], kind))
            found += [np.empty(0, np.uint64), np.empty(0, np.int64)] if not own.num_rows else ledger.added(own)[2:]
        keys, totals, grams, counts = found
        levels = np.floor(np.log2(counts)).astype(np.int64) + 1 if len(counts) else np.empty(0, np.int64)
        filters = {k: LevelFilter.build(grams[levels >= k], k, bits_per_key, probes) for k in range(1, int(levels.max(initial=0)) + 1)}
        head = json.dumps({"words": len(keys), "levels": {k: len(x) for k, x in filters.items()}}).encode()
        store, base = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        with store.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(len(head).to_bytes(8, "little") + head + keys.astype("<u8").tobytes() + totals.astype("<i8").tobytes())
            for x in filters.values():
                f.write(x)
        row = (bucket, f"{folder}/{name}", len(keys), int(totals.sum()), len(grams), sum(map(len, filters.values())))
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["bucket", "file", "words", "total", "grams", "bytes"])

    asked = docs.select("text").mapInArrow(ask, ledger.REQUEST)
    return materialize(asked.groupBy("bucket").applyInArrow(settle, "bucket int, file string, words long, total long, grams long, bytes long"), "segments")


class Segment:
    """A segment's file, mapped into memory."""

    def __init__(self, path: str, probes: int):
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(size))
        data, at, n = np.memmap(path, np.uint8, "r"), 8 + size, head["words"]
        self.keys, self.totals = (np.frombuffer(data, t, n, at + 8 * n * k) for k, t in enumerate(("<u8", "<i8")))
        at += 16 * n
        levels = {}
        for k, length in head["levels"].items():
            levels[int(k)] = data[at : at + length]
            at += length
        self.filter = LevelFilter(levels, probes)


_SEGMENTS: dict[str, Segment] = {}


def _segment(file: str, probes: int) -> Segment:
    """A mounted file is mapped where it is; of another store's, Spark has given the executor a copy."""
    if file not in _SEGMENTS:
        if len(_SEGMENTS) > 100_000:
            _SEGMENTS.clear()
        parts = urlsplit(file)
        path = url2pathname(parts.path) if parts.scheme in ("", "file") else SparkFiles.get(file.rpartition("/")[2])
        _SEGMENTS[file] = Segment(path, probes)
    return _SEGMENTS[file]


def probed(keys: np.ndarray, files: dict[int, str], n: int, probes: int, words: bool) -> np.ndarray:
    """Counts of words, or levels of n-grams; 0 where the key's bucket is not among the files."""
    order = np.argsort(keys)
    own = keys[order]
    cuts = np.concatenate([[0], np.searchsorted(own, edges(n)), [len(own)]])
    out = np.zeros(len(keys), np.int64 if words else np.int8)
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        if bucket not in files:
            continue
        segment, part = _segment(files[bucket], probes), slice(cuts[bucket], cuts[bucket + 1])
        out[order[part]] = ledger.look_up(segment.keys, segment.totals, own[part]) if words else segment.filter.quantised(own[part])
    return out


def score(
    docs: DataFrame,
    train_column: str,
    prior: tuple[float, float] = (1000.0, 16.0),
    group_bytes: int = 16 << 20,
    bits_per_key: int = 16,
    probes: int = 4,
    mapped_bytes: int = 64 << 30,
) -> DataFrame:
    """Score each row of docs (doc_id, text, boolean train_column) with a trigram model learnt from the training rows.

    Words are the runs of bytes other than ASCII white space, with A-Z in lower case. Null and empty texts have the
    end token alone. Repeated rows are counted and scored as often as they occur, rows without a doc_id too; a null train_column counts as false.
    With no training rows every word is unknown, and N = V = 0. Returns doc_id, train, n_tokens, n_known, train_tokens, base_score,
    score. Up to mapped_bytes of segments are mapped at a time; a larger model is probed in several passes, between which the rows
    are written with what they have found. group_bytes: text for each segment.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(train_column), F.lit(False)).alias("train"))
    known = docs.filter("train")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    n, mask, ends = max(4, -(-int(size["b"]) // group_bytes)), key_mask(int(size["b"])), int(size["n"])
    segments = learn(known, n, mask, bits_per_key, probes)
    sums = segments.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("N"), F.coalesce(F.sum("words"), F.lit(0)).alias("V")).first()
    n_train, n_distinct = int(sums["N"]), int(sums["V"])
    groups: list[dict[int, str]] = [{}]
    held = 0
    for r in segments.select("bucket", "file", (F.col("bytes") + 16 * F.col("words")).alias("b")).orderBy("bucket").toLocalIterator():  # a row for each segment
        if held and held + r["b"] > mapped_bytes:
            groups.append({})
            held = 0
        groups[-1][r["bucket"]] = r["file"]
        held += r["b"]
        if urlsplit(r["file"]).scheme not in ("", "file"):
            spark.sparkContext.addFile(r["file"])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.withColumn("found", F.lit(None).cast("binary"))
    for k, files in enumerate(groups):
        shared = spark.sparkContext.broadcast(files)  # names alone
        if k + 1 < len(groups):
            rows = materialize(map_arrow(rows, _prober(shared, n, mask, probes), f"doc_id {id_type}, text string, train boolean, found binary"), "probed")
        else:
            rater = _rater(shared, n, mask, probes, prior, n_train, n_distinct, ends)
            rows = map_arrow(rows, rater, f"doc_id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return rows


def _looked_up(batch: pa.RecordBatch, shared, n: int, mask: np.uint64, probes: int):
    """For slices of the rows: first row, tokens, their number in each row, counts of the words, levels of pairs and triples (of those that there are), with
    what earlier passes have found."""
    files = shared.value
    _, offsets = text_buffers(batch_column(batch, "text"))
    before = batch.column("found").to_pylist() if batch.column("found").null_count < batch.num_rows else None
    text = batch_column(batch, "text")
    for a, b in slices(offsets, PROBED):
        parts = list(token_hashes(text.slice(a, b - a)))
        tokens, sizes = np.concatenate([t for _, t, _ in parts]), np.concatenate([s for _, _, s in parts])
        pairs, triples, inner = gram_hashes(tokens, sizes, mask)
        distinct, back = np.unique(tokens, return_inverse=True)
        counts = probed(distinct, files, n, probes, True)[back]
        both = probed(pairs, files, n, probes, False)
        three = np.zeros(len(tokens), np.int8)
        three[inner] = probed(triples[inner], files, n, probes, False)
        if before is not None:
            at = np.concatenate([[0], np.cumsum(sizes)])
            for r in range(b - a):
                m, own = int(sizes[r]), slice(at[r], at[r + 1])
                counts[own] += np.frombuffer(before[a + r], "<i8", m)
                both[own] += np.frombuffer(before[a + r], np.int8, m, 8 * m)
                three[own] += np.frombuffer(before[a + r], np.int8, m, 9 * m)
        yield a, sizes, counts, both, three, inner


def _prober(shared, n, mask, probes):
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for _, sizes, counts, both, three, _ in _looked_up(batch, shared, n, mask, probes):
            at = np.concatenate([[0], np.cumsum(sizes)])
            found += [counts[i:j].astype("<i8").tobytes() + both[i:j].tobytes() + three[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text", "train")), pa.array(found, pa.binary())], names=["doc_id", "text", "train", "found"])

    return f


def _rater(shared, n, mask, probes, prior, n_train, n_distinct, ends):
    log_base = np.log10(n_train + 0.1 * (n_distinct + 1))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_tokens, n_known, base, full = [], [], [], []
        for _, sizes, c, pairs, triples, inner in _looked_up(batch, shared, n, mask, probes):
            first = np.cumsum(sizes) - sizes
            logs = np.log10(c + 0.1) - log_base
            context = np.concatenate([[ends], c[:-1]]).astype(np.float64)
            context[first] = ends
            both = np.minimum(LEVEL_COUNTS[pairs], np.minimum(context, c))
            probability = (both + prior[0] * 10.0**logs) / (context + prior[0])
            before = np.concatenate([[0.0], both[:-1]])[inner]
            three = np.minimum(LEVEL_COUNTS[triples[inner]], np.minimum(before, both[inner]))
            probability[inner] = (three + prior[1] * probability[inner]) / (before + prior[1])
            n_tokens.append(sizes)
            n_known.append(np.add.reduceat((c > 0).astype(np.int64), first))
            base.append(np.add.reduceat(logs, first))
            full.append(np.add.reduceat(np.log10(probability), first))
        rows = batch.num_rows
        columns = [pa.array(np.concatenate(n_tokens), pa.int64()), pa.array(np.concatenate(n_known), pa.int64()), pa.array(np.full(rows, n_train), pa.int64()), pa.array(np.concatenate(base)), pa.array(np.concatenate(full))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("train"), *columns], names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return f
