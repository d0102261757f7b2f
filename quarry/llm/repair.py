"""Token-id files with Re-Pair grammar compression.

Texts are dealt to shards by ranges of doc_id and encoded in that order. A shard's ids are compressed by Re-Pair:
in each round, pairs of neighbouring symbols become nonterminals; overlapping occurrences go to the more frequent pair.
Rounds go on until no pair pays: a rule takes three symbols (its pair and its expansion length) and each occurrence saves
one, so a pair pays from its fourth occurrence on. Pairs never span documents, so each document is a run of symbols
of its own, and the expansion lengths give random access to any position.

File format (one `shard` value in the Parquet files, little-endian): "QRP2"; u32 numbers of documents, terminals, rules and
symbols, bits of a symbol, bits of a length; terminals (ids that symbols from 0 on stand for), u32; first symbol of every
document, u32 (and the end); then bit strings, each from a whole byte on: the rules' pairs, the rules' expansion
lengths, the symbols.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_column, release, scratch_path, span_hashes, text_buffers

MAGIC = b"QRP2"
#: Occurrences from which on a pair pays for its rule.
PAYS = 4
_HASH = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- encoding


class WordEncoder:
    """Encodes texts piece by piece, and keeps the ids of pieces in a table with one place for each hash slot.

    A byte-level BPE with the usual pre-tokenising pattern always cuts before a single space that a visible
    character follows; pieces between such cuts are encoded apart and give the ids of the whole. Other spaces
    are no cut, so runs of white space stay within a piece. Texts that hold a special token's string are encoded whole.
    """

    def __init__(self, tokenizer, slot_bits: int = 21, most_ids: int = 1 << 24):
        self.tokenizer, self.most_ids = tokenizer, most_ids
        self.shift = np.uint64(64 - slot_bits)
        vocabulary = tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # byte-level: a character of a token is a byte
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)
        self.special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.key = np.empty(1 << slot_bits, np.uint64)
        self.start, self.size = np.empty(1 << slot_bits, np.int64), np.empty(1 << slot_bits, np.int32)
        self.clear()

    def clear(self):
        self.key.fill(2**64 - 1)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces; where each one's ids are, and how many. Pieces that begin with a cut's space are joined: their ids
        are told apart by the bytes they stand for."""
        spaced = (raw[starts] == 0x20) & self.AFTER[raw[np.minimum(starts + 1, len(raw) - 1)]] & (ends - starts > 1)
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        starts, ends = starts[order], ends[order]
        n = int(spaced.sum())
        parts, sizes = [], []
        for i in range(0, n, 50_000):
            length = ends[i : min(i + 50_000, n)] - starts[i : min(i + 50_000, n)]
            upto = np.cumsum(length)
            own = raw[np.repeat(starts[i : i + len(length)] - (upto - length), length) + np.arange(int(upto[-1]))]
            ids = np.array(self.tokenizer.encode_batch_fast([own.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            last = np.searchsorted(np.cumsum(self.token_bytes[ids]), upto, "right")
            parts.append(ids)
            sizes.append(np.diff(last, prepend=0))
        pieces = [raw[a:b].tobytes().decode() for a, b in zip(starts[n:].tolist(), ends[n:].tolist(), strict=True)]
        single = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []
        parts.append(np.array([x for own in single for x in own], np.uint32))
        sizes.append(np.array([len(x) for x in single], np.int64))
        start, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        size[order] = np.concatenate(sizes)
        start[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        self.ids = np.concatenate([self.ids, *parts])
        slot = keys >> self.shift
        self.key[slot], self.start[slot], self.size[slot] = keys, start, size
        return start, size

    #: A byte that may follow a cut: visible ASCII, or the first of a character from U+00C0 to U+07FF (no white space there).
    AFTER = np.zeros(256, bool)
    AFTER[0x21:0x7F] = AFTER[0xC3:0xE0] = True

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray):
        """Start of every piece, and the place of its ids: start, size."""
        cut = np.zeros(len(raw), bool)
        cut[:-1] = (raw[:-1] == 0x20) & self.AFTER[raw[1:]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        keys = span_hashes(raw, starts, ends, fold=False)
        if len(self.ids) > self.most_ids:
            self.clear()
        slot = keys >> self.shift
        start, size = self.start[slot], self.size[slot].astype(np.int64)
        new = np.flatnonzero(self.key[slot] != keys)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            own = self._learn(distinct, raw, starts[new[first]], ends[new[first]])
            back = np.searchsorted(distinct, keys[new])
            start[new], size[new] = own[0][back], own[1][back]
        return starts, start, size

    def _whole_rows(self, raw: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Rows that hold the string of a special token, or seem to where two rows meet."""
        data, rows = raw.tobytes(), set()
        for token in self.special:
            at = data.find(token)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = data.find(token, at + 1)
        return sorted(rows)

    def _runs(self, raw: np.ndarray, offsets: np.ndarray):
        """Row ranges, and the ids of the row if it is one to be encoded whole (else None)."""
        row, n = 0, len(offsets) - 1
        for k in self._whole_rows(raw, offsets):
            if row < k:
                yield row, k, None
            text = raw[offsets[k] : offsets[k + 1]].tobytes().decode()
            yield k, k + 1, np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            row = k + 1
        if row < n:
            yield row, n, None

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the number of ids of each row."""
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for a, b, whole in self._runs(raw, offsets):
            own, part = offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]]
            if whole is not None:
                ids.append(whole)
                counts.append(np.array([len(whole)]))
            elif not len(part):
                counts.append(np.zeros(b - a, np.int64))
            else:
                starts, start, size = self._pieces(part, own)
                total = np.cumsum(size)
                ids.append(self.ids[np.repeat(start - (total - size), size) + np.arange(int(total[-1]))])
                counts.append(np.bincount(np.searchsorted(own, starts, "right") - 1, size, b - a).astype(np.int64))
        return np.concatenate(ids), np.concatenate(counts)

    def count(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start byte of every piece, and its number of ids; a row that is encoded whole is one piece."""
        at, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b, whole in self._runs(raw, offsets):
            part = raw[offsets[a] : offsets[b]]
            if whole is not None:
                at.append(offsets[a : a + 1])
                counts.append(np.array([len(whole)]))
            elif len(part):
                starts, _, size = self._pieces(part, offsets[a : b + 1] - offsets[a])
                at.append(starts + offsets[a])
                counts.append(size)
        return np.concatenate(at), np.concatenate(counts)


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder_for(path: str, load: Callable) -> WordEncoder:
    """A worker's encoder; what it has learnt serves the worker's later tasks."""
    key = path, load
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(load(path))
    return _ENCODERS[key]


def load_tokenizer(path: str):
    """The tokenizer at path, as the library loads it: a special token's string in a text is that token. One thread: Spark has the cores."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# ---------------------------------------------------------------- grammar


def packed(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits (32 at most), one after another, the lowest bit first, up to a whole number of 64-bit words."""
    rows = np.zeros((-(-len(values) // 64), 64), np.uint64)
    rows.ravel()[: len(values)] = values
    out = np.zeros((len(rows), width + 1), np.uint64)  # 64 values fill `width` words
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return out[:, :width].astype("<u8").tobytes()


def unpacked(data: np.ndarray, width: int, start: int, end: int) -> np.ndarray:
    """Values from number start up to end of a bit string that 8 bytes at least follow."""
    bit = np.arange(start, end, dtype=np.int64) * width
    words = np.ndarray(len(data) - 7, "<u8", buffer=data.data, strides=(1,))
    return ((words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _odd_of_runs(at: np.ndarray, following: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Of pairs of equal symbols (their places, the next places, the symbols): those that overlap one that is kept."""
    first = np.ones(len(at), bool)
    first[1:] = (following[:-1] != at[1:]) | (symbol[:-1] != symbol[1:])
    number = np.arange(len(at))
    return (number - np.maximum.accumulate(np.where(first, number, 0))) & 1 == 1


class Grammar:
    """Re-Pair over the ids of a shard's documents."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, pays: int = PAYS):
        self.pays = pays
        self.terminals = np.flatnonzero(np.bincount(ids)) if len(ids) else np.empty(0, np.int64)
        number = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
        number[self.terminals] = np.arange(len(self.terminals), dtype=np.int32)
        self.symbols = number[ids]
        self.last = np.zeros(len(ids), bool)  # ends of documents
        self.last[np.cumsum(counts)[counts > 0] - 1] = True
        self.rules = np.empty((0, 2), np.int64)
        self.pairs, self.names = np.empty(0, np.uint64), np.empty(0, np.int64)  # pairs that have a rule, in order
        turn = 0
        while len(self.symbols) > 1 and 25 * self._sweep(turn) >= len(self.symbols):
            turn += 1
        self._settle()

    def _named(self, made: np.ndarray) -> np.ndarray:
        """Symbols of pairs, new ones with a new rule."""
        at = np.searchsorted(self.pairs, made)
        old = np.zeros(len(made), bool)
        inside = at < len(self.pairs)
        old[inside] = self.pairs[at[inside]] == made[inside]
        names = np.empty(len(made), np.int64)
        names[old] = self.names[at[old]]
        new = made[~old]
        names[~old] = len(self.terminals) + len(self.rules) + np.arange(len(new))
        self.rules = np.concatenate([self.rules, np.stack([(new >> np.uint64(32)).astype(np.int64), (new & np.uint64(0xFFFFFFFF)).astype(np.int64)], 1)])
        pairs, symbols = np.concatenate([self.pairs, new]), np.concatenate([self.names, names[~old]])
        order = np.argsort(pairs)
        self.pairs, self.names = pairs[order], symbols[order]
        return names

    def _sweep(self, turn: int, bits: int = 18) -> int:
        """A round over all symbols: counts by hash slots, each of which one pair holds; the others wait for a round with
        another hash. Returns how many occurrences were replaced."""
        symbols, last = self.symbols, self.last
        pair = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:].astype(np.uint64)
        slot = ((pair * np.uint64((int(_HASH) * (2 * turn + 1)) & (2**64 - 1))) >> np.uint64(64 - bits)).view(np.int64)
        free = ~last[:-1]
        same = np.flatnonzero((symbols[:-1] == symbols[1:]) & free)
        free[same[_odd_of_runs(same, same + 1, symbols[same])]] = False
        holder = np.zeros(1 << bits, np.uint64)
        holder[slot[free]] = pair[free]
        free &= holder[slot] == pair
        often = np.bincount(slot[free], minlength=1 << bits).astype(np.int32)
        # equally frequent pairs come in a fixed order
        rank = np.where(often < self.pays, 0, np.minimum(often, (1 << 20) - 1) << 10 | np.arange(1 << bits, dtype=np.int32) & 1023).astype(np.int32)
        weight = rank[slot] * free
        chosen = weight > 0
        chosen[1:] &= weight[1:] > weight[:-1]
        chosen[:-1] &= weight[:-1] >= weight[1:]  # of overlapping pairs the more frequent one
        paying = np.flatnonzero(np.bincount(slot[chosen], minlength=1 << bits) >= self.pays)
        name = np.full(1 << bits, -1, np.int32)
        name[paying] = self._named(holder[paying])
        at = np.flatnonzero(chosen)
        at = at[name[slot[at]] >= 0]
        symbols[at] = name[slot[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        self.symbols, self.last = symbols[keep], last[keep]
        return len(at)

    def _settle(self) -> None:
        """The rest, by exact counts of the pairs that changed alone, until a count of all pairs finds none that pays."""
        n = len(self.symbols)
        symbols = np.append(self.symbols, -1)
        after = np.append(np.where(self.last, n, np.arange(1, n + 1)), n)
        before = np.append(np.where(np.append(True, self.last[:-1]), n, np.arange(-1, n - 1))[:n], n)
        weight = np.zeros(n + 1, np.int64)
        changed = True
        while changed:
            changed = False
            at = np.flatnonzero(after[:n] != n)
            pair = (symbols[at].astype(np.uint64) << np.uint64(32)) | symbols[after[at]].astype(np.uint64)
            slot = ((pair * _HASH) >> np.uint64(44)).view(np.int64)
            at = at[np.bincount(slot, minlength=1 << 20)[slot] >= self.pays]  # a slot holds no fewer than each of its pairs
            while len(at):
                following = after[at]
                a, b = symbols[at], symbols[following]
                same = np.flatnonzero(a == b)
                keep = np.ones(len(at), bool)
                keep[same[_odd_of_runs(at[same], following[same], a[same])]] = False
                at, following, a, b = at[keep], following[keep], a[keep], b[keep]
                made, slot, often = np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True, return_counts=True)
                keep = often[slot] >= self.pays
                at, following, slot = at[keep], following[keep], slot[keep]
                own = (often[slot] << 32) + slot + 1
                weight[at] = own
                chosen = (own > weight[before[at]]) & (own > weight[following])
                weight[at] = 0
                paying = np.bincount(slot[chosen], minlength=len(made)) >= self.pays
                if not paying.any():
                    break
                changed = True
                chosen &= paying[slot]
                name = np.zeros(len(made), np.int64)
                name[paying] = self._named(made[paying])
                p, q = at[chosen], following[chosen]
                r = after[q]
                symbols[p], symbols[q] = name[slot[chosen]], -1
                after[p], after[q], before[r] = r, n, p
                before[n] = n
                live = np.zeros(n + 1, bool)
                live[at] = live[p] = live[before[p]] = True
                live &= after != n
                at = np.flatnonzero(live)
        left = np.flatnonzero(symbols[:n] >= 0)
        self.last = after[left] == n
        self.symbols = symbols[left]


def compress(ids: np.ndarray, counts: np.ndarray, pays: int = PAYS) -> bytes:
    """A shard of documents (ids one after another, `counts` of each) in the file format."""
    grammar = Grammar(ids, counts, pays)
    n = len(grammar.terminals)
    lengths = np.ones(n + len(grammar.rules), np.int64)
    for low, high in _generations(grammar.rules, n):
        lengths[n + low : n + high] = lengths[grammar.rules[low:high]].sum(1)
    ends = np.zeros(len(counts) + 1, np.int64)
    filled = np.flatnonzero(counts > 0)
    ends[1:][filled] = np.diff(np.flatnonzero(grammar.last), prepend=-1)
    starts = np.cumsum(ends)
    width = max(1, (n + len(grammar.rules) - 1).bit_length())
    length_width = max(1, int(lengths.max(initial=1)).bit_length())
    head = struct.pack("<IIIIII", len(counts), n, len(grammar.rules), len(grammar.symbols), width, length_width)
    return b"".join([MAGIC, head, grammar.terminals.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), packed(grammar.rules.ravel(), width), packed(lengths[n:], length_width), packed(grammar.symbols, width)])


def _generations(rules: np.ndarray, n_terminals: int):
    """Ranges of rules that refer to no rule of their own range, in order."""
    newest = rules.max(1, initial=0) - n_terminals
    low = 0
    while low < len(rules):
        inside = np.flatnonzero(newest[low:] >= low)
        high = low + int(inside[0]) if len(inside) else len(rules)
        yield low, high
        low = high


class Shard:
    """Random access to a shard in the file format."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("no token shard")
        self.n_docs, n, n_rules, self.n_symbols, self.width, length_width = struct.unpack_from("<IIIIII", data, 4)
        at = 28
        self.terminals = np.frombuffer(data, "<u4", n, at)
        at += 4 * n
        self.starts = np.frombuffer(data, "<u4", self.n_docs + 1, at).astype(np.int64)
        at += 4 * (self.n_docs + 1)
        rest = np.append(np.frombuffer(data, np.uint8, offset=at), np.zeros(8, np.uint8))
        size = lambda count, width: -(-count // 64) * 8 * width
        self.rules = unpacked(rest, self.width, 0, 2 * n_rules).reshape(-1, 2)
        rest = rest[size(2 * n_rules, self.width) :]
        self.lengths = np.concatenate([np.ones(n, np.int64), unpacked(rest, length_width, 0, n_rules)])
        self.body = rest[size(n_rules, length_width) :]
        self.table = None

    def symbols(self, start: int, end: int) -> np.ndarray:
        return unpacked(self.body, self.width, start, end)

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every symbol, one after another, and where each symbol's begin."""
        if self.table is None:
            begin = np.cumsum(self.lengths) - self.lengths
            flat = np.empty(int(self.lengths.sum()), np.uint32)
            n = len(self.terminals)
            flat[:n] = self.terminals
            for low, high in _generations(self.rules, n):
                own = self.rules[low:high].ravel()
                at, end = int(begin[n + low]), int(begin[n + high - 1] + self.lengths[n + high - 1])
                flat[at:end] = self._gather(flat, begin, own)
            self.table = flat, begin
        return self.table

    def _gather(self, flat: np.ndarray, begin: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        size = self.lengths[symbols]
        total = np.cumsum(size)
        return flat[np.repeat(begin[symbols] - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        return self._gather(*self._expansions(), symbols)

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols(int(self.starts[i]), int(self.starts[i + 1])))

    def sizes(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.lengths[self.symbols(0, self.n_symbols)])])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def token(self, i: int, position: int) -> int:
        """One id of a document, without expanding the rest: a walk down the grammar by expansion lengths."""
        own = self.symbols(int(self.starts[i]), int(self.starts[i + 1]))
        total = np.cumsum(self.lengths[own])
        if not 0 <= position < (total[-1] if len(total) else 0):
            raise IndexError(position)
        k = int(np.searchsorted(total, position, "right"))
        position -= int(total[k - 1]) if k else 0
        symbol, n = int(own[k]), len(self.terminals)
        while symbol >= n:
            left, right = map(int, self.rules[symbol - n])
            size = int(self.lengths[left])
            symbol, position = (left, position) if position < size else (right, position - size)
        return int(self.terminals[symbol])


# ---------------------------------------------------------------- operator


def write(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 2, shard_bytes: int = 4 << 20, load: Callable = load_tokenizer) -> str:
    """Encode docs (doc_id, text) in ascending doc_id order (nulls first, ties by a hash of the text, then the text) into
    shards of about shard_bytes.

    A null text is an empty one; each document ends with end_id. Repeated rows are encoded as often as they occur, other
    columns are not read, an empty table gives no shards, and a text over shard_bytes is a shard by itself. Returns the folder of the shards: part, seq (order
    within the part), doc_ids, n_tokens, shard. Ranges of doc_id and hash are Spark's, so rows without an id, or with one
    id, spread over parts by their texts.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = encoder_for(tokenizer_path, load)
        seq, part = 0, None

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, held_n, held_ids, size = [], [], [], 0

        def flush():
            nonlocal held, held_n, held_ids, size, seq
            ids, counts = np.concatenate(held), np.concatenate(held_n)
            doc_ids = pa.chunked_array(held_ids).combine_chunks()
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([len(ids)], pa.int64()), pa.array([compress(ids, counts)], pa.binary())],
                names=["part", "seq", "doc_ids", "n_tokens", "shard"],
            )
            held, held_n, held_ids, size, seq = [], [], [], 0, seq + 1
            return out

        for batch in batches:
            raw, offsets = text_buffers(batch_column(batch, "text"))
            row, n = 0, batch.num_rows
            while row < n:
                end = int(np.searchsorted(offsets, offsets[row] + max(1, shard_bytes - size), "right")) - 1
                end = min(max(end, row + 1), n)
                own = offsets[row : end + 1] - offsets[row]
                ids, counts = encoder.encode(raw[offsets[row] : offsets[end]], own)
                stops = np.cumsum(counts + 1) - 1
                out = np.empty(len(ids) + len(counts), np.uint32)
                body = np.ones(len(out), bool)
                body[stops] = False
                out[body], out[stops] = ids, end_id
                held.append(out)
                held_n.append(counts + 1)
                held_ids.append(batch.column("doc_id").slice(row, end - row))
                size += int(offsets[end] - offsets[row])
                row = end
                if size >= shard_bytes:
                    yield flush()
        if held:
            yield flush()
        release()

    tie = docs.withColumn("tie", F.xxhash64("text"))
    ordered = tie.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    ordered.mapInArrow(run, f"part int, seq int, doc_ids array<{id_type}>, n_tokens long, shard binary").write.parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """The documents of the shards in path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, part, seq, at."""
    shards = spark.read.parquet(path)
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # as many rows as partitions were written, then as many as a part has shards
    from pyspark.sql import Window

    before = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = shards.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("seq_start"))
    starts = inside.join(before, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("shard_start"))
    id_type = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def open_shards(batches):
        for batch in batches:
            parts, seqs = batch.column("part").to_pylist(), batch.column("seq").to_pylist()
            shard, doc_ids = batch.column("shard"), batch.column("doc_ids")
            for k in range(batch.num_rows):
                own = Shard(shard[k].as_buffer().to_pybytes())
                sizes = own.sizes()
                at = np.concatenate([[0], np.cumsum(sizes)])
                data = memoryview(own.expand(own.symbols(0, own.n_symbols)).astype("<u4").tobytes())
                crcs = np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
                n = own.n_docs
                yield pa.RecordBatch.from_arrays(
                    [doc_ids[k].values, pa.array(np.full(n, parts[k]), pa.int32()), pa.array(np.full(n, seqs[k]), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(at[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "part", "seq", "at", "shard_at", "n_tokens", "ids_crc32"],
                )
        release()

    documents = shards.select("part", "seq", "doc_ids", "shard").mapInArrow(open_shards, f"doc_id {id_type}, part int, seq int, at int, shard_at long, n_tokens long, ids_crc32 long")
    return documents.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("shard_at")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "at")
