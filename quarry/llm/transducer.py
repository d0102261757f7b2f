"""BPE encoding by a minimal acyclic transducer, and decoding.

The words of the corpus (pieces as the tokenizer's pattern cuts them) are counted; the frequent ones, with the ids that the merge
rules give them, are compiled into a minimal subsequential transducer: an arc carries a byte and the ids that are certain once it
is read, and states with the same continuations are one state, so suffixes are shared. Its states are packed into one table of
cells, which is written with the rules into a file of the shared folder; Spark hands the file to each executor, whose workers
map it into memory, so they share its pages. Texts are cut into words by vectorised rules on character classes, the words walk
the transducer in step, a byte at a time, and those that it does not accept are merged by the rules, exactly.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, batch_column, map_arrow, materialize, shared_dir, slices, span_hashes, text_buffers

#: Words of the lexicon at most, and bytes of one of its words; all others are merged by the rules.
MOST_WORDS = 1 << 17
MOST_BYTES = 48
#: Bytes of a word from which on it is merged with a heap, not in step with others.
LONG = 256
#: Words merged by the rules that a worker keeps.
MOST_KEPT = 1 << 17

LETTER, NUMBER, OTHER, SPACE = range(4)


# ---------------------------------------------------------------- rules


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, following = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(following)
            following += 1
    return [letters[b] for b in range(256)]


def character_classes(tokenizer) -> np.ndarray:
    """Class of every code point, as the library's pattern cuts: letter, number, white space or other."""
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    classes = np.full(0x110000, SPACE, np.uint8)
    for kind, mark in ((OTHER, "!"), (LETTER, "a"), (NUMBER, "1")):
        left = []
        for i in range(0, len(points), 1 << 16):
            own = points[i : i + (1 << 16)]
            text = "".join(f"{mark}{chr(c)}\n" for c in own.tolist())
            starts = np.zeros(len(text) + 1, bool)
            starts[[a for _, (a, _) in cut(text)]] = True
            joined = ~starts[3 * np.arange(len(own)) + 1]
            classes[own[joined]] = kind
            left.append(own[~joined])
        points = np.concatenate(left)
    return classes


@functools.lru_cache(2)
def rules(path: str) -> dict[str, np.ndarray]:
    """The tokenizer at path as arrays: merge rules, bytes of every id, character classes, added tokens."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["normalizer"] or (spec["decoder"] or {}).get("type") != "ByteLevel":
        raise ValueError("only byte-level BPE that neither normalises nor adds a space")
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError("a BPE model with options that this encoder lacks")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens with options that this encoder lacks")
    ids, letters = model["vocab"], byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right, made = (np.array([ids[x] for x in column], np.int64) for column in zip(*((a, b, a + b) for a, b in pairs), strict=True))
    rank = {int(x): r for r, x in enumerate(made)}
    if len(rank) < len(made) or any(rank.get(int(x), -1) >= r for r, both in enumerate(zip(left, right, strict=True)) for x in both):
        raise ValueError("merge rules that use a symbol before they make it, or make one twice")
    at = {c: b for b, c in enumerate(letters)}
    names = ids | {t["content"]: t["id"] for t in spec["added_tokens"]}
    token = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        token[i] = bytes(at[c] for c in name) if all(c in at for c in name) else name.encode()
    key = (left << 20) | right
    order = np.argsort(key)
    added = [(t["content"].encode(), t["id"]) for t in spec["added_tokens"] if t["content"]]
    return {
        "pair": key[order], "rank": order.astype(np.int32), "made": made.astype(np.int32), "byte_id": np.array([ids[c] for c in letters], np.int32),
        "token": np.frombuffer(b"".join(token), np.uint8), "token_at": np.cumsum([0, *map(len, token)]), "class": character_classes(Tokenizer.from_file(path)),
        "added": np.frombuffer(b"".join(t for t, _ in added), np.uint8), "added_at": np.cumsum([0, *(len(t) for t, _ in added)]), "added_id": np.array([i for _, i in added], np.int64),
    }


class Rules:
    """Merge rules and cuts, over the arrays of `rules`."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update({f"_{k}": v for k, v in arrays.items()})
        added = [self._added[a:b].tobytes() for a, b in zip(self._added_at[:-1].tolist(), self._added_at[1:].tolist(), strict=True)]
        self.added = dict(zip(added, self._added_id.tolist(), strict=True))
        self.pattern = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)))
        self.kept: dict[bytes, np.ndarray] = {}
        n = len(self._token_at) - 1
        numbers = [b",%d" % i for i in range(n)]
        self.decimal, self.decimal_at = np.frombuffer(b"".join(numbers), np.uint8), np.cumsum([0, *map(len, numbers)])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the rule for each pair; as many as there are rules where there is none."""
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self._pair, key), len(self._pair) - 1)
        return np.where(self._pair[at] == key, self._rank[at], len(self._pair))

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: the rule of least rank first, leftmost first. A rule never makes a pair of less rank, so all
        its places in a word are merged at once, and all words in step."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._merge_long(w)
        if not short:
            return out
        size = np.array([len(words[i]) for i in short])
        symbol = self._byte_id[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        word = np.repeat(np.arange(len(short)), size)
        none, done = len(self._pair), []
        while len(symbol):
            rank = np.full(len(symbol), none, np.int64)
            rank[:-1] = self._ranks(symbol[:-1], symbol[1:])
            rank[:-1][word[:-1] != word[1:]] = none
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            over = least == none
            if over.any():
                done.append((word[over], symbol[over]))
            pick = (rank == least) & ~over
            at = np.flatnonzero(pick)
            if len(at):  # of pairs that overlap (equal symbols in a row), every other one
                start = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])])
                nth = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]
                at = at[nth % 2 == 0]
                symbol[at] = self._made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        edge = np.searchsorted(word[order], np.arange(len(short) + 1))
        symbol = symbol[order]
        for k, i in enumerate(short):
            out[i] = symbol[edge[k] : edge[k + 1]]
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word, with a heap of pairs: n log n steps."""
        symbol = self._byte_id[np.frombuffer(word, np.uint8)]
        n, none = len(symbol), len(self._pair)
        heap = [(r, i) for i, r in enumerate(self._ranks(symbol[:-1], symbol[1:]).tolist()) if r < none]
        heapq.heapify(heap)
        symbol, before, after = symbol.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        rank_of: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            pair = symbol[i], symbol[after[i]]
            if pair not in rank_of:
                rank_of[pair] = int(self._ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            return rank_of[pair]

        while heap:
            r, i = heapq.heappop(heap)
            if symbol[i] < 0 or after[i] >= n or rank(i) != r:
                continue
            gone = after[i]
            symbol[i], symbol[gone], after[i] = int(self._made[r]), -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and rank(k) < none:
                    heapq.heappush(heap, (rank(k), k))
        return np.array([s for s in symbol if s >= 0], np.int32)

    # ------------------------------------------------------------ cuts

    def cut(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """First byte of every word. edges: first bytes of the stretches that are cut by themselves."""
        if not len(raw):
            return np.empty(0, np.int64)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        lead = raw[at]
        kind = self._class[:128][np.minimum(lead, 127)]
        wide = np.flatnonzero(lead >= 0xC0)
        if len(wide):
            place, b = at[wide], lead[wide].astype(np.int64)
            padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
            two, three, four = ((padded[place + k]) for k in (1, 2, 3))
            point = np.where(b < 0xE0, (b & 31) << 6 | two, np.where(b < 0xF0, (b & 15) << 12 | two << 6 | three, (b & 7) << 18 | two << 12 | three << 6 | four))
            kind[wide] = self._class[point]
        n = len(at)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(at, edges)] = True
        first[n] = True
        before = np.concatenate([[SPACE], kind[:-1]])
        blank = np.concatenate([[False], lead[:-1] == 0x20])
        spaced = kind == SPACE
        ends_run = spaced & ~first[1:]
        ends_run[:-1] &= ~spaced[1:]
        cut = first[:n] | np.where(spaced, (before != SPACE) | ends_run, (kind != before) & ~blank)
        quote = np.flatnonzero(lead == 0x27)
        quote = quote[(quote + 1 < n) & (first[quote] | (before[quote] != OTHER) & ~blank[quote])]
        quote = quote[~first[quote + 1]]
        if len(quote):
            one = lead[quote + 1]
            third = np.minimum(quote + 2, n - 1)
            two = np.where((quote + 2 < n) & ~first[quote + 2], lead[third], 0)
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
            quote, short = quote[short | long], short[short | long]
            cut[quote + 1] = False
            end = quote + np.where(short, 2, 3)
            end = end[end < n]
            cut[end[(kind[end] == LETTER)]] = True
        return at[cut]

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """First and last byte of every word of the rows, and the ids of those that are added tokens."""
        edges, marks = [offsets[:-1][np.diff(offsets) > 0]], {}
        data = raw.tobytes() if self.added else b""
        if any(t in data for t in self.added):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for m in self.pattern.finditer(data, a, b):
                    marks[m.start()] = self.added[m.group()]
                    edges.append(np.array([m.start()] + [m.end()] * (m.end() < len(raw))))
        starts = self.cut(raw, np.unique(np.concatenate(edges)))
        whole = {}
        if marks:  # an added token may have been cut inside
            inside = np.zeros(len(raw) + 1, bool)
            for a, i in marks.items():
                inside[a + 1 : a + len(next(t for t, k in self.added.items() if k == i))] = True
            starts = starts[~inside[starts]]
            whole = {int(np.searchsorted(starts, a)): i for a, i in marks.items()}
        return starts, np.append(starts[1:], len(raw))[: len(starts)], whole

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for."""
        return gathered(self._token, self._token_at, ids)


def gathered(data: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of data that `which` names, one after another."""
    start = at[which]
    size = at[np.asarray(which) + 1] - start
    upto = np.cumsum(size)
    return data[np.repeat(start - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)]


# ---------------------------------------------------------------- transducer


def _common(outputs: list[tuple]) -> int:
    """Items that all begin with."""
    least, most = min(outputs), max(outputs)
    n = 0
    while n < min(len(least), len(most)) and least[n] == most[n]:
        n += 1
    return n


def minimal(words: list[bytes], ids: list[tuple]) -> list[tuple]:
    """The minimal transducer of sorted distinct words and their ids. A state is (ids at the end of a word, or None; arcs: byte, state, ids);
    the last state is the first of every word. States come after those that they lead to."""
    states: dict[tuple, int] = {}

    def state(low: int, high: int, depth: int) -> tuple[int, tuple]:
        i, end, arcs = low, None, []
        if len(words[low]) == depth:
            end, i = ids[low], low + 1
        while i < high:
            byte, j = words[i][depth], i + 1
            while j < high and words[j][depth] == byte:
                j += 1
            arcs.append((byte, *state(i, j, depth + 1)))
            i = j
        n = _common([x for _, _, x in arcs] + [end] * (end is not None)) if depth else 0
        out = (arcs[0][2] if arcs else end)[:n]
        key = (None if end is None else end[n:], tuple((b, s, x[n:]) for b, s, x in arcs))
        return states.setdefault(key, len(states)), out

    if words:
        state(0, len(words), 0)
    else:
        states[(None, ())] = 0
    return list(states)


def packed(states: list[tuple]) -> dict[str, np.ndarray]:
    """The states in one table: state s has a place of its own, base, and its arc of byte b is the cell base + b, which holds the base
    (else it is another state's), the base that follows, and the number of the ids that it gives."""
    strings: dict[tuple, int] = {(): 0}
    n_arcs = sum(len(arcs) for _, arcs in states)
    room = 2 * n_arcs + 4 * len(states) + 8192  # the last cells stay free, so that a place is always found
    used, taken = np.zeros(room, bool), np.zeros(room, bool)
    base = np.full(len(states), -1, np.int64)
    low = 256
    single = []
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        arcs = states[s][1]
        if len(arcs) < 2:
            single.append(s)
            continue
        bytes_ = np.array([a[0] for a in arcs])
        at = low
        while base[s] < 0:
            free = np.flatnonzero(~used[at : at + 2048]) + at
            if at == low and len(free) < 64:
                low += 2048 - 256
            first = free - bytes_[0]
            fits = ~used[first[:, None] + bytes_].any(1) & ~taken[first]
            if fits.any():
                base[s] = first[fits.argmax()]
            at += 2048
        used[base[s] + bytes_], taken[base[s]] = True, True
    free = iter(np.flatnonzero(~used[256:]) + 256)
    for s in single:
        if states[s][1]:
            byte = states[s][1][0][0]
            skipped = next(f for f in free if not taken[f - byte])
            base[s] = skipped - byte
            used[skipped] = True
        else:
            base[s] = int(np.argmin(taken))
        taken[base[s]] = True
    cells = np.full((int(max(base.max(), np.flatnonzero(used).max(initial=0))) + 257, 3), -1, np.int32)
    ends = np.full(len(cells), -1, np.int32)
    for s, (end, arcs) in enumerate(states):
        if end is not None:
            ends[base[s]] = strings.setdefault(end, len(strings))
        for byte, to, given in arcs:
            cells[base[s] + byte] = base[s], base[to], strings.setdefault(given, len(strings))
    return {"cells": cells, "ends": ends, "root": base[-1:], "given": np.array([i for x in strings for i in x], np.int32), "given_at": np.cumsum([0, *map(len, strings)])}


class Lexicon(Rules):
    """Rules with the transducer of frequent words."""

    def accept(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that the transducer accepts, and what they give: word (ascending), number of the ids."""
        accepted = np.zeros(len(starts), bool)
        which, place, stop = np.arange(len(starts)), starts.copy(), ends
        state = np.full(len(starts), self._root[0], np.int32)
        words, given = [], []
        while len(which):
            cell = self._cells[state + raw[place]]
            ok = cell[:, 0] == state
            which, place, stop, state, out = which[ok], place[ok] + 1, stop[ok], cell[ok, 1], cell[ok, 2]
            some = out > 0
            words.append(which[some])
            given.append(out[some])
            over = place == stop
            last = self._ends[state[over]]
            accepted[which[over]] = last >= 0
            words.append(which[over][last > 0])
            given.append(last[last > 0])
            go = ~over
            which, place, stop, state = which[go], place[go], stop[go], state[go]
        if not words:
            return accepted, np.empty(0, np.int64), np.empty(0, np.int32)
        word, out = np.concatenate(words), np.concatenate(given)
        order = np.argsort(word, kind="stable")  # merges runs that are in order already
        order = order[accepted[word[order]]]
        return accepted, word[order], out[order]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the number of ids of each row."""
        starts, ends, whole = self.words(raw, offsets)
        accepted, word, out = self.accept(raw, starts, ends)
        if whole:
            accepted[list(whole)] = False
            word, out = word[accepted[word]], out[accepted[word]]
        size = self._given_at[out + 1] - self._given_at[out]
        counts = np.bincount(word, size, len(starts)).astype(np.int64)
        rest, own = np.flatnonzero(~accepted), []
        new: dict[bytes, None] = {}
        spelt = [raw[a:b].tobytes() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        if len(self.kept) > MOST_KEPT:
            self.kept.clear()
        for s in spelt:
            if s not in self.kept:
                new[s] = None
        self.kept.update(zip(new, self.merge(list(new)), strict=True))
        for k, s in zip(rest.tolist(), spelt, strict=True):
            own.append(np.array([whole[k]], np.int32) if k in whole else self.kept[s])
        counts[rest] = [len(x) for x in own]
        ids = np.empty(int(counts.sum()), np.int32)
        mine = np.repeat(accepted, counts)
        ids[mine] = gathered(self._given, self._given_at, out)
        if own:
            ids[~mine] = np.concatenate(own)
        for s in [s for s in new if len(s) > LONG]:
            del self.kept[s]
        edge = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]
        return ids, np.diff(edge)


# ---------------------------------------------------------------- file


def write_file(spark: SparkSession, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays to one file of the shared folder and have Spark hand it to the executors; the name that `opened` takes."""
    head, data, at = {}, [], 0
    for k, v in arrays.items():
        v = np.ascontiguousarray(v)
        head[k] = [v.dtype.str, list(v.shape), at]
        body = v.tobytes()
        data.append(body + bytes(-len(body) % 64))
        at += len(data[-1])
    said = json.dumps(head).encode()
    said += b" " * (-(len(said) + 8) % 64)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    for part in (len(said).to_bytes(8, "little") + said, *data):
        for i in range(0, len(part), 1 << 20):
            out.write(bytearray(part[i : i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


_OPENED: dict[str, Lexicon] = {}


def opened(name: str) -> Lexicon:
    """The lexicon of a file that Spark has handed out, mapped into memory; a worker opens it once."""
    if name not in _OPENED:
        path = SparkFiles.get(name)
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
        data = np.memmap(path, np.uint8, "r", 8 + n) if os.path.getsize(path) > 8 + n else np.empty(0, np.uint8)
        arrays = {k: np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape) if np.prod(shape) else np.empty(shape, kind) for k, (kind, shape, at) in head.items()}
        _OPENED.clear()
        _OPENED[name] = Lexicon(arrays)
    return _OPENED[name]


# ---------------------------------------------------------------- operator


def stretches(raw: np.ndarray, offsets: np.ndarray, added: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows of about SLICE_BYTES. A longer row comes in several parts, cut before a single
    space between two ASCII letters, where a word always begins (such rows that hold an added token come whole)."""
    for a, b in slices(offsets):
        part, own = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) <= 2 * SLICE_BYTES or any(t in part.tobytes() for t in added):
            yield a, part, own
            continue
        letter = ((part | 0x20) >= 0x61) & ((part | 0x20) <= 0x7A)
        safe = np.flatnonzero((part[1:-1] == 0x20) & letter[:-2] & letter[2:]) + 1
        low = 0
        while low < len(part):
            k = int(np.searchsorted(safe, low + SLICE_BYTES))
            high = int(safe[k]) if k < len(safe) else len(part)
            yield a, part[low:high], np.array([0, high - low])
            low = high


def count_words(docs: DataFrame, name: str) -> DataFrame:
    """Words of the texts and their occurrences: word binary, n. Those over MOST_BYTES are left out."""

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lexicon = opened(name)
        raw, offsets = text_buffers(batch_column(batch, "text"))
        words, counts = [], []
        for _, part, own in stretches(raw, offsets, lexicon.added):
            starts, ends, whole = lexicon.words(part, own)
            ok = ends - starts <= MOST_BYTES
            ok[list(whole)] = False
            starts, ends = starts[ok], ends[ok]
            _, first, n = np.unique(span_hashes(part, starts, ends, fold=False), return_index=True, return_counts=True)
            size = ends[first] - starts[first]
            upto = np.cumsum(size)
            data = part[np.repeat(starts[first] - (upto - size), size) + np.arange(int(size.sum()))]
            words.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(0, upto).astype(np.int32)), pa.py_buffer(data)]))
            counts.append(n)
        if not words:
            return None
        return pa.RecordBatch.from_arrays([pa.concat_arrays(words), pa.array(np.concatenate(counts), pa.int64())], names=["word", "n"])

    return map_arrow(docs.select("text"), f, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, most: int) -> list[bytes]:
    """The words with the most occurrences, `most` at the most: those with more than a bound that all words of one count share."""
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2("n") * 8)).cast("long").alias("level")
    sizes = {r["level"]: r["w"] for r in counted.groupBy(level).agg(F.count("*").alias("w")).collect()}  # some 5000 rows at most
    total, bound = 0, None
    for x in sorted(sizes, reverse=True):
        if total + sizes[x] > most or x < 2:
            break
        total, bound = total + sizes[x], x
    if bound is None:
        return []
    return sorted(bytes(r["word"]) for r in counted.filter(level >= bound).select("word").collect())


def compile_lexicon(docs: DataFrame, tokenizer_path: str, most_words: int = MOST_WORDS) -> str:
    """Count the words of docs (text), compile the frequent ones with their ids, and hand the file out; its name."""
    spark = docs.sparkSession
    known = rules(tokenizer_path)
    cutter = write_file(spark, known | packed(minimal([], [])))
    words = frequent(materialize(count_words(docs, cutter), "words"), most_words)
    ids = Rules(known).merge(words)
    return write_file(spark, known | packed(minimal(words, [tuple(x.tolist()) for x in ids])))


def encode_decode(docs: DataFrame, tokenizer_path: str, most_words: int = MOST_WORDS, keep_ids: bool = False) -> DataFrame:
    """Encode each text of docs (doc_id, text) and decode its ids: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by
    commas), decoded_sha256 (of the decoded text); with keep_ids also ids array<int> and decoded.

    Ids are those of the tokenizers library at tokenizer_path, without special tokens added; a special token's string in a text is
    that token, as the library loads it. A null text is empty and has no ids; texts of any length are encoded whole, in parts
    where they are long; repeated rows and rows without a doc_id are encoded each by itself; other columns are not read; an
    empty table gives no rows. Words that do not get into the lexicon, for their frequency or their length, are merged by the
    rules, so its size changes cost alone.
    """
    name = compile_lexicon(docs, tokenizer_path, most_words)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon = opened(name)
        raw, offsets = text_buffers(batch_column(batch, "text"))
        n = batch.num_rows
        tokens = np.zeros(n, np.int64)
        sha = [(hashlib.sha256(), hashlib.sha256()) for _ in range(n)]
        kept: list[list] = [[] for _ in range(n)]
        for row, part, own in stretches(raw, offsets, lexicon.added):
            ids, counts = lexicon.encode(part, own)
            at = np.concatenate([[0], np.cumsum(counts)])
            text, decimals = lexicon.decode(ids), gathered(lexicon.decimal, lexicon.decimal_at, ids)
            text_at = np.concatenate([[0], np.cumsum(np.diff(lexicon._token_at)[ids])])[at].tolist()
            decimal_at = np.concatenate([[0], np.cumsum(np.diff(lexicon.decimal_at)[ids])])[at].tolist()
            for k in range(len(own) - 1):
                own_ids, own_text = sha[row + k]
                own_ids.update(decimals[decimal_at[k] + (not tokens[row + k] and counts[k] > 0) : decimal_at[k + 1]])
                own_text.update(text[text_at[k] : text_at[k + 1]])
                if keep_ids:
                    kept[row + k].append((ids[at[k] : at[k + 1]], text[text_at[k] : text_at[k + 1]].tobytes()))
            tokens[row : row + len(counts)] += counts
        columns = [batch.column("doc_id"), pa.array(tokens), pa.array([a.hexdigest() for a, _ in sha]), pa.array([b.hexdigest() for _, b in sha])]
        if keep_ids:
            columns += [pa.array([np.concatenate([i for i, _ in x]) if x else [] for x in kept], pa.list_(pa.int32())), pa.array([b"".join(t for _, t in x).decode("utf-8", "replace") for x in kept])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return map_arrow(docs.select("doc_id", "text"), f, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids)
