"""Ranked search, the BPE transducer and the filter audit against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm import audit, queries, ranked, transducer
from quarry.llm.common import text_buffers

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- ranked search


def brute_ranking(rows, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = {}
    texts = {}
    for i, t in items:
        if t is not None:
            texts.setdefault(i, set()).add(t)
    for i, own in texts.items():
        query = Counter(x for t in own for x in terms(t))
        found = []
        for d, c, size in docs:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in query.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out[i] = [(r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return {i: x for i, x in out.items() if x}


def ranking(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


def test_ranked_search(spark, docs, rows, monkeypatch):
    body = rows[13][1]
    items = [(0, body), (1, "cat cat CAT naïve"), (2, None), (3, ""), (4, "..."), (5, "the"), (5, "the"), (5, "Rain, old"), (6, "never-seen words"), (7, "x" * 5000)]
    given = [*rows, (5000, body), (70000, body), (70000, body), (None, "the cat sat"), (None, "the cat sat"), (None, None)]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in given], "doc_id long, text string, term string, window int").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    for window, k, block in ((4096, 20, 1 << 20), (64, 3, 40), (128, 500, 1 << 20)):
        monkeypatch.setattr(ranked, "WINDOW", window)
        path = ranked.build(frame)
        assert ranking(ranked.search(spark, path, bench, k, block)) == brute_ranking(given, items, k), window
    named = bench.withColumn("item_id", bench.item_id.cast("string"))
    assert set(ranking(ranked.search(spark, path, named))) == {"0", "1", "5", "7"} | ({"6"} if 6 in brute_ranking(given, items, 9) else set())
    assert ranked.search(spark, path, bench.limit(0)).count() == 0
    assert ranked.search(spark, ranked.build(docs.limit(0)), bench).count() == 0
    assert ranked.search(spark, ranked.build(docs.filter("doc_id < 3")), bench).count() == 0  # no document has a term


def test_windows_hold_bounded_rows(spark):
    rows = [(7, f"word{i % 5} text") for i in range(9000)] + [(8000, "word1 " * 50)]
    path = ranked.build(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = spark.read.parquet(path).collect()
    assert max(r["n_docs"] for r in kept) <= ranked.WINDOW and sum(r["n_docs"] for r in kept) == 9001
    items = [(1, "word1"), (2, "text")]
    assert ranking(ranked.search(spark, path, spark.createDataFrame(items, "item_id long, text string"))) == brute_ranking(rows, items, 20)


# ---------------------------------------------------------------- transducer


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def hard(rows):
    random.seed(5)
    parts = [*" \n\t'stmdrevlaAZz09.,!<|>", " ", "　", "é", "漢", "字", "½", "²", "😀", "​", "́", "'s", "'ll", "'RE", "<|endoftext|>", "'re", "  ", "\r\n", "ab", "the", " the"]
    return [*(t for _, t in rows), *("".join(random.choice(parts) for _ in range(random.randint(0, 50))) for _ in range(3000)), "x" * 3000, "aab" * 900, "'" * 40, "don't we'll I'M", " " * 700, "é" * 600]


def test_encoding_equals_the_library(tokenizer, hard):
    known = transducer.rules(queries.tokenizer_path())
    plain = transducer.Rules(known)
    raw, offsets = text_buffers(pa.array(hard, pa.string()))
    starts, ends, whole = plain.words(raw, offsets)
    words = sorted({raw[a:b].tobytes() for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)) if k not in whole and b - a <= 48})
    assert [x.tolist() for x in plain.merge(words)] == [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
    ids = [tuple(x.tolist()) for x in plain.merge(words[::2])]
    for chosen in (words[::2], []):
        lexicon = transducer.Lexicon(known | transducer.packed(transducer.minimal(chosen, ids[: len(chosen)])))
        got, counts = lexicon.encode(raw, offsets)
        at = np.concatenate([[0], np.cumsum(counts)])
        for k, text in enumerate(hard):
            want = tokenizer.encode(text or "", add_special_tokens=False).ids
            assert got[at[k] : at[k + 1]].tolist() == want, text
            assert lexicon.decode(np.array(want, np.int64)).tobytes().decode() == tokenizer.decode(want, skip_special_tokens=False)


def test_transducer_is_minimal():
    words = sorted({a + b for a in (b"walk", b"talk", b"jump", b"j") for b in (b"", b"s", b"ed", b"ing", b"ings")})
    ids = [(1, len(w) % 3, w[-1]) for w in words]
    states = transducer.minimal(words, ids)
    lexicon = transducer.packed(states)

    def walk(word):
        state, out = len(states) - 1, ()
        for byte in word:
            step = [(to, given) for b, to, given in states[state][1] if b == byte]
            if not step:
                return None
            state, out = step[0][0], out + step[0][1]
        return None if states[state][0] is None else out + states[state][0]

    assert [walk(w) for w in words] == ids and walk(b"wal") is None and walk(b"walking!") is None
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    rest = lambda p: {w[len(p) :]: x for w, x in zip(words, ids, strict=True) if w.startswith(p)}

    def residual(p):  # continuations with what their ids have beyond what all share: equal for equivalent prefixes alone
        own = rest(p)
        n = 0
        while p and all(len(x) > n for x in own.values()) and len({x[n] for x in own.values()}) == 1:
            n += 1
        return tuple(sorted((w, x[n:]) for w, x in own.items()))

    assert len(states) == len({residual(p) for p in prefixes})
    cells, ends = lexicon["cells"], lexicon["ends"]
    assert (cells[:, 0] >= 0).sum() == sum(len(a) for _, a in states) and len(ends) == len(cells)


def test_encode_decode(spark, docs, rows, tokenizer, monkeypatch):
    given = [*rows, (None, "a row without an id"), (None, None), (5, "One"), (5, "One"), (900, "a long text, and it's cut in parts. " * 3000), (901, "x<|endoftext|>y " * 9)]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in given], "doc_id long, text string, n_tokens int, word string").repartition(3)
    for most in (1 << 17, 40, 0):
        got = transducer.encode_decode(frame, queries.tokenizer_path(), most, keep_ids=True).collect()
        want = Counter()
        for i, t in given:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids), t or "")] += 1
        assert Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in got) == want, most
    assert transducer.encode_decode(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_long_rows_come_in_parts(tokenizer):
    lexicon = transducer.Lexicon(transducer.rules(queries.tokenizer_path()) | transducer.packed(transducer.minimal([], [])))
    text = "It's a text of  many words\n and lines, isn't it? " * 60_000
    raw, offsets = text_buffers(pa.array([text, "next"]))
    parts = list(transducer.stretches(raw, offsets, lexicon.added))
    assert len(parts) == 4 and max(len(p) for _, p, _ in parts) < 1.1e6
    ids = np.concatenate([lexicon.encode(p, own)[0] for row, p, own in parts if row == 0])
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_query_op12(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op12_bpe_transducer(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert tuple(got[i]) == (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


# ---------------------------------------------------------------- audit


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    parts = {}
    for i, t, source in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i,
        }
        parts.setdefault(source or "", []).append(({k for k, v in own.items() if v}, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        removed_by, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removed_by[x] += len(gone)
                failing = sum(x in d[0] for d in docs)
                lines.append((x, part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[0] == {x} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*line, removed_by[x]) for x, *line in lines]
    return sorted(out)


def test_audit(spark, rows):
    given = [(i, t, (None, "", "a", "b")[i % 4]) for i, t in rows]
    given += [(None, rows[13][1], "a"), (None, None, None), (12, rows[13][1], "b"), (12, rows[13][1], "c"), (500, rows[13][1], "a"), (501, "SHOUT # " * 60, "a"), (502, "cost $5 " * 2, "b"), (503, "é" * 99 + "ABCDE", "b")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60)] + [(3, None, 1), (4, 1, None), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in given], "doc_id long, text string, source string, words string, mask int").repartition(3)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    columns = ["part", "filter_order", "step", *audit.COUNTS]
    got = audit.audit(frame, marks)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == brute_audit(given, labels)
    assert sorted(map(tuple, audit.audit(frame, marks.limit(0)).collect())) == brute_audit(given, [])
    assert audit.audit(frame.limit(0), marks).count() == 0


def test_removal_polynomial():
    random.seed(2)
    counts = [random.randint(0, 9) for _ in range(32)]
    p = audit.RemovalPolynomial(counts, 5)
    for s in range(32):
        assert p.corner(s) == sum(c for m, c in enumerate(counts) if m & s)
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += p.corner(before | 1 << i) - p.corner(before)
        assert p.shapley(i) * 120 == total
