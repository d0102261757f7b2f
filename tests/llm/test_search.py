"""Decontamination, near duplicates, token files and language-model scores against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import decontaminate, jaccard, ledger, lm, queries, repair

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination(spark, docs, rows):
    long = rows[13][1]
    items = [(0, " ".join(long.split()[20:60])), (10, "One"), (2, None), (3, ""), (4, "..."), (5, rows[11][1].upper().replace(" ", ",  ")), (5, "two words"), (6, "never seen in any text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()}
        assert len(got) == len(rows)
        for doc_id, text in rows:
            words, hit, found = alnum(text), set(), set()
            for item, body in items:
                iw = alnum(body)
                for k in range(max(1, len(iw) - 12) if iw else 0):
                    w = iw[k : k + 13]
                    for p in range(len(words) - len(w) + 1):
                        if words[p : p + len(w)] == w:
                            hit.update(range(p, p + len(w)))
                            found.add(item)
            r = got[doc_id]
            ids = sorted(map(str, found))
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), len(hit), len(ids)), (doc_id, text)
            assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
            assert r["contaminated"] == (bool(hit) and 20 * len(hit) >= len(words))
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_decontamination_keeps_clashing_columns(spark, docs, rows):
    bench = spark.createDataFrame([(k, t) for k, t in rows[12:20]], "item_id long, text string")
    clash = docs.selectExpr("doc_id", "text", "'mine' AS sofar_", "doc_id AS SOFAR__")
    for block in (1 << 20, 300):
        got = decontaminate.decontaminate(clash, bench, block_bytes=block, keep=True)
        assert got.columns == ["doc_id", "text", "sofar_", "SOFAR__", *decontaminate.MARKS]
        assert got.filter("sofar_ = 'mine' AND SOFAR__ <=> doc_id").count() == len(rows) and got.filter("n_hit > 0").count() >= 8


def test_windows_share_the_items_text():
    items = [(k, " ".join(f"w{(k * i * 7 + i) % 50}" for i in range(120))) for k in range(40)] + [(7, "w1 w2"), (8, "w1 w2"), (9, "")]
    m = decontaminate.Matcher(items, 13)
    words = [t.split() for _, t in items]
    want = {}
    for (k, _), w in zip(items, words, strict=True):
        for i in range(max(1, len(w) - 12) if w else 0):
            want.setdefault(tuple(w[i : i + 13]), set()).add(k)
    got = {}
    for g in m.groups:
        for n, a, size in zip(g.numbers.tolist(), g.start.tolist(), g.length.tolist(), strict=True):
            text = m.text[a : a + size].decode()
            assert text[0] == text[-1] == " " and m.words[n] == len(text.split())
            got[tuple(text.split())] = {m.ids[i] for i in m.owner[m.owner_at[n] : m.owner_at[n + 1]].tolist()}
    assert got == want


def brute_classes(rows, words=5, percent=80):
    sets = {}
    for i, t in rows:
        w = spaced(t)
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    equal = Counter(frozenset(s) for s in sets.values())
    return {i: (len(s), least[i], equal[frozenset(s)] if s else 1) for i, s in sets.items()}


@pytest.mark.parametrize("hot", [20, 2])
def test_near_duplicates(docs, rows, hot):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_equal"]) for r in jaccard.near_duplicates(docs, hot_entries=hot).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_chain_and_passages(spark):
    """Chains of links without a common centre, and unlike texts that share a passage."""
    base = [f"w{i}" for i in range(120)]
    rows, passage = [], [f"p{i}" for i in range(60)]
    for k in range(30):
        rows.append((1000 - k, " ".join([f"z{i}" for i in range(2 * k)] + base[2 * k :])))
    for k in range(40):
        rows.append((2000 + k, " ".join([f"u{k}_{i}" for i in range(30 + k)] + passage)))
        rows.append((3000 + k, " ".join(passage + [f"v{k}_{i % (k + 1)}" for i in range(k % 7)])))
    for n in range(1, 26):
        rows += [(4000 + n, " ".join(f"s{n}_{i}" for i in range(n + 4))), (5000 + n, " ".join(f"s{n}_{i}" for i in range(n + 3))), (6000 + n, " ".join(f"s{n}_{i}" for i in range(n + 5)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot, short, size in ((20, 12, 4 << 20), (3, 2, 4000)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_equal"]) for r in jaccard.near_duplicates(docs, hot_entries=hot, short_list=short, block_bytes=size).collect()}
        assert got == brute_classes(rows)
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_shared_counts():
    import numpy as np

    rng = np.random.default_rng(6)
    sets = [[set(rng.integers(0, 60, rng.integers(0, 40)).tolist()) for _ in range(n)] for n in (30, 50)]
    flat = [np.array([t for x in own for t in sorted(x)], np.uint64) for own in sets]
    rows = [np.repeat(np.arange(len(own)), [len(x) for x in own]) for own in sets]
    for frequent in (1, 12, 1000):
        got = jaccard.shared_counts(flat[0], rows[0], 30, flat[1], rows[1], 50, frequent)
        assert got.tolist() == [[len(x & y) for y in sets[1]] for x in sets[0]]


def test_boundary_follows_cost():
    lists = {n: float(n) for n in range(1, 33)}
    cheap = jaccard.choose_boundary({n: 10 for n in range(1, 33)}, {n: 1e6 for n in lists}, 80)
    assert cheap > 20
    assert jaccard.choose_boundary({n: 10 for n in range(1, 33)}, {n: 1.0 for n in lists}, 80) < cheap
    assert jaccard.choose_boundary({30: 4}, {30: 3.0}, 80) == 0


@pytest.mark.parametrize("boundary", [3, 9, 14, 20])
def test_light_sets_link_as_brute_force_says(spark, monkeypatch, boundary):
    """Small sets of many sizes that share most of their shingles: whatever is light, the classes are the same."""
    rng = np.random.default_rng(boundary)
    rows = []
    for g in range(14):
        words = [f"g{g}w{i}" for i in range(int(rng.integers(6, 24)))]
        for _ in range(9):
            a, b = int(rng.integers(0, 4)), int(rng.integers(0, 4))
            rows.append((len(rows), " ".join(words[a : len(words) - b] + [f"x{rng.integers(3)}"] * int(rng.integers(0, 3)))))
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *_: boundary)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: x[1] for i, x in brute_classes(rows).items()}


def test_measured_lists_make_the_light_half_link_unlike_sets(spark, monkeypatch):
    """With the sizes of a registered table, and more small near copies among them, sets of different sizes meet by their subsets."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    small = [(10**6 + 100 * g + k, " ".join([f"g{g}w{i}" for i in range(13)] + [f"end{k}"] * (k > 0))) for g in range(6) for k in range(30)]
    given = docs.unionByName(spark.createDataFrame(small, "doc_id long, text string"))
    chosen, seen = [], []
    choose, entries = jaccard.choose_boundary, jaccard._entries

    def spy(sizes, lists, percent):
        chosen.append(choose(sizes, lists, percent))
        assert all(lists[n] >= 1 for n in lists)
        return chosen[-1]

    def kept(*args):
        out = entries(*args)
        if args[-1] is not None:
            seen.append(out.filter("sure").select("key", "rep", "n").toPandas())
        return out

    monkeypatch.setattr(jaccard, "choose_boundary", spy)
    monkeypatch.setattr(jaccard, "_entries", kept)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(given).collect()}
    assert chosen and chosen[0] >= 10
    sizes = seen[-1].groupby("key")["n"].nunique()
    assert (sizes > 1).any()  # one subset, two sizes of set
    assert all(got[i] == 10**6 + (i - 10**6) // 100 * 100 for i, _ in small)


def test_token_files(spark, docs, rows, tmp_path):
    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)  # as the contract loads it
    special = "a   <|endoftext|>  b <|endof text|> <|endoftext|><|endoftext|>"
    rows = [*rows, (900, special), (901, "  ".join([special, rows[14][1], special])), (902, "w1 w2 " * 4000), (902, None), (902, "zz")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    folder = repair.write(docs, path, f"file://{tmp_path}/t", shard_bytes=3000)
    got = {(r["doc_id"], r["ids_crc32"]): r for r in repair.read(spark, folder).collect()}
    assert len(got) == len(rows)
    shards = {(r["part"], r["seq"]): repair.Shard(bytes(r["shard"])) for r in spark.read.parquet(folder).collect()}
    size = 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[doc_id, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))]
        assert r["n_tokens"] == len(ids)
        assert r["start"] == size or doc_id == 902
        shard = shards[r["part"], r["seq"]]
        assert shard.document(r["at"]).tolist() == ids
        assert [shard.token(r["at"], p) for p in range(0, len(ids), 97)] == ids[::97]
        size += len(ids)
    ordered = sorted(got.values(), key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:k]) for k in range(len(ordered))]
    assert repair.read(spark, repair.write(docs.limit(0), path, f"file://{tmp_path}/e")).count() == 0


def opened(ids, counts, **kw):
    shard = repair.Shard(repair.compress(np.array(ids, np.uint32), np.array(counts, np.int64), **kw))
    assert shard.expand(shard.symbols(0, shard.n_symbols)).tolist() == list(ids) and shard.sizes().tolist() == list(counts)
    return shard


def test_grammar_shrinks_repeats():
    shard = opened(np.tile(np.arange(3, 40), 500).tolist(), [0, 100, 18400, 0])
    assert shard.n_symbols < 18500 / 8
    assert opened([], [0, 0]).document(1).tolist() == []
    assert opened([7] * 1000, [1000]).n_symbols < 100
    opened([1, 2] * 500 + [3] * 77, [3, 1074])


def paying(shard):
    """Pairs with four occurrences or more that do not overlap, over documents one by one."""
    found = Counter()
    for i in range(shard.n_docs):
        own, last = shard.symbols(int(shard.starts[i]), int(shard.starts[i + 1])).tolist(), None
        for k, pair in enumerate(zip(own[:-1], own[1:], strict=True)):
            if last != (k - 1, pair):
                found[pair] += 1
                last = (k, pair)
            else:
                last = None
    return {p: c for p, c in found.items() if c >= repair.PAYS}


def test_grammar_goes_on_until_no_pair_pays():
    ids, counts = corpus_ids(200)
    shard = opened(ids, counts)
    assert not paying(shard)
    assert len({tuple(r) for r in shard.rules.tolist()}) == len(shard.rules)
    size = len(repair.compress(np.array(ids, np.uint32), np.array(counts, np.int64)))
    plain = len(repair.compress(np.array(ids, np.uint32), np.array(counts, np.int64), pays=1 << 20))
    assert size < 0.85 * plain and size < 0.85 * 2 * len(ids)


def corpus_ids(n):
    """Ids of the first documents of a test table."""
    import pyarrow.parquet as pq

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:n]
    own = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return [x for o in own for x in o], [len(o) for o in own]


def test_encoder_equals_library():
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rng = np.random.default_rng(11)
    parts = [" ", "  ", "\n", "a", "Don't", " it's", "\u00e9", "\u4f60\u597d", "\u00a0", "\u3000", "<|endoftext|>", "<|", "12 345", "!", "\t", "x" * 40, "\u0301", "\U0001f600"]
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 30))) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    for encoder in (repair.WordEncoder(tokenizer), repair.WordEncoder(tokenizer, slot_bits=4, most_ids=50)):
        ids, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        at = np.concatenate([[0], np.cumsum(counts)])
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_lm(docs, rows):
    from pyspark.sql import functions as F

    train = docs.withColumn("train", F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r for r in lm.score(train, "train", group_bytes=4000).collect()}
    count = Counter(w for i, t in rows if i % 3 for w in [*spaced(t), None])
    n, v = sum(count.values()), len(count)
    better = []
    for i, t in rows:
        tokens = [*spaced(t), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] <= 0 and math.isfinite(r["score"])
        better.append(r["score"] > r["base_score"])
    assert sum(better) > 0.7 * len(better)
    alone = lm.score(docs.withColumn("train", F.lit(False)), "train").collect()
    assert {r["train_tokens"] for r in alone} == {0}
    assert lm.score(train.limit(0), "train").count() == 0
    odd = train.unionByName(train.filter("doc_id = 12").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *[c for c in train.columns if c not in ("doc_id", "train")], "CAST(NULL AS BOOLEAN) AS train"))
    odd = {r["doc_id"]: r for r in lm.score(odd, "train", group_bytes=4000).collect()}
    assert odd[None]["score"] == odd[12]["score"] and not odd[None]["train"] and odd[None]["train_tokens"] == n


@pytest.mark.parametrize("mapped", [64 << 30, 20_000])
def test_lm_keeps_every_level_in_stored_segments(docs, rows, monkeypatch, mapped):
    """Bigrams and trigrams seen once count too; the driver gets neither counts nor filters, whether they are mapped at once or in groups."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    def gathered(*_):
        raise AssertionError("gathered")

    train = docs.withColumn("train", F.col("doc_id") % 3 != 0)
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", gathered)
        scored = lm.score(train, "train", group_bytes=4000, mapped_bytes=mapped)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    words, pairs, triples = Counter(), Counter(), Counter()
    for i, t in rows:
        tokens = [None, *spaced(t), None]
        if i % 3:
            words.update(tokens[1:])
            pairs.update(zip(tokens[:-1], tokens[1:], strict=True))
            triples.update(zip(tokens[:-2], tokens[1:-1], tokens[2:], strict=True))

    def quantised(c):
        q = c.bit_length()
        return q if q <= 1 else 1.5 * 2 ** (q - 1) - 0.5

    n, v, near = sum(words.values()), len(words), 0
    for i, t in rows:
        tokens, total = [None, *spaced(t), None], 0.0
        for k in range(1, len(tokens)):
            x, y = tokens[k - 1 : k + 1]
            both = min(quantised(pairs[x, y]), words[x], words[y])
            p = (both + 1000 * (words[y] + 0.1) / (n + 0.1 * (v + 1))) / (words[x] + 1000)
            if k > 1:
                before = min(quantised(pairs[tokens[k - 2], x]), words[tokens[k - 2]], words[x])
                p = (min(quantised(triples[tokens[k - 2], x, y]), before, both) + 16 * p) / (before + 16)
            total += math.log10(p)
        near += math.isclose(got[i], total, rel_tol=1e-9)
    assert sum(c == 1 for c in pairs.values()) > 100 and near > 0.7 * len(rows)


def test_filter_levels_without_misses():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * 2
    counts = rng.integers(1, 40, len(keys))
    level = np.floor(np.log2(counts)).astype(int) + 1
    held = {k: np.frombuffer(lm.LevelFilter.build(keys[level >= k], k, 16, 4), np.uint8) for k in range(1, level.max() + 1)}
    model = lm.LevelFilter(held, 4)
    reached = model.quantised(keys)
    assert (reached >= level).all() and (reached > level).mean() < 0.02
    unseen = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * 2 + 1
    assert (model.quantised(unseen) > 0).mean() < 0.01
    assert not lm.LevelFilter({}, 4).quantised(unseen).any() and not len(model.quantised(unseen[:0]))
    # a filter of 16 bits a key for each level takes less than keys and counts in the clear
    assert sum(map(len, held.values())) < 0.6 * len(keys) * 16


def test_segments_answer_their_bucket(spark, docs, rows):
    segments = lm.learn(docs, 5, lm.key_mask(10_000), chunk_bytes=700).collect()
    files = {r["bucket"]: r["file"] for r in segments}
    assert set(files) == set(range(5))
    count = Counter(w for _, t in rows for w in [*spaced(t), None])
    assert sum(r["words"] for r in segments) == len(count) and sum(r["total"] for r in segments) == sum(count.values())
    import pyarrow as pa

    words = sorted({w for w in count if w})
    keys = np.concatenate([t[:1] for w in words for _, t, _ in lm.token_hashes(pa.array([w]))])
    assert lm.probed(keys, files, 5, 4, True).tolist() == [count[w] for w in words]
    some = {k: v for k, v in files.items() if k < 2}
    assert [x for x in lm.probed(keys, some, 5, 4, True).tolist() if x] and not lm.probed(keys + np.uint64(1), files, 5, 4, True).any()
    assert int(lm.key_mask(1)) == (1 << 64) - (1 << 24) and int(lm.key_mask(1 << 60)) == (1 << 64) - 1


def test_pack():
    import numpy as np

    keys = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 100, dtype=np.uint64))
    assert (ledger.unpack(ledger.pack(keys)) == keys).all()
    parts = ledger.bucket_rows(1, keys, np.ones(100), 7)
    assert sum(len(p[3]) for p in parts) == 400


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)
