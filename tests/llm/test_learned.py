"""Nearest neighbours, quality, archives, mixing, passages, edits and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import ann, chunking, edits, mixing, quality, queries, repair, warc

from .conftest import sentence


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16))
    rows = [(i, x[i].tolist(), 0) for i in range(1500)]
    rows += [(2000 + i, x[7].tolist(), 0) for i in range(4)]  # ties
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + [1.0] * 15, 1), (3003, [None] + [1.0] * 15, 1), (3004, [], 1), (3005, [1e200] * 16, 1), (3006, [1e-200] * 16, 1), (None, [1.0] * 16, 1), (3007, [1.0, 2.0], 1), (3050, [2.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = ann.search(frame, frame.filter("vec_id % 50 = 0 or vec_id = 7 or vec_id = 3005"), block=500, query_block=16).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = {r[0]: np.array(r[1]) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])}
    assert set(by) == {i for i in good if i % 50 == 0 or i in (7, 3005)}
    hits = total = 0
    unit = lambda v: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())
    for q, found in by.items():
        want = sorted((-round(float(unit(good[q]) @ unit(v)), 12), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        hits += len({i for _, i in want} & {i for i, _ in found})
        total += len(want)
        assert len(found) == len(want)
        for i, s in found:
            assert math.isclose(s, float(unit(good[q]) @ unit(good[i])), abs_tol=1e-12)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hits / total >= 0.9
    assert [i for i, _ in by[7]][:4] == [2000, 2001, 2002, 2003]
    assert by[3050][0][0] == 3007 and len(by[3050]) == 1
    assert ann.search(frame.limit(0), frame).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_of_the_test_tables(spark, sf):
    """The registered query, and every row as a query, against all exact cosines."""
    folder = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit @ unit.T
    np.fill_diagonal(cos, -9)
    nearest = {int(i): ids[np.lexsort((ids, -row))[:5]].tolist() for i, row in zip(ids, cos, strict=True)}

    def recall(found):
        by = {}
        for r in found.collect():
            by.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert all(sorted(v) == [1, 2, 3, 4, 5] for v in by.values())
        return len(by), np.mean([len(set(v.values()) & set(nearest[i])) / 5 for i, v in by.items()])

    n, share = recall(queries.op1_collision_ann(spark, folder))
    assert n == (ids % 50 == 0).sum() and share >= 0.9
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    n, share = recall(ann.search(vectors, vectors))
    assert n == len(ids) and share >= 0.9


def test_windows_count_collisions():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 24))
    block = ann.Block(np.arange(300), x, 40, 3)
    for width in (0.2, 0.7, 2.0):  # narrow windows are counted by what is inside, wide ones by what is outside
        for q, at in block.candidates(block.unit[:20], 30, 25, width, 1.3):
            w = width
            while True:
                hits = (np.abs(block.unit @ block.axes - block.unit[q] @ block.axes) <= w).sum(1)
                if (hits >= 25).sum() >= 30:
                    break
                w *= 1.3
            assert at.tolist() == np.flatnonzero(hits >= 25).tolist()


def test_risk_and_its_clipped_branch():
    """Against the definition, written out: the risk's parts, and the step's slope by numeric differences."""
    rng = np.random.default_rng(3)
    for prior, shift in ((0.3, 0.0), (0.9, 3.0)):
        zp, zu = rng.normal(1, 1, 7) + shift, rng.normal(-1, 1, 9)
        first, bracket = quality.risk(zp, zu, prior)
        assert math.isclose(first, prior * sum(math.log(1 + math.exp(-z)) for z in zp) / 7)
        assert math.isclose(bracket, sum(math.log(1 + math.exp(z)) for z in zu) / 9 - prior * sum(math.log(1 + math.exp(z)) for z in zp) / 7)
        assert (bracket < 0) == (shift > 0)
        down = (lambda a, b: -quality.risk(a, b, prior)[1]) if bracket < 0 else (lambda a, b: sum(quality.risk(a, b, prior)))  # noqa: B023
        cp, cu = quality.slopes(zp, zu, prior)
        for z, c, f in ((zp, cp, lambda x: down(x, zu)), (zu, cu, lambda x: down(zp, x))):  # noqa: B023
            for k in range(len(z)):
                e = np.zeros(len(z))
                e[k] = 1e-5
                assert math.isclose(c[k], (f(z + e) - f(z - e)) / 2e-5, rel_tol=1e-4, abs_tol=1e-8)


def test_fit_and_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.75):
        good, bad = rng.normal(1, 1, (3000, 4)).astype(np.float32), rng.normal(-1, 1, (3000, 4)).astype(np.float32)
        mixed = np.concatenate([good[1000 : 1000 + int(2000 * share)], bad[: int(2000 * (1 - share))]])
        p, u = good[:1000].copy(), mixed.copy()
        quality.standardise(p, u)
        halves = np.arange(1000) % 2 == 0, np.arange(len(u)) % 2 == 0
        assert abs(quality.estimate_prior(p, u, *halves) - share) < 0.1
        w, mean, scale, bias = quality.fit(good[:1000].copy(), mixed.copy(), halves=halves)
        z = lambda x: ((x - mean) / scale) @ w + bias  # noqa: B023, E731
        assert (z(good) > 0).mean() > 0.9 and (z(bad[2000:]) < 0).mean() > 0.9


def test_quality(spark):
    good = [(i, sentence(i % 40, 30 + i % 50)) for i in range(400)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in sentence(i, 30 + i % 30).upper().split())) for i in range(100)]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (5001, ""), (5002, "x" * 200_000), (None, "no id")], "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    # trusted positives are drawn at random
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good if zlib.crc32(b"%d" % i) & 1] + [(i, 0, 0) for i, _ in bad if i % 2] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert len(got) == 504 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert sum(got[i]["predicted"] for i, _ in good) > 390 and sum(got[i]["predicted"] for i, _ in bad) < 5
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    only = {r["doc_id"]: r["score"] for r in quality.score(docs, labels.filter("quality = 1")).collect()}
    assert only == {i: r["score"] for i, r in got.items()}  # labels of negatives are not used
    assert quality.score(docs.limit(0), labels).count() == 0


def test_archives(spark, tmp_path):
    big = "<p>é" + "x" * 2000
    pages = [(1, "http://www.b.example.org/x?y#z", big), (2, "https://a.example.org", big), (9, "http://a.example.org/", big), (3, None, None), (4, "bad url [", "small"), (5, "http://c.example/", "small"), (None, "http://c.example/", big), (6, "http://d.example/\r\nHost: tab\t", "a\r\n\r\nWARC/1.1\r\n"), (7, "", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    folder, index = warc.write(frame, f"file://{tmp_path}/w", roll=1500)
    got = {r["page_id"]: r for r in warc.read(warc.look_up(frame, index), folder).collect()}
    assert len(got) == len(pages)
    for page_id, url, html in pages:
        data, r = (html or "").encode(), got[page_id]
        revisit = html == big and page_id != 9
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert r["url"] == (url or "") and r["payload"] == (None if revisit else html or "")
    urls = spark.createDataFrame([("https://b.example.org/x?y",), ("http://A.example.org",), ("http://none.example/",), (None,), ("http://a.example.org/",)], "url string")
    found = warc.look_up(urls, index)
    assert sorted(r["page_id"] for r in found.collect()) == [1, 2, 3, 7, 9]
    assert sorted(r["page_id"] for r in warc.read(found, folder).filter("record_type = 'response'").collect()) == [3, 7, 9]
    assert warc.read(warc.look_up(frame, warc.write(frame.limit(0), f"file://{tmp_path}/e")[1]), folder).count() == 0
    again = frame.union(frame.filter("page_id IN (1, 9)"))
    folder, index = warc.write(again, f"file://{tmp_path}/r")
    assert sorted((r["page_id"], r["record_type"]) for r in warc.read(warc.look_up(again, index), folder).collect() if r["page_id"] in (1, 9)) == [(1, "revisit")] * 2 + [(9, "response")] * 2


@pytest.mark.parametrize("stretch", [256, 2])
def test_index_blocks(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(warc, "STRETCH", stretch)
    rows = [(f"com,h{i % 37})/", i, "f", i, 1) for i in range(700)] + [("com,hot)/", 1000 + i, "f", i, 1) for i in range(900)]
    index = warc.index(spark.createDataFrame(rows, "key string, page_id long, file string, offset long, length long"), block=64)
    urls = spark.createDataFrame([("http://hot.com/",), ("http://h5.com",)], "url string")
    named = warc.named_blocks(spark.createDataFrame([("com,h5)/",), ("com,h9)/",)], "wanted string"), index).collect()
    wide = warc.look_up(urls, index)
    assert "NestedLoop" not in wide._jdf.queryExecution().toString()
    assert len(named) <= 4 < spark.read.parquet(f"{index}/directory").count()  # no other block is read
    assert sorted(r["page_id"] for r in warc.look_up(urls, index).collect()) == sorted([i for i in range(700) if i % 37 == 5] + [1000 + i for i in range(900)])


def dense_raking(cells, rounds=200):
    """Default targets and raking in plain arrays: p of every cell at half of the tokens."""
    tokens = np.array([c[3] for c in cells], float)
    margin = []
    for k in range(3):
        sums = {}
        for c in cells:
            sums[c[k]] = sums.get(c[k], 0) + c[3]
        root = {v: t**0.5 for v, t in sums.items()}
        margin.append({v: r / sum(root.values()) for v, r in root.items()})
    w = tokens / tokens.sum()
    for _ in range(rounds):
        for k in range(3):
            now = {}
            for c, x in zip(cells, w, strict=True):
                now[c[k]] = now.get(c[k], 0) + x
            w = np.array([x * margin[k][c[k]] / now[c[k]] for c, x in zip(cells, w, strict=True)])
    low, high = 0.0, 1e18
    for _ in range(300):  # the factor at which the expected tokens are half of all
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(w * mid, tokens).sum() < tokens.sum() / 2 else (low, mid)
    return dict(zip((c[:3] for c in cells), np.minimum(w * low / tokens, 1.0), strict=True))


def test_mixing_query_equals_dense_raking(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op4_mix_ipf(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    cells = {}
    for r in got:
        if r["m_tokens"]:
            k = (r["m_source"], r["m_lang"], r["m_topic"])
            cells[k] = cells.get(k, 0) + r["m_tokens"]
    want = dense_raking([(*k, n) for k, n in cells.items()])
    for r in got:
        p = want[r["m_source"], r["m_lang"], r["m_topic"]] if r["m_tokens"] else 0.0
        assert abs(r["p"] - p) < 1e-5 and (r["p"] > 0 or not r["selected"])


def test_default_targets_that_cells_cannot_meet(spark):
    # 'b' has one topic alone, which has nothing else: no weights give both their tempered shares
    rows = [("a", "x", "t", 900), ("a", "y", "t", 90), ("b", "x", "u", 10), ("b", "y", "u", 4000), ("c", "x", "v", 1)]
    cells = spark.createDataFrame(rows, "m_source string, m_lang string, m_topic string, tokens long")
    odd = spark.createDataFrame([("a", "x", "t", 1000), ("b", "y", "t", 10), ("a", "y", "u", 0)], cells.schema)
    for table in (cells, odd):
        raked = mixing.weighted(table, None)
        assert mixing.most_off(raked, mixing.margins(raked)) < 1e-9 and abs(sum(r["w"] for r in raked.collect()) - 1) < 1e-6
    goal = spark.createDataFrame([("m_source", "a", 0.5), ("m_source", "b", 0.5), ("m_lang", "x", 0.1), ("m_lang", "y", 0.9), ("m_topic", "t", 1.0)], "margin string, value string, share double")
    with pytest.raises(ValueError, match="off by"):
        mixing.weighted(odd, goal)


def test_raking_meets_margins(spark):
    cells = spark.createDataFrame([(s, lang, t, 100 * (i + 1)) for i, (s, lang, t) in enumerate((s, lang, t) for s in "abc" for lang in "xy" for t in "pq")], "m_source string, m_lang string, m_topic string, tokens long")
    goal = mixing.targets(cells)
    for local in (100, 0):
        w = mixing.rake(cells, goal, rounds=25, most_local=local)
        for m in mixing.MARGINS:
            got = {r[m]: r["x"] for r in w.groupBy(m).agg(F.sum("w").alias("x")).collect()}
            want = {r["value"]: r["share"] for r in goal.filter(F.col("margin") == m).collect()}
            assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in got)
    total = 100 * 78
    for share in (0.2, 0.7, 1.0, 0.0):
        p = mixing.calibrated(mixing.rake(cells, goal), share * total).collect()
        assert math.isclose(sum(r["p"] * r["tokens"] for r in p), share * total, rel_tol=1e-3, abs_tol=1)
        assert all(0 <= r["p"] <= 1 for r in p)


def test_mixing(spark, docs, rows):
    many = spark.createDataFrame([(i, sentence(i, 5 + i % 90), ["en", "de", None][i % 3], ["hot", "hot", "s1", "s2"][i % 4], 1) for i in range(3000)], "doc_id long, text string, lang string, source string, p int")
    out = mixing.sample(many, 0.5).collect()
    total = sum(r["m_tokens"] for r in out)
    assert len(out) == 3000 and abs(sum(r["m_tokens"] for r in out if r["selected"]) / total - 0.5) < 0.05
    shares = {}
    for r in out:
        if r["selected"]:
            shares[r["m_source"]] = shares.get(r["m_source"], 0) + r["m_tokens"]
    assert abs(shares["hot"] / sum(shares.values()) - math.sqrt(2) / (math.sqrt(2) + 2)) < 0.06
    odd = {r["doc_id"]: r for r in mixing.sample(docs).collect()}
    assert len(odd) == len(rows) and not odd[0]["selected"] and odd[0]["p"] == 0
    assert mixing.sample(docs.limit(0)).count() == 0


def test_mixing_with_structural_zeros(spark):
    """A hot source in two languages beside sources of one: no weights meet the square root of each margin by itself."""
    parts = [("a", "x", 400), ("a", "y", 100), *((f"s{k}", "y", 50) for k in range(10))]
    cells = spark.createDataFrame([(s, lang, "prose", 1000 * n) for s, lang, n in parts], "m_source string, m_lang string, m_topic string, tokens long")
    with pytest.raises(ValueError):
        mixing.weighted(cells, mixing.targets(cells))
    with pytest.warns(UserWarning, match="default share off"):
        found = mixing.weighted(cells, None)
    for share in (0.5, 0.8):
        p = mixing.calibrated(found, share * 1_000_000).collect()
        assert math.isclose(sum(r["p"] * r["tokens"] for r in p), share * 1_000_000, rel_tol=1e-9)
        assert all(0 < r["p"] <= 1 for r in p)
    # a cell of next to no weight does not coarsen the search
    skew = spark.createDataFrame([(1000, 0.7), (1000, 0.3 - 1e-26), (1000, 1e-26)], "tokens long, w double")
    assert [round(r["p"], 9) for r in mixing.calibrated(skew, 1500.0).orderBy(F.desc("w")).collect()] == [1.0, 0.5, 0.0]


def repeated_words(texts, n):
    """For each text, whether n of its words in a row, as bytes, are also in another."""
    seen = {}
    for i, t in enumerate(texts):
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        for k in range(len(at) - n + 1):
            seen.setdefault((t or "").encode()[at[k][0] : at[k + n - 1][1]], set()).add(i)
    twice = [x for x in seen.values() if len(x) > 1]
    return set().union(*twice) if twice else set()


def test_passages(spark, rows):
    """Every repetition of 51 words is found, down to words of one letter; none is named for less than 40."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    text = lambda n, size: " ".join(word(max(1, int(rng.integers(size - 1, size + 2)))) for _ in range(n))
    texts, planted = [], []
    for k in range(120):
        size = 1 + k % 6
        passage = text(51 if k % 3 else 30 + k % 9, size)
        for _ in range(2):
            planted.append((len(texts), passage, k % 3 != 0))
            texts.append(f"{text(int(rng.integers(0, 90)), 5)} {passage} {text(int(rng.integers(0, 90)), 5)}".strip())
    copy = text(400, 5)
    texts += [copy, copy, copy + " and more", "a " * 300, "a " * 400, "z" * 300_000, "z" * 300_000 + " end", None, "", text(60, 4) + " " + text(60, 4)]
    inner = text(70, 4)
    texts.append(f"{inner} {text(9, 4)} {inner}")  # repeats itself alone
    frame = spark.createDataFrame([*enumerate(texts), (None, copy)], "doc_id long, text string").withColumn("g", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: r for r in chunking.repeated_passages(frame, group_bytes=60_000).collect()}
    assert repeated_words(texts, 51) <= set(got) <= repeated_words(texts, 40)
    for i, passage, long in planted:
        data = texts[i].encode()
        at = data.index(passage.encode())
        assert (i in got) == long
        if long:
            assert any(s["start"] <= at + 64 and s["end"] >= at + len(passage) - 64 and s["start"] >= at - 40 and s["end"] <= at + len(passage) + 40 for s in got[i]["spans"])
    whole = len(copy.encode())
    assert got[240]["removable_bytes"] <= 40  # a chunk of few bytes may be an older row's too
    assert got[241]["removable_bytes"] == got[241]["repeated_bytes"] == whole
    assert [tuple(x) for x in got[241]["spans"]] == [(0, whole, 240)]
    assert chunking.repeated_passages(frame.limit(0)).count() == 0
    other = {r["doc_id"]: r for r in chunking.repeated_passages(frame, group_bytes=1 << 20).collect()}
    assert got == other
    twice = spark.createDataFrame([(1, copy), (1, copy)], "doc_id long, text string")
    assert [(r["doc_id"], r["removable_bytes"]) for r in chunking.repeated_passages(twice).collect()] == [(1, 0)] * 2


def test_gear_hash_and_cuts():
    raw = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8)
    raw[1000:1400] = 97
    offsets = np.array([0, 0, 3, 30, 3000, 3000, 5000])
    place = np.concatenate([np.arange(n) for n in np.diff(offsets)])
    h = chunking.gear_hash(raw, place)
    for i in (0, 2, 3, 20, 31, 400, 3001, 3020, 4999):
        want = sum(int(chunking._GEAR[raw[i - k]]) << k for k in range(min(int(place[i]) + 1, 16)))
        assert int(h[i]) == want % 2**32
    starts, ends, row = chunking.chunks(raw, offsets)
    got = {r: [(s - offsets[r], e - offsets[r]) for s, e, x in zip(starts, ends, row, strict=True) if x == r] for r in range(6)}
    for r in range(6):  # as for the row alone, and as defined
        part = raw[offsets[r] : offsets[r + 1]]
        alone = chunking.chunks(part, np.array([0, len(part)]))
        assert got[r] == list(zip(alone[0], alone[1], strict=True))
        own = h[offsets[r] : offsets[r + 1]].tolist()
        cuts = {j + max(k for k in range(40) if own[j + k] == min(own[j : j + 40])) + 1 for j in range(len(own) - 39)} - {len(own)}
        assert [s for s, _ in got[r]] == sorted(cuts | {0} if len(own) else cuts)


def apply(text, script):
    data = (text or "").encode()
    for _, start, end, new in sorted(script):
        whole = lambda b: next(x for x in range(min(max(0, b), len(data)), -1, -1) if x in (0, len(data)) or data[x] & 0xC0 != 0x80)  # noqa: B023, E731
        start, end = whole(start), whole(end)
        data = data[:start] + new.encode() + data[max(start, end) :]
    return data.decode()


def test_edits(spark, docs, rows):
    rng = np.random.default_rng(8)
    script = [(i, int(k), int(a), int(a + b), [" ", "", "new word", "  x ", "é\n", "'s", "don", sentence(3, 80)][int(c)]) for i, t in rows for k, a, b, c in zip(range(5), rng.integers(-3, len(t or "") + 9, 5), rng.integers(-2, 60, 5), rng.integers(0, 8, 5), strict=True)]
    script += [(9999, 0, 0, 5, "unknown"), (None, 0, 0, 5, "none")]
    frame = spark.createDataFrame(script, "doc_id long, seq long, start long, end long, new string")
    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    got = {r["doc_id"]: r for r in edits.count_edits(docs, frame, path, group_bytes=5000).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        after = apply(t, [s[1:] for s in script if s[0] == i])
        assert (got[i]["tokens_before"], got[i]["tokens_after"], got[i]["n_edits"], got[i]["n_bytes"]) == (count(t), count(after), 5, len(after.encode())), i
    assert got[25]["reencoded_bytes"] < len(rows[25][1].encode()) * 3
    assert edits.count_edits(docs.limit(0), frame, path).count() == 0
    assert edits.count_edits(docs, frame.limit(0), path).filter("tokens_before != tokens_after or n_edits != 0").count() == 0


def test_growing_texts_are_encoded_by_regions(spark):
    rows = [(1, ""), (2, sentence(3, 900)), (3, None), (4, "start " * 40)]
    script = [(1, k, 10**9, 10**9, sentence(k, 110) + ". ") for k in range(60)]  # appended
    script += [(2, k, 400, 400, sentence(k, 90) + "! ") for k in range(60)]  # always at one place
    script += [(4, k, 37 * k * k, 37 * k * k + 15, sentence(k, 70)) for k in range(60)]  # all over
    script += [(3, 0, 0, 0, "x")]
    frame = spark.createDataFrame(script, "doc_id long, seq long, start long, end long, new string")
    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in edits.count_edits(spark.createDataFrame(rows, "doc_id long, text string"), frame, path).collect()}
    for i, t in rows:
        data = (t or "").encode()
        for _, _, a, b, new in sorted(s for s in script if s[0] == i):
            a, b = min(a, len(data)), min(b, len(data))
            while 0 < a < len(data) and data[a] & 0xC0 == 0x80:
                a -= 1
            while 0 < b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            data = data[:a] + new.encode() + data[max(a, b) :]
        assert (got[i]["n_bytes"], got[i]["tokens_after"]) == (len(data), len(tokenizer.encode(data.decode(), add_special_tokens=False).ids)), i
    for i in (1, 2, 4):
        added = sum(len(s[4].encode()) for s in script if s[0] == i)
        assert got[i]["n_edits"] == 60 and got[i]["reencoded_bytes"] < added + 60 * 4096
    assert got[1]["n_bytes"] > 30_000


def test_edit_regions_are_local():
    encoder = repair.WordEncoder(repair.load_tokenizer(queries.tokenizer_path()))
    text = sentence(4, 4000).encode()
    tree = edits.trees(encoder, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    low, high, data = tree.region(9000, 9004, b"x")
    assert high - low <= 3 and len(data) < 1500 and tree.text() == text


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clash = {"score": "s", "Predicted": "p", "n_words": "w", "contaminated": "c", "m_topic": "t", "p": "q", "selected": "x"}
    docs = docs.withColumns({c: F.concat(F.lit(v), F.col("doc_id").cast("string")) for c, v in clash.items()})
    first = docs.filter("doc_id = 7")
    odd = spark.createDataFrame([(90001, None), (90002, ""), (90003, " \n "), (None, "a row without an id " * 20), (None, None)], "doc_id long, text string")
    odd = odd.join(first.drop("doc_id", "text").limit(1), how="cross").select(*docs.columns)
    docs = docs.unionByName(first).unionByName(odd).unionByName(first.withColumn("text", F.concat(F.lit("another text under one id "), F.col("text"))))
    key = lambda r: tuple(map(str, r))
    before = Counter(map(key, docs.collect()))
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema, name
        rows = out.collect()
        left.append(len(rows))
        assert not Counter(map(key, rows)) - before, name  # rows as they were
        if name == "n-gram Jaccard join":
            texts = [r["text"] for r in rows if (r["text"] or "").strip()]
            given = docs.collect()
            assert sum(r["doc_id"] in (90001, 90002, 90003) or r["doc_id"] is None for r in rows) == sum(r["doc_id"] in (90001, 90002, 90003) or r["doc_id"] is None for r in given)
            assert len(texts) < len([r for r in given if (r["text"] or "").strip()])
        assert stage(spark, docs.limit(0), sf).count() == 0
        before = Counter(map(key, rows))
        docs = spark.createDataFrame(rows, docs.schema)
    files = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert left == sorted(left, reverse=True) and len(files) == left[-1]
    tokenizer, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    own = Counter((r["doc_id"], zlib.crc32(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in docs.collect())
    assert own == Counter((r["doc_id"], r["ids_crc32"]) for r in files)
    for r in sorted(files, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    whole = corpus_pipeline.run(spark, sf).collect()
    assert 0.3 * spark.read.parquet(f"{sf}/documents.parquet").count() < len(whole) <= left[-1] + 10


def test_queries_of_a_search_are_not_broadcast(spark):
    """They are repeated for every block: many times the size that Spark takes them for, all of it in the driver."""
    x = np.random.default_rng(2).standard_normal((400, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(frame, frame.filter("vec_id % 50 = 0"), block=50, query_block=4)
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert got.count() == 8 * 5
