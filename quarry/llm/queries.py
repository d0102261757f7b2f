"""One query for each numbered corpus operator, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, chunking, decontaminate, edits, jaccard, lm, mixing, quality, ranked, repair, transducer, warc
from .common import is_train


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), is_train(F.col("doc_id"), 5))
    return scored.select("doc_id", (~is_train(F.col("doc_id"), 5)).alias("held_out"), "score", "predicted")


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder, index = warc.write(pages)
    return warc.read(warc.look_up(pages, index), folder).drop("payload", "url")


def op4_mix_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents")).select("doc_id", "m_source", "m_lang", "m_topic", "m_tokens", "p", "selected")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("train", is_train(F.col("doc_id"), 10))
    scored = lm.score(docs, "train")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.write(table(spark, sf_dir, "documents"), tokenizer_path())
    return repair.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_cdc_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.repeated_passages(table(spark, sf_dir, "documents"))


def edit_script(docs: DataFrame) -> DataFrame:
    """Three edits for every document, at places that a hash of its id names: an insertion, a deletion, a replacement."""
    place = lambda k: (F.crc32(F.encode(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(k)), "UTF-8")) % F.greatest(F.octet_length("text"), F.lit(1))).cast("long")
    one = lambda seq, start, size, new: F.struct(F.lit(seq).alias("seq"), start.alias("start"), (start + size).alias("end"), F.lit(new).alias("new"))
    script = F.array(one(1, place("a"), 0, " an added sentence, with 3 numbers: 12, 345 and 6."), one(2, place("b"), 40, ""), one(3, place("c"), 12, "re\u00e9dited"))
    return docs.filter("text IS NOT NULL").select("doc_id", F.explode(script).alias("e")).select("doc_id", "e.*")


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return edits.count_edits(docs, edit_script(docs), tokenizer_path())


def op11_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(spark, ranked.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OPERATORS = (
    op1_collision_ann, op2_quality_pu, op3_warc_index, op4_mix_ipf, op5_lm_scoring, op6_token_ids, op7_cdc_passages, op8_decontamination,
    op9_edit_counts, op10_ngram_jaccard, op11_bucket_search, op12_bpe_transducer, op13_filter_audit,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

#: SQL for the same rows, where it can say them.
ORACLES: dict[str, str] = {
    "op3_warc_index": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS keep FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to FROM k""",
    "op8_decontamination": r"""WITH low AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
item AS (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k, least(len(w), 13) AS n FROM w WHERE kind = 'b' AND len(w) > 0),
win AS (SELECT DISTINCT id AS item, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS s FROM item),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w WHERE kind = 'd'),
cut AS (SELECT doc_id, k, n, list_aggregate(w[k:k + n - 1], 'string_agg', ' ') AS s FROM pos, (SELECT DISTINCT n FROM win) WHERE k + n - 1 <= len(w)),
occ AS (SELECT doc_id, k, cut.n, item FROM cut JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id),
a AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256 FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id) WHERE kind = 'd')
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM a""",
    "op10_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[k:k + 4], 'string_agg', ' ') AS s, least(len(w), 5) AS z FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.z = b.z AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT b, m FROM r JOIN both_ ON r.doc_id = a WHERE m < b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, x.n_equal FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) l USING (doc_id)
JOIN (SELECT doc_id, count(*) OVER (PARTITION BY k) AS n_equal FROM (SELECT w.doc_id, coalesce(list_aggregate(list_sort(list(s.s || '|' || s.z) FILTER (s.s IS NOT NULL)), 'string_agg', chr(10)), 'none ' || w.doc_id) AS k FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id)) x USING (doc_id)""",
    "op11_bucket_search": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
z AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM z),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, docs),
r AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN p USING (t) JOIN z USING (doc_id), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 20""",
    "op13_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
f AS (SELECT part, doc_id, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END ||
CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END ||
CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS m FROM d),
c AS (SELECT part, m, count(*) AS n, sum(coalesce(q, 0)) AS good, sum(coalesce(x, 0)) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v), o AS (SELECT a.v || b.v || c.v || d.v || e.v AS o FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT part, o, k, m, n, good, bad, substr(o, k, 1) AS i, translate(m, substr(o, 1, k - 1), '') <> m AS gone FROM c, o, unnest([1, 2, 3, 4, 5]) AS u(k)),
g AS (SELECT part, o AS filter_order, k AS step, i, sum(CASE WHEN gone OR contains(m, i) THEN 0 ELSE n END) AS kept, sum(CASE WHEN NOT gone AND contains(m, i) THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND contains(m, i) THEN n ELSE 0 END) AS redundant,
sum(CASE WHEN m = i THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND contains(m, i) THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND contains(m, i) THEN bad ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM g""",
}
