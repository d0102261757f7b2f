"""From raw documents to token files: filter, deduplicate, decontaminate, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, mixing, quality, repair
from quarry.llm.common import beside, is_train, materialize
from quarry.llm.queries import table, tokenizer_path

#: Expected share of the words that reach the mix.
MIX_SHARE = 0.8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and their labels, does not reject. Null texts count as empty."""
    fit = lambda d: quality.score(d, table(spark, sf_dir, "labels"), is_train(F.col("doc_id"), 5)).filter("predicted = 1")
    return beside(docs, ("score", "predicted"), fit)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the rows with its smallest doc_id; of those that repeat that doc_id, one for each
    distinct text, the least one by its other columns. Rows without a doc_id or without words are no near duplicate of anything, and all stay."""
    classes = jaccard.near_duplicates(docs)
    kept = classes.filter("n_shingles > 0 AND doc_id = component_id").select("doc_id").distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col("doc_id").isNotNull()
    firsts, others = docs.filter(worded).join(kept, "doc_id", "left_semi"), F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])
    firsts = firsts.groupBy("doc_id", "text").agg(F.min_by(others, F.to_json(others)).alias("others")).select("doc_id", "text", "others.*")
    return firsts.select(*docs.columns).unionByName(docs.filter(~worded))


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, or little of one; null texts are clean."""
    mark = lambda d: decontaminate.decontaminate(d, table(spark, sf_dir, "benchmark"), keep=True).filter("NOT contaminated")
    return beside(docs, decontaminate.MARKS, mark)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities that bring sources, languages and topics to their target shares; those without
    words go. Null languages and sources count as ''."""
    return beside(docs, mixing.OWN, lambda d: mixing.sample(d, MIX_SHARE).filter("selected"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, as read back: doc_id, start, n_tokens, ids_crc32. Null texts have the end id alone."""
    return repair.read(spark, repair.write(docs, tokenizer_path())).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("benchmark decontamination", decontamination_filter),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_files),
]

#: Learning and drawing are not SQL: the stages are tested one by one and together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
