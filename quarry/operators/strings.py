"""Operators on strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registered import query
from ..sources.tables import table


@query("m25_last_number", "SELECT doc_id, regexp_extract_all(text, '[0-9]+')[-1] AS token, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INT) AS found FROM documents")
def last_number(spark, sf_dir):
    """The last run of digits in a text, and how many there are; null where there is none."""
    found = F.regexp_extract_all("text", F.lit("[0-9]+"), 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.try_element_at(found, F.lit(-1)).alias("token"), F.size(found).alias("found"))


@query("m21_path_class", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) AS section, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY ALL")
def path_class(spark, sf_dir):
    """Pages by host and first path segment."""
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").groupBy(part("^[a-z]+://([^/?#]*)").alias("host"), part("^[a-z]+://[^/]*/([^/?#]*)").alias("section")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))
