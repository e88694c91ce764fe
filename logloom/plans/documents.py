"""Queries over documents and pages: dedup, redaction, text rules, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import keys, redaction
from logloom.operators import dedup, versions

from .registry import query


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("content_preview", """
SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 499) || '…' ELSE text END AS cut, substr(text, 1, 500) AS preview FROM documents
""")
def content_preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", keys.limit_text(F.col("text"), 500).alias("cut"), keys.preview(F.col("text")).alias("preview"))


@query("dedup_occurrence", """
WITH n AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS fp, row_number() OVER (PARTITION BY source, sha256(coalesce(text, '')) ORDER BY doc_id) AS occurrence FROM documents)
SELECT doc_id, sha256('fallback' || chr(0) || source || chr(0) || fp || chr(0) || occurrence) AS identity, false AS duplicate FROM n
""")
def dedup_occurrence(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("fp", keys.digest(F.col("text")))
    return dedup.dedup_records(rows, "source", None, "fp", ["doc_id"], [F.col("doc_id")]).select("doc_id", "identity", "duplicate")


@query("dedup_first_reference", """
SELECT doc_id, CASE WHEN row_number() OVER w > 1 THEN first_value(doc_id) OVER w END AS duplicate_of, CASE WHEN row_number() OVER w = 1 THEN count(*) OVER (PARTITION BY text) END AS occurrence_count
FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)
""")
def dedup_first_reference(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", keys.digest(F.col("text")).alias("fp"))
    return dedup.reference_repeats(rows, ["fp"], [F.col("doc_id")], "doc_id").select("doc_id", "duplicate_of", "occurrence_count")


@query("budget_cut", """
SELECT source, doc_id, sum(octet_length(encode(text))) OVER w::BIGINT AS spent FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)
QUALIFY spent <= 20000
""")
def budget_cut(spark, sf_dir):
    return versions.within_budget(documents(spark, sf_dir), ["source"], [F.col("doc_id")], F.octet_length("text"), 20000).select("source", "doc_id", "spent")


@query("call_budget", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def call_budget(spark, sf_dir):
    return dedup.number_occurrences(documents(spark, sf_dir), ["source"], [F.col("doc_id")], "nth").where("nth <= 3").select("source", "doc_id")


TOKEN = r"""(?i)(\b(?:access_|refresh_|auth_)?token\s*[=:]\s*[\"''])[^\"''\[\]\s]{6,}([\"''])"""


@query("redact_token", f"SELECT doc_id, md5(regexp_replace(text, '{TOKEN}', '\\1[REDACTED:TOKEN]\\2', 'g')) AS masked_md5 FROM documents")
def redact_token(spark, sf_dir):
    chosen = [d for d in redaction.DETECTORS if d.name == "sensitive_assignment"][:1]
    return documents(spark, sf_dir).select("doc_id", F.md5(redaction.redact(F.col("text"), chosen)).alias("masked_md5"))


@query("redaction_counts", f"""
SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS n FROM documents WHERE regexp_matches(text, '{TOKEN}')
""")
def redaction_counts(spark, sf_dir):
    chosen = [d for d in redaction.DETECTORS if d.name == "sensitive_assignment"][:1]
    found = documents(spark, sf_dir).select("doc_id", F.explode(redaction.redactions(F.col("text"), chosen)).alias("r"))
    return found.select("doc_id", F.col("r.n").cast("long").alias("n"))


@query("sentence_rules", """
WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?。！？])\\s*', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(regexp_replace(x, '^\\s*(?:[-*+]|\\d+[.)])\\s+', ''), E' \\t\\n\\r\\u000b\\u000c')), lambda x: x <> '')) AS sentence FROM documents)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(sentence, '(?i)\\b(the|and)\\b')) AS n_matching FROM s GROUP BY doc_id
""")
def sentence_rules(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", keys.sentences(F.col("text")).alias("s"))
    matching = F.filter("s", lambda x: x.rlike(r"(?i)\b(the|and)\b"))
    return rows.where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n"), F.size(matching).cast("long").alias("n_matching"))


@query("short_text_lexicon", """
SELECT doc_id FROM documents WHERE length(text) <= 120 AND regexp_matches(regexp_replace(lower(text), '[^a-z ]', '', 'g'), '^(ok|the|and|yes|no|of|in)')
""")
def short_text_lexicon(spark, sf_dir):
    bare = F.regexp_replace(F.lower("text"), "[^a-z ]", "")
    return documents(spark, sf_dir).where((F.length("text") <= 120) & bare.rlike("^(ok|the|and|yes|no|of|in)")).select("doc_id")


@query("workspace_ids", "SELECT DISTINCT source, substr(sha256(lower(source)), 1, 16) AS workspace_id FROM documents")
def workspace_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("source", keys.short_key(F.col("source")).alias("workspace_id")).distinct()


@query("filename_safety", """
SELECT page_id, CASE WHEN regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') = url AND length(url) <= 80 THEN url
  ELSE substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 63) || '_' || substr(sha256(url), 1, 16) END AS name FROM pages
""")
def filename_safety(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", keys.safe_filename(F.col("url")).alias("name"))
