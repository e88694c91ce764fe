"""Queries over file references in messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import files

from .registry import query

#: Messages made of events, as SQL: links, code, plain paths and an address, with line numbers, a
#: path out of the workspace, and folders spelled in two ways.
TEXT = """
    'See [m](src/' || event_type || '/part' || (event_id % 7)::VARCHAR || '.py:' || (event_id % 5 + 1)::VARCHAR || ') and `lib/' || event_type || '.csv`, not http://e.org/x.py; also ../out/secret'
    || (event_id % 3)::VARCHAR || '.txt. Open ' || CASE WHEN event_id % 2 = 0 THEN 'Docs' ELSE 'docs' END || '/guide' || (event_id % 7)::VARCHAR || '.md and again docs/guide' || (event_id % 7)::VARCHAR || '.md'
"""

#: About as many texts are searched in one task, and as many external mentions sorted.
TEXTS_A_TASK, SORTED_A_TASK = 20_000, 200_000


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions in the texts of all events; a part of the guides and the sheets are known to be there.
    Events are stored in some 22 bytes, so that one split has millions: they are dealt out before
    they become texts, by number, as bytes tell too little of the work."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    dealt = events.select("event_id", "event_type").repartition(events.count() // TEXTS_A_TASK + 1, "event_id")
    text = F.expr(TEXT.replace("::VARCHAR", "::STRING"))
    guides = events.where("event_id % 7 < 3").select(F.concat(F.lit("docs/Guide"), F.col("event_id") % 7, F.lit(".md")).alias("path"), F.lit("file").alias("kind"))
    sheets = events.select(F.concat(F.lit("lib/"), "event_type", F.lit(".csv")).alias("path"), F.lit("directory").alias("kind"))
    return files.file_mentions(dealt.withColumn("text", text), "text", "event_id", "C:\\work", guides.union(sheets))


# What the messages name, rebuilt from the columns they were made of.
NAMED = """
WITH m AS (
    SELECT event_id, 0 AS place, 'src/' || event_type || '/part' || (event_id % 7)::VARCHAR || '.py' AS path, 'missing' AS kind FROM events
    UNION ALL SELECT event_id, 1, 'lib/' || event_type || '.csv', 'directory' FROM events
    UNION ALL SELECT event_id, 3, CASE WHEN event_id % 2 = 0 THEN 'Docs' ELSE 'docs' END || '/guide' || (event_id % 7)::VARCHAR || '.md', CASE WHEN event_id % 7 < 3 THEN 'file' ELSE 'missing' END FROM events
),
r AS (SELECT arg_min(path, (event_id, place)) AS path, any_value(kind) AS kind, count(*) AS n FROM m GROUP BY lower(path))
"""


@query("file_references", NAMED + """
SELECT 'file_ref_' || sha256('w1' || chr(0) || 'workspace' || chr(0) || path) AS reference_id, path, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '[^.]*$') AS extension, kind, n AS mentions, n AS messages FROM r
""")
def file_references(spark, sf_dir):
    """A path is spelled as its first message does; the same path twice in a message counts once."""
    return files.file_references(mentions(spark, sf_dir), "event_id", F.lit("w1"))


@query("external_files", """
SELECT 'file_ref_' || sha256('w1' || chr(0) || 'external' || chr(0) || event_id::VARCHAR || chr(0) || '1' || chr(0) || 'secret' || (event_id % 3)::VARCHAR || '.txt') AS reference_id,
       event_id, 1 AS ordinal, 'secret' || (event_id % 3)::VARCHAR || '.txt' AS name, 'txt' AS extension FROM events
""")
def external_files(spark, sf_dir):
    """Of what lies outside of the workspace the name alone is kept."""
    parts = spark.read.parquet(f"{sf_dir}/events.parquet").count() // SORTED_A_TASK + 1  # one a message
    return files.external_files(mentions(spark, sf_dir), "event_id", F.lit("w1"), parts)


@query("file_mention_ids", NAMED + """,
all_of AS (SELECT m.event_id, m.place, m.path, CASE place WHEN 0 THEN 'markdown_link' WHEN 1 THEN 'inline_code' ELSE 'plain_text' END AS written, CASE WHEN place = 0 THEN (event_id % 5 + 1)::INT END AS line FROM m
           UNION ALL SELECT event_id, 4, 'docs/guide' || (event_id % 7)::VARCHAR || '.md', 'plain_text', NULL FROM events)
SELECT event_id, place, a.path, written, line, 'file_ref_' || sha256('w1' || chr(0) || 'workspace' || chr(0) || r.path) AS reference_id FROM all_of a JOIN r ON lower(a.path) = lower(r.path)
""")
def file_mention_ids(spark, sf_dir):
    """Every mention with the id of its file."""
    found = mentions(spark, sf_dir)
    rows = files.reference_ids(found, files.file_references(found, "event_id", F.lit("w1")))
    return rows.select("event_id", "place", "path", "written", "line", "reference_id")
