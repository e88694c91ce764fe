"""Queries over conversations: timeline, previews, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import keys
from logloom.operators import dedup, snapshot

from .registry import query


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@query("timeline_sequence", """
SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS sequence FROM conversations
""")
def timeline_sequence(spark, sf_dir):
    return dedup.number_occurrences(conversations(spark, sf_dir), ["conv_id"], [F.col("turn")], "sequence").select("conv_id", "turn", "role", "sequence")


@query("turn_first_user_last_reply", """
SELECT conv_id, count(*) AS n_messages, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user,
       arg_max(substr(text, 1, 500), turn) FILTER (WHERE role = 'assistant') AS last_reply
FROM conversations GROUP BY conv_id
""")
def turn_first_user_last_reply(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    return rows.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.min_by("text", F.when(user, F.col("turn"))).alias("first_user"),
        F.max_by(keys.preview(F.col("text")), F.when(reply, F.col("turn"))).alias("last_reply"),
    )


@query("turn_reply_ids", """
SELECT conv_id, array_to_string(list(conv_id || '-' || turn ORDER BY turn), ',') AS reply_ids FROM conversations WHERE role = 'assistant' GROUP BY conv_id
""")
def turn_reply_ids(spark, sf_dir):
    rows = conversations(spark, sf_dir).where("role = 'assistant'")
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["id"]), ",").alias("reply_ids"))


@query("recent_two_turns", """
SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2
""")
def recent_two_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations(spark, sf_dir).withColumn("nth", F.row_number().over(w)).where("nth <= 2").select("conv_id", "turn", "role")


@query("previous_reply_context", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reply_turn
FROM conversations
""")
def previous_reply_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    reply = F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(w)
    return conversations(spark, sf_dir).select("conv_id", "turn", reply.alias("reply_turn"))


@query("display_mode_counts", """
SELECT role, CASE WHEN role IN ('developer', 'system', 'tool') OR length(text) >= 1000 THEN 'collapsed' ELSE 'expanded' END AS display_mode, count(*) AS n
FROM conversations GROUP BY ALL
""")
def display_mode_counts(spark, sf_dir):
    mode = snapshot.display_mode(F.col("role"), F.lit(None).cast("string"), F.length("text"))
    return conversations(spark, sf_dir).groupBy("role", mode.alias("display_mode")).agg(F.count("*").alias("n"))


@query("message_category", """
SELECT conv_id, turn, CASE WHEN role IN ('developer', 'system') THEN 'internal' WHEN role = 'tool' THEN 'tool' ELSE 'chat' END AS category FROM conversations
""")
def message_category(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", snapshot.message_category(F.col("role"), F.lit(None).cast("string")).alias("category"))


@query("message_priority_order", """
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn))::INT AS place FROM conversations
""")
def message_priority_order(spark, sf_dir):
    rank = F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2)
    return dedup.number_occurrences(conversations(spark, sf_dir), ["conv_id"], [rank, F.col("turn")], "place").select("conv_id", "turn", "place")


@query("message_ids", """
SELECT conv_id, turn, 'msg_' || sha256(conv_id::VARCHAR || chr(0) || turn::VARCHAR || chr(0) || coalesce(text, '')) AS message_id FROM conversations
""")
def message_ids(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", keys.prefixed_id("msg", F.col("conv_id"), F.col("turn"), F.col("text")).alias("message_id"))


@query("page_pack_count", """
SELECT conv_id, turn, (floor((row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) / 100) + 1)::INT AS page FROM conversations
""")
def page_pack_count(spark, sf_dir):
    return snapshot.page_by_count(conversations(spark, sf_dir), ["role"], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn", "page")


@query("page_pack_bytes", """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations
), f AS (
  SELECT conv_id, turn, rn, 1 AS page, 1 AS items, size AS bytes FROM m WHERE rn = 1
  UNION ALL
  SELECT m.conv_id, m.turn, m.rn,
         CASE WHEN f.items < 3 AND f.bytes + m.size <= 2000 THEN f.page ELSE f.page + 1 END,
         CASE WHEN f.items < 3 AND f.bytes + m.size <= 2000 THEN f.items + 1 ELSE 1 END,
         CASE WHEN f.items < 3 AND f.bytes + m.size <= 2000 THEN f.bytes + m.size ELSE m.size END
  FROM f JOIN m ON m.conv_id = f.conv_id AND m.rn = f.rn + 1
)
SELECT conv_id, turn, page FROM f
""")
def page_pack_bytes(spark, sf_dir):
    rows = conversations(spark, sf_dir).withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))))
    return snapshot.page_by_bytes(rows, ["conv_id"], "turn", "size", 3, 2000)


@query("page_manifest", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence FROM conversations),
q AS (SELECT *, (floor((sequence - 1) / 5) + 1)::INT AS page FROM p)
SELECT conv_id, page, min(sequence)::INT AS first_sequence, max(sequence)::INT AS last_sequence, count(*) AS items,
       sum(octet_length(encode(text)))::BIGINT AS bytes, sha256(string_agg(text, chr(10) ORDER BY sequence)) AS sha256
FROM q GROUP BY conv_id, page
""")
def page_manifest(spark, sf_dir):
    paged = snapshot.page_by_count(conversations(spark, sf_dir), ["conv_id"], [F.col("turn")], 5)
    return snapshot.page_manifest(paged, ["conv_id"], "sequence", F.col("text"))


@query("explicit_next_task", """
SELECT conv_id, turn, regexp_extract(text, '(?i)\\b(next|then|finally)\\b[^.]*', 0) AS phrase FROM conversations WHERE regexp_matches(text, '(?i)\\b(next|then|finally)\\b')
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
""")
def explicit_next_task(spark, sf_dir):
    """The newest message of each conversation that names a next step."""
    pattern = r"(?i)\b(next|then|finally)\b"
    rows = conversations(spark, sf_dir).where(F.col("text").rlike(pattern))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("conv_id", "turn", F.regexp_extract("text", pattern + "[^.]*", 0).alias("phrase"))
