"""Queries over native identities, decisions with reasons, receipts and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import keys
from logloom.functions.storage import materialise
from logloom.operators import assemble, chunks, dedup, versions

from .registry import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("dedup_native", """
WITH e AS (SELECT *, CASE WHEN event_type = 'view' THEN NULL ELSE (floor(value)::BIGINT % 50)::VARCHAR END AS id, sha256(event_type || chr(0) || (event_id % 3)::VARCHAR) AS fp FROM events),
n AS (SELECT *, CASE WHEN id IS NULL THEN row_number() OVER (PARTITION BY user_id, fp, id IS NULL ORDER BY event_id) END AS occurrence FROM e),
i AS (SELECT *, CASE WHEN id IS NULL THEN sha256('fallback' || chr(0) || user_id || chr(0) || fp || chr(0) || occurrence)
                     ELSE sha256('native' || chr(0) || user_id || chr(0) || event_type || chr(0) || id) END AS identity FROM n)
SELECT event_id, identity, row_number() OVER w > 1 AS duplicate, fp <> first_value(fp) OVER w AS conflict FROM i WINDOW w AS (PARTITION BY identity ORDER BY event_id)
""")
def dedup_native(spark, sf_dir):
    """Ids repeat within a user and over event types; views have none."""
    rows = read(spark, sf_dir, "events").withColumn("id", F.when(F.col("event_type") != "view", (F.floor("value").cast("long") % 50).cast("string")))
    rows = rows.withColumn("fp", keys.digest(F.col("event_type"), F.col("event_id") % 3))
    return dedup.dedup_records(rows, "user_id", "id", "fp", ["event_id"], [F.col("event_id")], ("event_type",)).select("event_id", "identity", "duplicate", "conflict")


@query("decision_reasons", """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS reason, o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w OR lag(o_orderkey) OVER w IS NULL AS changed
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r AS (SELECT *, sum(changed::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM o),
g AS (SELECT *, last_value(reason IGNORE NULLS) OVER (PARTITION BY o_custkey, run ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS given FROM r),
v AS (SELECT *, sum((changed OR coalesce(lower(reason) <> lower(given), false))::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM g),
d AS (SELECT o_custkey, version, any_value(o_orderstatus) AS o_orderstatus, arg_min(reason, (o_orderdate, o_orderkey)) FILTER (WHERE reason IS NOT NULL) AS reason, count(*) AS n_sources,
             'decision_' || sha256(o_custkey::VARCHAR || chr(0) || arg_min(o_orderkey, (o_orderdate, o_orderkey))::VARCHAR) AS decision_id FROM v GROUP BY o_custkey, version)
SELECT o_custkey, version::BIGINT AS version, o_orderstatus, reason, n_sources, decision_id, lag(decision_id) OVER w AS supersedes, lead(decision_id) OVER w AS superseded_by
FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY version)
""")
def decision_reasons(spark, sf_dir):
    """A customer's orders decide its status; every third has no reason."""
    rows = read(spark, sf_dir, "orders").withColumn("reason", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")))
    out = versions.decision_versions(rows, "o_custkey", ["o_orderstatus"], "reason", ["o_orderdate", "o_orderkey"], "o_orderkey")
    return out.select("o_custkey", "version", "o_orderstatus", "reason", "n_sources", "decision_id", "supersedes", "superseded_by")


#: About as many receipts are made and read in one task.
RECEIPTS_A_TASK = 50_000


def _limbs(token: str, where: str = "true") -> str:
    return ", ".join(f"coalesce(sum(('0x' || substr({token}, {57 - 8 * k}, 8))::BIGINT) FILTER (WHERE {where}), 0)::HUGEINT AS {'o' if where != 'true' else 's'}{k}" for k in range(8))


def _carried(letter: str) -> str:
    """SQL for the sum modulo 2**256 of limbs, lowest first, as 64 digits."""
    low, carry = [], "0::HUGEINT"
    for k in range(8):
        low.insert(0, f"format('{{:08x}}', (({letter}{k} + {carry}) % 4294967296)::BIGINT)")
        carry = f"(({letter}{k} + {carry}) // 4294967296)"
    return " || ".join(low)


@query("receipt_groups", f"""
WITH m AS (SELECT *, md5(o_orderkey::VARCHAR) AS h, CASE WHEN o_orderkey % 4 = 0 THEN 'commits' ELSE 'deliveries' END AS kind FROM orders),
b AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN h ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END || '.json' AS name,
             '{{"workspace_id":"w' || o_custkey % 3 || '","snapshot_id":"' || o_orderpriority[1:1] || '","body_sha256":"' || sha256(h) || '"' || CASE WHEN kind = 'deliveries' THEN ',"relative_json_path":"a/' || o_orderkey || '.json"' ELSE '' END || '}}' AS body FROM m),
t AS (SELECT *, sha256('["' || name || '",' || strlen(body) || ',"' || sha256(body) || '"]') AS token, o_orderdate <= TIMESTAMP '1996-01-01' AS old FROM b WHERE o_orderkey % 11 <> 0),
s AS (SELECT kind, 'w' || o_custkey % 3 AS workspace, o_orderpriority[1:1] AS snapshot, count(*) AS n, sum(strlen(body))::BIGINT AS bytes, max(o_orderdate) AS latest, count(*) FILTER (WHERE old) AS old_n,
             coalesce(sum(strlen(body)) FILTER (WHERE old), 0)::BIGINT AS old_bytes, {_limbs("token")}, {_limbs("token", "old")} FROM t GROUP BY ALL)
SELECT kind, workspace, snapshot, n, bytes, {_carried("s")} AS fingerprint, latest, old_n, old_bytes, {_carried("o")} AS old_fingerprint FROM s
""")
def receipt_groups(spark, sf_dir):
    """One receipt an order; every eleventh has a bad name. Orders are stored in some 20 bytes, so they
    are dealt out by number before they become receipts."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    rows = orders.repartition(orders.count() // RECEIPTS_A_TASK + 1, "o_orderkey").withColumn("h", F.md5(F.col("o_orderkey").cast("string"))).withColumn("kind", F.when(F.col("o_orderkey") % 4 == 0, "commits").otherwise("deliveries"))
    dashed = F.concat_ws("-", *(F.substring("h", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    name = F.concat(F.when(F.col("o_orderkey") % 11 == 0, F.col("h")).otherwise(dashed), F.lit(".json"))
    path = F.when(F.col("kind") == "deliveries", F.concat(F.lit(',"relative_json_path":"a/'), F.col("o_orderkey").cast("string"), F.lit('.json"'))).otherwise("")
    body = F.concat(F.lit('{"workspace_id":"w'), (F.col("o_custkey") % 3).cast("string"), F.lit('","snapshot_id":"'), F.substring("o_orderpriority", 1, 1), F.lit('","body_sha256":"'), F.sha2("h", 256), F.lit('"'), path, F.lit("}"))
    rows = rows.withColumn("name", name).withColumn("body", body)
    return versions.receipt_groups(rows, "kind", "name", "body", "o_orderdate", F.lit("1996-01-01").cast("timestamp"))


@query("message_chunks", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, true AS fits, true AS whole FROM documents")
def message_chunks(spark, sf_dir):
    """Every document as a message of one block, cut into chunks of 4,096 bytes and joined again."""
    block = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("language"), F.col("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array(block).alias("blocks"), keys.safe_filename(F.col("doc_id").cast("string")).alias("stem"))
    made = chunks.chunked_messages(rows, "doc_id", "blocks", {"workspace_id": "w", "snapshot_id": "s", "generated_at": "2026-01-01T00:00:00Z"}, "stem", 4096)
    text = F.array_join(F.from_json("body", "content struct<blocks:array<struct<text:string>>>")["content"]["blocks"]["text"], "")
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("part", text.alias("text"))))["text"], "")  # of one document
    return made.groupBy("doc_id").agg(F.sha2(joined, 256).alias("text_sha256"), F.bool_and(F.col("bytes") <= 4096).alias("fits"), (F.count("*") == F.max("parts")).alias("whole"))


@query("snapshot_build", "SELECT conv_id, turn AS sequence, 'm' || turn AS message_id, sha256(coalesce(text, '')) AS text_sha256, 0 AS faults FROM conversations")
def snapshot_build(spark, sf_dir):
    """A snapshot of every conversation, with chunks for messages of over 1,500 bytes, read back with
    the number of links that don't hold. Documents are stored before they are listed, checked and
    read, as made again for each they cost as often; storing bounds what goes to Python at once."""
    rows = read(spark, sf_dir, "conversations")
    block = F.struct(F.lit("text").alias("kind"), F.lit(None).cast("string").alias("language"), F.col("text"))
    messages = rows.select("conv_id", F.concat(F.lit("m"), F.col("turn").cast("string")).alias("message_id"), F.col("turn").alias("sequence"), "role", F.array(block).alias("blocks"))
    summaries = rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("sequence"), keys.preview(F.col("text"), 80).alias("summary"))
    built = materialise(assemble.build_snapshot(messages, summaries, {}, ["conv_id"], most_chunk=1500), "snapshot")
    documents = materialise(assemble.with_manifest(built, ["conv_id"]), "snapshot-listed")
    faults = assemble.snapshot_faults(documents, ["conv_id"]).groupBy("conv_id").agg(F.count("*").cast("int").alias("_n"))
    found = assemble.read_messages(documents, ["conv_id"]).join(faults, "conv_id", "left")
    return found.select("conv_id", "sequence", "message_id", F.sha2("text", 256).alias("text_sha256"), F.coalesce("_n", F.lit(0)).alias("faults"))
