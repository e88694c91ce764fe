"""Queries over documents of a snapshot: manifests, references, blocks, pages and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import documents, snapshot

from .registry import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named() -> Column:
    """Conversation messages as paths of a snapshot."""
    nth = F.col("conv_id") % 5
    number = F.col("turn").cast("string")
    return (
        F.when(nth == 0, F.concat(F.lit("messages/chunks/"), number))
        .when(nth == 1, F.concat(F.lit("messages/pages/"), number))
        .when(nth == 2, F.when(F.col("turn") == 0, "metadata.json").when(F.col("turn") == 1, "errors.json").otherwise(F.concat(F.lit("x"), number)))
        .when(nth == 3, F.concat(F.lit("messages/summaries/"), number))
        .otherwise(F.when(F.col("turn") == 0, "dashboard.json").otherwise(F.concat(F.lit("files/"), number)))
    )


NAMED = """
CASE conv_id % 5 WHEN 0 THEN 'messages/chunks/' || turn WHEN 1 THEN 'messages/pages/' || turn
  WHEN 2 THEN CASE turn WHEN 0 THEN 'metadata.json' WHEN 1 THEN 'errors.json' ELSE 'x' || turn END WHEN 3 THEN 'messages/summaries/' || turn
  ELSE CASE turn WHEN 0 THEN 'dashboard.json' ELSE 'files/' || turn END END
"""


@query("write_rank", f"""
SELECT conv_id, turn, CASE WHEN path LIKE 'messages/chunks/%' THEN 0 WHEN path LIKE 'messages/pages/%' THEN 1 WHEN path LIKE 'messages/summaries/%' THEN 2
  WHEN path = 'errors.json' THEN 4 WHEN path = 'dashboard.json' THEN 8 WHEN path = 'metadata.json' THEN 10 ELSE 9 END AS place FROM (SELECT *, {NAMED} AS path FROM conversations)
""")
def write_rank(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("path", named())
    return rows.select("conv_id", "turn", documents.write_rank(F.col("path")).alias("place")).orderBy("place", "conv_id", "turn")


@query("snapshot_manifest", f"""
WITH d AS (SELECT conv_id, {NAMED} AS path, text FROM conversations)
SELECT conv_id, string_agg(path || '|' || octet_length(encode(text)) || '|' || sha256(text), ',' ORDER BY path) AS entries, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes
FROM d WHERE path <> 'metadata.json' GROUP BY conv_id
""")
def snapshot_manifest(spark, sf_dir):
    found = documents.manifest(read(spark, sf_dir, "conversations").withColumn("path", named()), ["conv_id"], "path", "text")
    return found.withColumn("entries", F.array_join(F.transform("entries", lambda e: F.concat_ws("|", e["path"], e["bytes"].cast("string"), e["sha256"])), ","))


@query("valid_manifests", """
WITH g AS (SELECT l_orderkey, list(l_partkey::VARCHAR ORDER BY l_partkey) AS paths, bool_or(l_returnflag = 'R') AS upper, count(*) AS n, count(DISTINCT l_partkey) AS d FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, NOT upper AND n = d AND list_sort(paths) = paths AS valid FROM g
""")
def valid_manifests(spark, sf_dir):
    """Items as paths in order of their number, hashes in upper case where one was returned."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda p: p.cast("string")).alias("paths"), F.bool_or(F.col("l_returnflag") == "R").alias("upper"))
    hashes = F.transform("paths", lambda p: F.when(F.col("upper"), F.upper(F.sha2(p, 256))).otherwise(F.sha2(p, 256)))
    return rows.select("l_orderkey", documents.valid_manifest(F.col("paths"), hashes).alias("valid"))


@query("message_references", """
WITH r AS (SELECT DISTINCT o_custkey, o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o.o_custkey, o.o_orderkey, coalesce(string_agg(DISTINCT r.l_partkey::VARCHAR, ',' ORDER BY r.l_partkey::VARCHAR), '') AS referenced
FROM orders o LEFT JOIN r ON r.o_custkey = o.o_custkey AND r.o_orderkey = o.o_orderkey GROUP BY o.o_custkey, o.o_orderkey
""")
def message_references(spark, sf_dir):
    """Orders as messages, parts as files; a part names all of its customer's orders that have it."""
    messages = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    items = messages.join(read(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    references = items.groupBy("o_custkey", "l_partkey").agg(F.collect_set("o_orderkey").alias("sources"))
    found = documents.with_references(messages, references.withColumn("path", F.col("l_partkey").cast("string")), ["o_custkey"], "o_orderkey", "sources", "path")
    return found.withColumn("referenced", F.array_join("referenced", ","))


@query("own_mentions", "SELECT conv_id, turn, count(*) AS mentions FROM conversations GROUP BY ALL")
def own_mentions(spark, sf_dir):
    """Each message with its mentions among all of its conversation's."""
    rows = read(spark, sf_dir, "conversations")
    found = documents.own_mentions(rows.select("conv_id", "turn").distinct(), rows.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return found.select("conv_id", "turn", F.size("mentions").cast("long").alias("mentions"))


@query("mention_places", """
WITH m AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS place FROM conversations)
SELECT conv_id, turn, word, count(*) AS mentions, string_agg(place::VARCHAR, ',' ORDER BY place) AS places FROM m GROUP BY ALL
""")
def mention_places(spark, sf_dir):
    """Words as references: where each message has each of its words."""
    words = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("place", "word"))
    key = ["conv_id", "turn", "word"]
    found = documents.own_mentions(words.select(*key).distinct(), words, key)
    places = F.array_join(F.transform("mentions", lambda m: m["place"].cast("string")), ",")
    return found.select(*key, F.size("mentions").cast("long").alias("mentions"), places.alias("places"))


@query("turn_documents", """
WITH t AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS first, max(turn) FILTER (WHERE role = 'assistant') AS last, min(turn) FILTER (WHERE role = 'system') AS start FROM conversations GROUP BY conv_id)
SELECT t.conv_id, u.text AS request, a.text AS reply FROM t JOIN conversations u ON u.conv_id = t.conv_id AND u.turn = t.first LEFT JOIN conversations a ON a.conv_id = t.conv_id AND a.turn = t.last WHERE t.start IS NOT NULL
""")
def turn_documents(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    kind = F.col("role")
    found = rows.groupBy("conv_id").agg(F.max(F.when(kind == "user", F.col("turn"))).alias("first"), F.max(F.when(kind == "assistant", F.col("turn"))).alias("last"), F.min(F.when(kind == "system", F.col("turn"))).alias("start"))
    return documents.turn_documents(found, rows, ["conv_id"], "turn", "text", "first", "last", "start").select("conv_id", "request", "reply")


@query("first_warnings", """
SELECT 'warning_' || sha256(user_id || chr(0) || event_type) AS warning_id, min(event_id) AS event_id FROM events GROUP BY user_id, event_type
""")
def first_warnings(spark, sf_dir):
    return documents.first_warnings(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("warning_id", "event_id")


@query("number_mentions", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL)
SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM f
""")
def number_mentions(spark, sf_dir):
    return documents.number_mentions(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", "event_type", "event_id", "ordinal")


@query("distinct_paths", """
WITH c AS (SELECT user_id, event_id, CASE WHEN value::BIGINT % 2 = 0 THEN upper(event_type) ELSE event_type END AS path FROM events)
SELECT user_id, arg_min(path, event_id) AS path FROM c GROUP BY user_id, lower(path)
""")
def distinct_paths(spark, sf_dir):
    path = F.when(F.rint("value").cast("long") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return documents.distinct_paths(read(spark, sf_dir, "events").withColumn("path", path), ["user_id"], "path", "event_id").select("user_id", "path")


@query("storage_mode", """
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN lang = 'de' THEN 'preview_only' WHEN length(text) <= 1000 THEN 'inline' WHEN source IS NOT NULL THEN 'message_reference' ELSE 'preview_only' END AS mode FROM documents
""")
def storage_mode(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", documents.storage_mode(F.col("text"), F.coalesce(F.col("lang") != "de", F.lit(True)), F.col("source"), 1000).alias("mode"))


@query("visible_messages", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant')")
def visible_messages(spark, sf_dir):
    kind = snapshot.message_category(F.col("role"), F.lit(None).cast("string"))
    return read(spark, sf_dir, "conversations").where(documents.visible(F.col("role"), kind)).select("conv_id", "turn")


@query("last_pages", """
WITH p AS (SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 + 1)::INT AS page FROM conversations)
SELECT conv_id, turn, page FROM p QUALIFY page > max(page) OVER (PARTITION BY conv_id) - 2
""")
def last_pages(spark, sf_dir):
    paged = snapshot.page_by_count(read(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], 2)
    return documents.last_pages(paged, ["conv_id"], "page", F.lit(2)).select("conv_id", "turn", "page")


@query("message_filter", "SELECT 'chat' AS wanted, count(*) AS n FROM conversations WHERE role NOT IN ('system', 'developer', 'tool') UNION ALL SELECT 'all', count(*) FROM conversations")
def message_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("category", snapshot.message_category(F.col("role"), F.lit(None).cast("string")))
    counts = [documents.of_category(rows, "category", w).agg(F.lit(w).alias("wanted"), F.count("*").alias("n")) for w in ("chat", "all")]
    return counts[0].unionAll(counts[1])


@query("newest_first", "SELECT event_id, user_id FROM events")
def newest_first(spark, sf_dir):
    return documents.newest_first(read(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "user_id")


@query("merged_streams", "SELECT ts, event_id FROM events WHERE event_type IN ('view', 'click')")
def merged_streams(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    streams = [rows.where(F.col("event_type") == t).drop("event_type") for t in ("view", "click")]
    return documents.merged_streams(*streams, at="ts", ident="event_id")


@query("health", """
SELECT CASE WHEN count(*) FILTER (WHERE s_acctbal < 0 OR s_acctbal * 1000 < 500000) > 0 THEN 'degraded' ELSE 'ok' END AS status, count(*) AS services,
       coalesce(string_agg(DISTINCT s_name, ',' ORDER BY s_name) FILTER (WHERE s_acctbal < 0 OR s_acctbal * 1000 < 500000), '') AS at_fault FROM supplier
""")
def health(spark, sf_dir):
    found = documents.health(read(spark, sf_dir, "supplier"), "s_name", F.col("s_acctbal") >= 0, F.col("s_acctbal") * 1000, 500_000)
    return found.withColumn("at_fault", F.array_join("at_fault", ","))


@query("unchecked_task", """
SELECT user_id, arg_min('do ' || event_id, event_id) AS task FROM events WHERE event_type = 'view' GROUP BY user_id
""")
def unchecked_task(spark, sf_dir):
    """Views are open items of their user's list, all else is ticked or plain text."""
    ident = F.col("event_id").cast("string")
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("  - [ ] do "), ident, F.lit("  "))).when(F.col("event_type") == "click", F.concat(F.lit("- [x] done "), ident)).otherwise("text [ ] only")
    return documents.unchecked_task(read(spark, sf_dir, "events").withColumn("line", line), ["user_id"], "event_id", "line")


@query("within_roots", """
WITH r AS (SELECT n_nationkey, '/R' || n_regionkey || '/' || n_name AS root FROM nation WHERE n_regionkey < 3 UNION ALL SELECT NULL, '/r4'),
c AS (SELECT c_mktsegment, c_custkey, '/r' || n_regionkey || '/' || lower(n_name) || '/c' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_mktsegment, path, root FROM c JOIN r ON starts_with(path || '/', lower(root) || '/') QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey, length(root) DESC) = 1
""")
def within_roots(spark, sf_dir):
    nations = read(spark, sf_dir, "nation")
    roots = nations.where("n_regionkey < 3").select(F.concat(F.lit("/R"), "n_regionkey", F.lit("/"), "n_name").alias("root")).unionAll(nations.limit(1).select(F.lit("/r4").alias("root")))
    rows = read(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    paths = rows.select("c_mktsegment", "c_custkey", F.concat(F.lit("/r"), "n_regionkey", F.lit("/"), F.lower("n_name"), F.lit("/c"), "c_custkey").alias("path"))
    return documents.within_roots(paths, roots, ["c_mktsegment"], "path", "root", "c_custkey")


@query("evidence_hash", """SELECT event_id, sha256('{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '","none":null}') AS hash FROM events""")
def evidence_hash(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", documents.evidence_hash(F.col("event_id"), F.col("user_id"), F.col("event_type"), F.lit(None).cast("string").alias("none")).alias("hash"))


@query("content_blocks", """
WITH t AS (SELECT conv_id || '-' || turn AS id, text FROM conversations)
SELECT id, 1 AS position, 'text' AS kind, NULL::VARCHAR AS language, text || chr(10) AS body FROM t
UNION ALL SELECT id, 2, 'code', 'py', 'x = 1' || chr(10) FROM t UNION ALL SELECT id, 3, 'text', NULL, 'after' FROM t
""")
def content_blocks(spark, sf_dir):
    """Every message with a code block put in."""
    rows = read(spark, sf_dir, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat("text", F.lit("\n```py\nx = 1\n```\nafter")).alias("text"))
    return documents.content_blocks(rows, "id", "text").select("id", "position", "kind", "language", "body")


@query("completed_parts", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'text:a,status:failed,duration_seconds:1.5' ELSE 'text:a,status:succeeded' END AS parts, 12 AS length, 1 AS stderr FROM events
""")
def completed_parts(spark, sf_dir):
    """A tool's parts, its status replaced, with a duration for errors."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text"))
    parts = F.array(part("status", "started"), part("text", "a"))
    failed = F.col("event_type") == "error"
    done = documents.with_status(parts, F.when(failed, "failed").otherwise("succeeded"), F.when(failed, F.lit(1.5)))
    raw = F.array(part("stderr", "started"), part("text", "done!"))
    return read(spark, sf_dir, "events").select(
        "event_id", F.array_join(F.transform(done, lambda p: F.concat_ws(":", p["kind"], p["text"])), ",").alias("parts"), documents.text_length(raw).alias("length"), F.size(documents.parts_of_kind(raw, "stderr")).alias("stderr")
    )
