"""Queries over events: lifecycle, errors, as-of joins, memo and retention groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import dedup, errors, joins, turns, versions

from .registry import query

#: Event types that stand for the start, completion and abort of a turn.
STARTS = {"signup": "start", "purchase": "complete", "error": "abort"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, meaning in STARTS.items():
        kind = F.when(F.col("event_type") == name, meaning).otherwise(kind)
    return events(spark, sf_dir).select("user_id", "event_id", "ts", kind.alias("kind"))


LIFECYCLE = """
WITH e AS (
  SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'abort' END AS kind
  FROM events WHERE event_type IN ('signup', 'purchase', 'error')
), n AS (
  SELECT *, sum((kind = 'start')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS number FROM e
), t AS (
  SELECT user_id, number, min(event_id) FILTER (WHERE kind = 'start') AS event_id, arg_min(kind, event_id) FILTER (WHERE kind <> 'start') AS end_kind,
         min(event_id) FILTER (WHERE kind <> 'start') AS end_id
  FROM n WHERE number > 0 GROUP BY user_id, number
), l AS (
  SELECT *, CASE WHEN end_kind = 'complete' THEN 'completed' WHEN end_kind = 'abort' THEN 'aborted'
                 WHEN number < max(number) OVER (PARTITION BY user_id) THEN 'incomplete' ELSE 'in_progress' END AS status FROM t
)
"""


@query("lifecycle_status", LIFECYCLE + """
SELECT user_id, event_id, number::BIGINT AS number, status, CASE WHEN status = 'incomplete' THEN 'superseded_by_new_turn' END AS reason, end_id FROM l
""")
def lifecycle_status(spark, sf_dir):
    found = turns.turn_lifecycle(turn_events(spark, sf_dir), "user_id", ["event_id"], "kind")
    return found.select("user_id", "event_id", "number", "status", "reason", F.col("end.event_id").alias("end_id"))


@query("ends_without_start", """
WITH e AS (
  SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before
  FROM events WHERE event_type IN ('signup', 'purchase', 'error')
)
SELECT user_id, event_id FROM e WHERE event_type <> 'signup' AND before IS DISTINCT FROM 'signup'
""")
def ends_without_start(spark, sf_dir):
    return turns.ends_without_start(turn_events(spark, sf_dir), "user_id", ["event_id"], "kind").select("user_id", "event_id")


@query("current_status", LIFECYCLE + """
SELECT user_id, CASE WHEN bool_or(status = 'in_progress') THEN 'working' ELSE 'idle' END AS status, max(number)::BIGINT AS latest FROM l GROUP BY user_id
""")
def current_status(spark, sf_dir):
    found = turns.turn_lifecycle(turn_events(spark, sf_dir), "user_id", ["event_id"], "kind")
    return turns.session_status(found, "user_id")


@query("recent_turns", LIFECYCLE + """
SELECT user_id, number::BIGINT AS number, status FROM l
QUALIFY row_number() OVER (PARTITION BY user_id, status = 'in_progress' ORDER BY number DESC) <= CASE WHEN status = 'in_progress' THEN 1 ELSE 2 END
""")
def recent_turns(spark, sf_dir):
    found = turns.turn_lifecycle(turn_events(spark, sf_dir), "user_id", ["event_id"], "kind")
    return turns.recent_turns(found, "user_id", "number").select("user_id", "number", "status")


@query("rollback_last_n", """
WITH e AS (
  SELECT user_id, event_id, (event_type = 'purchase')::INT AS push, CASE WHEN event_type = 'error' THEN 1 + (event_id % 2) ELSE 0 END AS pop FROM events
), s AS (
  SELECT *, sum(push - pop) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e
), h AS (
  SELECT *, run - least(0, min(run) OVER (PARTITION BY user_id ORDER BY event_id)) AS height FROM s
)
SELECT a.user_id, a.event_id, EXISTS (SELECT 1 FROM h b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND b.height < a.height) AS rolled_back
FROM h a WHERE a.push = 1
""")
def rollback_last_n(spark, sf_dir):
    """Purchases end turns; an error rolls back the last one or two."""
    rows = events(spark, sf_dir).withColumn("push", (F.col("event_type") == "purchase").cast("int"))
    rows = rows.withColumn("pop", F.when(F.col("event_type") == "error", 1 + F.col("event_id") % 2).otherwise(0))
    return turns.roll_back(rows, "user_id", ["event_id"], "push", "pop").where("push = 1").select("user_id", "event_id", "rolled_back")


@query("error_aggregate", """
SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE event_type = 'error' GROUP BY user_id
""")
def error_aggregate(spark, sf_dir):
    folded = errors.fold_errors(events(spark, sf_dir).where("event_type = 'error'"), ["user_id"], ["ts", "event_id"])
    return folded.select("user_id", "n", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), F.col("first.ts").alias("first_at"), F.col("last.ts").alias("last_at"))


RESOLVED = """
WITH r AS (
  SELECT e.user_id, e.event_id, e.value, (SELECT min(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id > e.event_id) AS resolved_by
  FROM events e WHERE e.event_type = 'error'
)
"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = errors.resolve_errors(events(spark, sf_dir), ["user_id"], ["event_id"], kind == "error", kind == "purchase")
    return rows.select("user_id", "event_id", "value", F.col("resolved_by.event_id").alias("resolved_by"))


@query("error_resolve", RESOLVED + "SELECT user_id, event_id, resolved_by, CASE WHEN resolved_by IS NULL THEN 'open' ELSE 'resolved' END AS status FROM r")
def error_resolve(spark, sf_dir):
    return resolved(spark, sf_dir).select("user_id", "event_id", "resolved_by", F.when(F.col("resolved_by").isNull(), "open").otherwise("resolved").alias("status"))


@query("error_counts", RESOLVED + """
SELECT user_id, count(*) FILTER (WHERE resolved_by IS NULL AND event_id % 5 <> 0) AS open, count(*) FILTER (WHERE resolved_by IS NOT NULL AND event_id % 5 <> 0) AS resolved,
       count(*) FILTER (WHERE event_id % 5 = 0) AS rolled_back, count(*) FILTER (WHERE resolved_by IS NULL AND event_id % 5 <> 0 AND value > 50) AS critical, count(*) AS total
FROM r GROUP BY user_id
""")
def error_counts(spark, sf_dir):
    rows = resolved(spark, sf_dir).select("user_id", F.when(F.col("resolved_by").isNull(), "open").otherwise("resolved").alias("status"), (F.col("event_id") % 5 == 0).alias("rolled_back"), F.when(F.col("value") > 50, "critical").otherwise("error").alias("severity"))
    return errors.error_counts(rows, ["user_id"])


@query("error_sections", RESOLVED + """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'rolled_back' WHEN resolved_by IS NULL THEN 'open' ELSE 'resolved' END AS section,
       CASE WHEN event_id % 5 = 0 THEN 3 WHEN resolved_by IS NULL THEN 1 ELSE 2 END::BIGINT AS section_rank FROM r
""")
def error_sections(spark, sf_dir):
    section = errors.error_section(F.when(F.col("resolved_by").isNull(), "open").otherwise("resolved"), F.col("event_id") % 5 == 0)
    return resolved(spark, sf_dir).select("event_id", section.alias("section"), errors.section_rank(section).cast("long").alias("section_rank"))


@query("latest_open", RESOLVED + "SELECT user_id, max(event_id) AS latest FROM r WHERE resolved_by IS NULL GROUP BY user_id")
def latest_open(spark, sf_dir):
    return resolved(spark, sf_dir).where("resolved_by is null").groupBy("user_id").agg(F.max_by("event_id", "event_id").alias("latest"))


@query("asof_attach", """
SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.event_id > v.event_id
""")
def asof_attach(spark, sf_dir):
    rows = events(spark, sf_dir)
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id")
    right = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return joins.attach_latest(left, right, ["user_id"], "event_id", "view_id", ["view_id", "view_value"])


@query("asof_unmatched", """
SELECT p.event_id, p.user_id FROM events p WHERE p.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'signup' AND v.user_id = p.user_id AND v.event_id < p.event_id)
""")
def asof_unmatched(spark, sf_dir):
    rows = events(spark, sf_dir)
    left = rows.where("event_type = 'purchase'").select("event_id", "user_id")
    right = rows.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"))
    return joins.attach_latest(left, right, ["user_id"], "event_id", "signup_id", ["signup_id"], "anti")


@query("multiset_except", """
WITH l AS (SELECT user_id, event_id, (value / 10)::INT AS v, row_number() OVER (PARTITION BY user_id, (value / 10)::INT ORDER BY event_id) AS nth FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, (value / 10)::INT AS v, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT l.event_id FROM l LEFT JOIN r ON l.user_id = r.user_id AND l.v = r.v WHERE nth > coalesce(n, 0)
""")
def multiset_except(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("v", F.rint(F.col("value") / 10).cast("int"))
    return dedup.multiset_except(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), ["user_id", "v"], [F.col("event_id")]).select("event_id")


@query("ordered_distinct_merge", """
WITH o AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS kinds FROM o GROUP BY user_id
""")
def ordered_distinct_merge(spark, sf_dir):
    first = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["event_type"])), ",").alias("kinds"))


@query("json_props", """
SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN (props->>'$.k')::BIGINT END AS k FROM events
""")
def json_props(spark, sf_dir):
    """An integer of a JSON object; other kinds of value, true among them, are null."""
    from logloom.functions.records import strict_long

    return events(spark, sf_dir).select("event_id", strict_long(F.try_parse_json("props"), "$.k").alias("k"))


@query("memo_cache_ttl", """
WITH last AS (SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
now AS (SELECT max(ts) AS now FROM events)
SELECT user_id, event_type, event_id FROM last, now WHERE event_type <> 'error' OR now < ts + INTERVAL 300 MINUTE
""")
def memo_cache_ttl(spark, sf_dir):
    """The last entry of each key; errors are negative entries and expire."""
    rows = events(spark, sf_dir)
    entries = rows.withColumn("expires_at", F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 300 MINUTE")))
    now = F.lit(rows.agg(F.max("ts")).first()[0])
    return versions.usable_entries(entries, ["user_id", "event_type"], "event_id", now).select("user_id", "event_type", "event_id")


@query("retention_groups", """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(value > 50)::BIGINT AS n_old, max(ts) AS last_at FROM events GROUP BY ALL
""")
def retention_groups(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("long")).alias("n_old"), F.max("ts").alias("last_at"))


@query("run_metrics", """
SELECT event_type, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN octet_length(encode(props)) ELSE 0 END)::BIGINT AS input_bytes FROM events GROUP BY event_type
""")
def run_metrics(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "purchase", F.octet_length("props")).otherwise(0)).cast("long").alias("input_bytes"))


@query("receipt_digest", """
WITH h AS (SELECT user_id, sha256(event_id || ':' || event_type) AS h FROM events),
s AS (SELECT user_id, count(*) AS n, """ + ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)::HUGEINT AS s{k}" for k in range(8)) + """ FROM h GROUP BY user_id)
SELECT user_id, n, sha256(""" + " || ':' || ".join(f"s{k}" for k in range(8)) + """) AS digest FROM s
""")
def receipt_digest(spark, sf_dir):
    token = F.concat_ws(":", F.col("event_id").cast("string"), "event_type")
    return versions.multiset_digest(events(spark, sf_dir), ["user_id"], token)
