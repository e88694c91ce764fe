"""Queries over pending work, queues, cached results, turns by id, errors and change lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import changes, dedup, errors, ledger, turns

from .registry import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("latest_session", "SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_session(spark, sf_dir):
    return ledger.latest_of(read(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", "event_id")


@query("turn_session", "SELECT event_type, arg_max(user_id, event_id) AS user_id FROM events GROUP BY event_type")
def turn_session(spark, sf_dir):
    return ledger.last_wins(read(spark, sf_dir, "events"), ["event_type"], "user_id", "event_id")


@query("latest_history", """
SELECT user_id, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error' DESC, CASE WHEN event_type <> 'error' THEN ts END DESC NULLS LAST, event_id DESC) = 1
""")
def latest_history(spark, sf_dir):
    """An error's time counts as no instant."""
    at = F.when(F.col("event_type") != "error", F.col("ts"))
    return ledger.latest_history(read(spark, sf_dir, "events"), ["user_id"], at, "event_id", "event_id")


@query("newly_ended", """
SELECT user_id FROM events WHERE event_type = 'purchase'
INTERSECT SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'signup') AND NOT bool_or(event_type = 'error' AND value > 150)
""")
def newly_ended(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    status = F.when(F.bool_or(F.col("event_type") == "signup"), "completed").otherwise("in_progress")
    state = rows.groupBy("user_id").agg(status.alias("status"), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 150)).alias("rolled_back"))
    return ledger.newly_ended(rows.where("event_type = 'purchase'"), state, ["user_id"])


@query("unknown_sessions", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def unknown_sessions(spark, sf_dir):
    known = read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return ledger.unknown_to(read(spark, sf_dir, "customer"), known, ["c_custkey"]).select("c_custkey", "c_name")


@query("next_pending", """
SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')
UNION SELECT user_id FROM events WHERE event_type = 'error'
""")
def next_pending(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    pending = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return ledger.next_pending(pending, rows.where("event_type = 'purchase'"), rows.where("event_type = 'error'"), ["user_id"])


@query("pending_first", "SELECT o_orderkey, o_orderstatus FROM orders")
def pending_first(spark, sf_dir):
    return ledger.pending_first(read(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P", "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("queue_heads", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def queue_heads(spark, sf_dir):
    return ledger.queue_heads(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("enqueue", """
WITH q AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT p.o_custkey, p.o_orderdate, coalesce(last, 0) + row_number() OVER (PARTITION BY p.o_custkey ORDER BY p.o_orderdate, p.o_orderkey) AS sequence
FROM orders p LEFT JOIN q ON p.o_custkey = q.o_custkey WHERE p.o_orderstatus = 'P'
""")
def enqueue(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    queue = rows.where("o_orderstatus <> 'P'").select("o_custkey", F.col("o_orderkey").alias("sequence"))
    items = rows.where("o_orderstatus = 'P'")
    return ledger.enqueue(queue, items, [F.col("o_orderdate"), F.col("o_orderkey")], ["o_custkey"]).select("o_custkey", "o_orderdate", "sequence")


@query("queue_status", """
WITH q AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders)
SELECT o_custkey, count(*) AS items, sum(length(o_orderpriority))::BIGINT AS bytes, min(o_orderkey) AS first, max(o_orderkey) AS last,
       string_agg(o_orderkey || ':' || length(o_orderpriority), ',' ORDER BY o_orderkey) FILTER (WHERE nth <= 10) AS head FROM q GROUP BY o_custkey
""")
def queue_status(spark, sf_dir):
    found = ledger.queue_status(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", F.octet_length("o_orderpriority"))
    return found.withColumn("head", F.array_join(F.transform("head", lambda x: F.concat_ws(":", x["sequence"].cast("string"), x["bytes"].cast("string"))), ","))


@query("running_totals", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS total FROM orders")
def running_totals(spark, sf_dir):
    return ledger.running_totals(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice"]).select("o_custkey", "o_orderkey", F.round("total_o_totalprice", 2).alias("total"))


@query("metric_roll_up", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id
""")
def metric_roll_up(spark, sf_dir):
    return ledger.roll_up(read(spark, sf_dir, "events"), ["user_id"], "event_type", ["view", "error", "purchase"], F.lit(1))


MEMO = "SELECT user_id, event_type, max(event_id) AS cached FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL"


@query("memo_lookup", f"WITH m AS ({MEMO}) SELECT e.event_id, m.cached, m.cached IS NOT NULL AS hit FROM events e LEFT JOIN m ON e.user_id = m.user_id AND e.event_type = m.event_type")
def memo_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    memo = rows.where("event_type in ('view', 'click')").groupBy("user_id", "event_type").agg(F.max("event_id").alias("cached"))
    return ledger.lookup_memo(rows, memo, ["user_id", "event_type"], "cached").select("event_id", "cached", "hit")


PACKED = "SELECT user_id, max(event_id) FILTER (WHERE event_type = 'view') AS view, max(event_id) FILTER (WHERE event_type = 'click') AS click, max(event_id) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id"


@query("pack_results", PACKED)
def pack_results(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("result"))
    return ledger.pack_results(rows, ["user_id"], ["view", "click", "error"])


@query("unpack_results", f"SELECT user_id, kind, result FROM ({PACKED}) UNPIVOT (result FOR kind IN (view, click, error))")
def unpack_results(spark, sf_dir):
    return ledger.unpack_results(pack_results(spark, sf_dir), ["view", "click", "error"])


@query("lost_history", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'view')")
def lost_history(spark, sf_dir):
    history = read(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("c_custkey"))
    return ledger.lost_history(read(spark, sf_dir, "customer").select("c_custkey"), history, ["c_custkey"])


@query("watch_list", """
SELECT DISTINCT user_id, true AS carried FROM events WHERE event_type = 'error'
UNION ALL SELECT DISTINCT user_id, false FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')
""")
def watch_list(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return ledger.watch_list(rows.where("event_type = 'error'"), rows, ["user_id"])


RECEIPTS = """
WITH r AS (
  SELECT o_orderkey, o_totalprice, CASE
    WHEN o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey) THEN 'current'
    WHEN o_orderstatus = 'P' THEN 'pending'
    WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'data_exists'
    WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'retention_age' END AS reason FROM orders
)
"""


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    current = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    data = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    age = F.when(F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp"), 0).otherwise(10_000_000)
    return ledger.receipt_keep(rows, ["o_orderkey"], data, current, rows.where("o_orderstatus = 'P'"), age)


@query("receipt_keep", RECEIPTS + "SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN 'candidate' ELSE 'protected' END AS decision FROM r")
def receipt_keep(spark, sf_dir):
    return receipts(spark, sf_dir).select("o_orderkey", "reason", "decision")


@query("retention_totals", RECEIPTS + "SELECT count(*) AS candidates, coalesce(sum(floor(o_totalprice)), 0)::BIGINT AS bytes FROM r WHERE reason IS NULL")
def retention_totals(spark, sf_dir):
    return ledger.totals(receipts(spark, sf_dir).where("decision = 'candidate'").withColumn("size", F.floor("o_totalprice").cast("long")), "size")


@query("deletion_order", RECEIPTS + "SELECT o_orderkey, CASE WHEN floor(o_totalprice) < 50000 THEN 'public' WHEN floor(o_totalprice) < 150000 THEN 'receipt' ELSE 'staging' END AS kind FROM r WHERE reason IS NULL")
def deletion_order(spark, sf_dir):
    price = F.floor("o_totalprice")
    kinds = receipts(spark, sf_dir).where("decision = 'candidate'").withColumn("kind", F.when(price < 50_000, "public").when(price < 150_000, "receipt").otherwise("staging"))
    return ledger.deletion_order(kinds, "kind", "o_orderkey").select("o_orderkey", "kind")


@query("three_way_sets", """
WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT 'same' AS sets, true AS equal UNION ALL SELECT 'apart', NOT EXISTS (SELECT k FROM a EXCEPT SELECT k FROM b) AND NOT EXISTS (SELECT k FROM b EXCEPT SELECT k FROM a)
""")
def three_way_sets(spark, sf_dir):
    """Orders against themselves by two ways, and against those with items."""
    keys = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    again = read(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count("*").alias("n")).select(F.col("o_orderkey").alias("k"))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    same = ledger.equal_sets(keys, again, keys).select(F.lit("same").alias("sets"), "equal")
    return same.unionAll(ledger.equal_sets(keys, again, items).select(F.lit("apart").alias("sets"), "equal"))


@query("plan_changed", """
WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END FROM orders)
SELECT NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) AS equal
""")
def plan_changed(spark, sf_dir):
    """A reviewed plan against a fresh one in which states have moved on."""
    reviewed = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    fresh = reviewed.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")))
    return dedup.same_rows(reviewed, fresh)


TURN_EVENTS = """
WITH e AS (
  SELECT user_id, event_id, 't' || (value::BIGINT % 4) AS turn_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'abort' END AS kind,
         event_id = max(event_id) OVER (PARTITION BY user_id) AS last
  FROM events
), own AS (
  SELECT *, lead(CASE WHEN kind = 'start' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS next_start,
         row_number() OVER (PARTITION BY user_id, turn_id ORDER BY event_id DESC) AS nth, min(event_id) OVER (PARTITION BY user_id, turn_id) AS start_at
  FROM e WHERE kind IS NOT NULL AND NOT last
), t AS (
  SELECT user_id, turn_id, start_at, dense_rank() OVER (PARTITION BY user_id ORDER BY start_at) AS number,
         CASE WHEN kind = 'complete' THEN 'completed' WHEN kind = 'abort' THEN 'failed' WHEN next_start IS NOT NULL THEN 'incomplete' ELSE 'in_progress' END AS status,
         CASE WHEN kind = 'start' THEN next_start ELSE event_id END AS end_at
  FROM own WHERE nth = 1
)
"""


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn ids repeat; the last event of every user rolls back its last two turns."""
    rows = read(spark, sf_dir, "events")
    last = rows.groupBy("user_id").agg(F.max("event_id").alias("last"))
    kind = F.when(F.col("event_id") == F.col("last"), "rollback").when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "abort")
    rows = rows.join(last, "user_id").withColumns({"kind": kind, "turn_id": F.concat(F.lit("t"), F.rint("value").cast("long") % 4), "count": F.lit(2)})
    return turns.turns_by_id(rows, "user_id", "event_id", "turn_id", "kind", "count")


@query("lifecycle_by_id", TURN_EVENTS + "SELECT user_id, turn_id, number, status, start_at, end_at FROM t")
def lifecycle_by_id(spark, sf_dir):
    return turns_of(spark, sf_dir).select("user_id", "turn_id", "number", "status", "start_at", "end_at")


@query("rollback_superseded", TURN_EVENTS + """
SELECT user_id, turn_id, coalesce(end_at IS NOT NULL AND row_number() OVER (PARTITION BY user_id, end_at IS NULL ORDER BY number DESC) <= 2, false) AS rolled_back FROM t
""")
def rollback_superseded(spark, sf_dir):
    return turns_of(spark, sf_dir).select("user_id", "turn_id", "rolled_back")


FOLD = """
WITH f AS (
  SELECT e.user_id, e.value::BIGINT % 3 AS place, e.event_id, e.event_type, (SELECT min(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id > e.event_id) AS by_id
  FROM events e WHERE e.event_type = 'error'
), g AS (
  SELECT user_id, place, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, arg_max(by_id, event_id) FILTER (WHERE by_id IS NOT NULL OR true) AS any_id, bool_and(event_id > 500) AS rolled_back,
         string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM f GROUP BY user_id, place
)
SELECT g.user_id, g.place, n, first_id, last_id, rolled_back, ids, f.by_id AS resolved_by, CASE WHEN f.by_id IS NULL THEN 'open' ELSE 'resolved' END AS status FROM g JOIN f ON f.event_id = g.last_id
"""


@query("error_fold_reopen", FOLD)
def error_fold_reopen(spark, sf_dir):
    """Errors by user and place; a purchase resolves what its user has open."""
    kind = F.col("event_type")
    rows = read(spark, sf_dir, "events").withColumns({"place": F.rint("value").cast("long") % 3, "ids": F.array("event_id"), "undone": F.col("event_id") > 500})
    folded = errors.fold_resolved(rows, ["user_id", "place"], ["user_id"], ["event_id"], kind == "error", kind == "purchase", "ids", "undone")
    return folded.select("user_id", "place", "n", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), "rolled_back", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.col("resolved_by.event_id").alias("resolved_by"), "status")


@query("error_order", "SELECT user_id, place, status FROM (" + FOLD + ")")
def error_order(spark, sf_dir):
    rows = error_fold_reopen(spark, sf_dir)
    return rows.orderBy(*errors.list_order(F.col("status"), F.col("rolled_back"), F.col("last_id"), F.col("first_id"))).select("user_id", "place", "status")


@query("ids_by_call", "SELECT user_id, event_type AS call_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY ALL")
def ids_by_call(spark, sf_dir):
    found = errors.ids_by_call(read(spark, sf_dir, "events").withColumn("calls", F.array("event_type")), ["user_id"], "calls", "event_id", "event_id")
    return found.select("user_id", "call_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("mark_rolled_back", """
SELECT event_id, user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'error' AND value > 150)) AS rolled_back FROM events
""")
def mark_rolled_back(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    undone = rows.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > 150)).alias("rolled_back"))
    return errors.mark_rolled_back(rows, undone, ["user_id"]).select("event_id", "rolled_back")


@query("error_candidates", """
WITH e AS (SELECT event_id, event_type, value::BIGINT % 3 AS code FROM events)
SELECT event_id, CASE event_type WHEN 'signup' THEN 'test_failure' WHEN 'view' THEN 'python_exception' WHEN 'click' THEN 'git_command_failure' ELSE 'command_failure' END AS kind,
       CASE WHEN code = 0 THEN 'warning' ELSE 'error' END AS severity,
       CASE event_type WHEN 'signup' THEN 'テストが失敗しました: suite/a.py.case_' || event_id WHEN 'view' THEN 'Python例外が発生しました: my.KeyError: k' || event_id
                       WHEN 'click' THEN 'Gitコマンドが失敗しました: no ref ' || event_id ELSE 'コマンドが終了コード' || code || 'で失敗しました。' END AS summary,
       CASE event_type WHEN 'signup' THEN 'suite/a.py' WHEN 'view' THEN '/x/b.py' END AS location_path, CASE WHEN event_type = 'view' THEN event_id END::INT AS location_line
FROM e WHERE event_type IN ('signup', 'view') OR code <> 0
""")
def error_candidates(spark, sf_dir):
    """Tool outputs made from events, one for each precedence."""
    ident = F.col("event_id").cast("string")
    body = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("FAIL: case_"), ident, F.lit(" (suite/a.py)\nwhy\n"), F.lit("-" * 70)))
        .when(F.col("event_type") == "view", F.concat(F.lit('Traceback (most recent call last):\n  File "/x/b.py", line '), ident, F.lit(", in f\nmy.KeyError: k"), ident))
        .when(F.col("event_type") == "click", F.concat(F.lit("fatal: no ref "), ident))
        .otherwise("see exit code: 9 in docs")
    )
    text = F.concat(F.lit("Exit code: "), (F.rint("value").cast("long") % 3).cast("string"), F.lit("\nProcess exited with code 7\n"), body)
    found = read(spark, sf_dir, "events").select("event_id", F.explode(errors.failure_candidates(text)).alias("c"))
    return found.select("event_id", "c.kind", "c.severity", "c.summary", "c.location_path", "c.location_line")


CHANGES = """
WITH s AS (
  SELECT o_custkey, 'a/File' || o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'modified' ELSE 'none' END AS index, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'untracked' WHEN o_orderstatus = 'O' THEN 'deleted' ELSE 'none' END AS worktree
  FROM orders WHERE o_orderstatus <> 'P'
), n AS (
  SELECT o_custkey, 'A/FILE' || o_orderkey AS path, 'renamed' AS status FROM orders WHERE o_orderpriority < '3'
), l AS (
  SELECT l_orderkey, count(*) AS added, sum(l_linenumber)::BIGINT AS deleted, bool_or(l_returnflag = 'R') AS bin FROM lineitem GROUP BY l_orderkey
), x AS (
  SELECT o_custkey, 'a/fILE' || l_orderkey AS path, added, deleted, bin FROM l JOIN orders ON o_orderkey = l_orderkey
), m AS (
  SELECT coalesce(s.o_custkey, n.o_custkey) AS o_custkey, coalesce(s.path, n.path) AS path, s.index, s.worktree, n.status AS committed FROM s FULL JOIN n ON s.o_custkey = n.o_custkey AND lower(s.path) = lower(n.path)
), c AS (
  SELECT m.*, x.added, x.bin, x.path IS NOT NULL AS known FROM m LEFT JOIN x ON x.o_custkey = m.o_custkey AND lower(x.path) = lower(m.path)
), d AS (
  SELECT *, index = 'modified' AS in_index, worktree <> 'none' AS in_tree FROM c
), z AS (
  SELECT o_custkey, path, coalesce(committed, 'none') AS committed,
         concat_ws(',', CASE WHEN committed IS NOT NULL THEN 'committed_in_session' END, CASE WHEN in_index THEN 'staged' END, CASE WHEN in_tree THEN 'worktree' END) AS scopes,
         CASE WHEN index IS NULL THEN 'not_applicable' WHEN known THEN CASE WHEN bin THEN 'binary' ELSE 'measured' END WHEN NOT in_index THEN 'not_applicable' WHEN worktree = 'untracked' THEN 'not_inspected' ELSE 'failed' END AS staged,
         CASE WHEN index IS NULL OR NOT in_tree THEN 'not_applicable' WHEN worktree = 'untracked' THEN 'not_inspected' ELSE 'failed' END AS unstaged,
         CASE WHEN committed IS NULL THEN 'not_applicable' ELSE 'failed' END AS in_session, CASE WHEN index IS NOT NULL AND known THEN added END AS added
  FROM d
)
"""


def change_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changed files of their customers, items as lines; spellings differ in case."""
    rows = read(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    tree = rows.where("o_orderstatus <> 'P'").select("o_custkey", F.concat(F.lit("a/File"), "o_orderkey").alias("path"), F.lit(None).cast("string").alias("old_path"), F.when(status == "F", "modified").otherwise("none").alias("index"), F.when((status == "O") & (F.col("o_totalprice") > 200_000), "untracked").when(status == "O", "deleted").otherwise("none").alias("worktree"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("added"), F.sum("l_linenumber").alias("deleted"), F.bool_or(F.col("l_returnflag") == "R").alias("binary"))
    staged = lines.join(rows.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_custkey", F.concat(F.lit("a/fILE"), "o_orderkey").alias("path"), "added", "deleted", "binary")
    names = rows.where("o_orderpriority < '3'").select("o_custkey", F.concat(F.lit("A/FILE"), "o_orderkey").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit("renamed").alias("status"))
    none = staged.limit(0)
    return changes.merged_changes(tree, staged, none, names, none, ["o_custkey"])


@query("change_merge", CHANGES + "SELECT o_custkey, path, committed, scopes, staged, unstaged, in_session, added FROM z")
def change_merge(spark, sf_dir):
    return change_list(spark, sf_dir).select("o_custkey", "path", "committed", F.array_join("scopes", ",").alias("scopes"), F.col("staged.state").alias("staged"), F.col("unstaged.state").alias("unstaged"), F.col("committed_in_session.state").alias("in_session"), F.col("staged.added").alias("added"))


@query("change_binary", CHANGES + "SELECT o_custkey, path, CASE WHEN staged = 'binary' THEN true WHEN staged = 'measured' THEN false END AS binary FROM z")
def change_binary(spark, sf_dir):
    return changes.by_path(change_list(spark, sf_dir)).select("o_custkey", "path", "binary")


@query("change_issues", CHANGES + """
SELECT DISTINCT o_custkey, 'staged' AS scope FROM z WHERE staged = 'failed' UNION SELECT o_custkey, 'unstaged' FROM z WHERE unstaged = 'failed' UNION SELECT o_custkey, 'committed_in_session' FROM z WHERE in_session = 'failed'
""")
def change_issues(spark, sf_dir):
    return changes.missing_numstat(change_list(spark, sf_dir), ["o_custkey"])
