"""Queries over the trading tables: versions, manifests, merges, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import dedup, joins, snapshot, versions

from .registry import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHAIN = """
WITH o AS (SELECT o_custkey, o_orderstatus, o_orderdate, o_orderkey, lag(o_orderstatus) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
n AS (SELECT *, sum((before IS NULL OR before <> o_orderstatus)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM o),
v AS (SELECT o_custkey, version, any_value(o_orderstatus) AS o_orderstatus, count(*) AS n_sources,
             'decision_' || sha256(o_custkey::VARCHAR || chr(0) || arg_min(o_orderkey, (o_orderdate, o_orderkey))::VARCHAR) AS decision_id FROM n GROUP BY o_custkey, version),
c AS (SELECT *, lag(decision_id) OVER w AS supersedes, lead(decision_id) OVER w AS superseded_by FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY version))
"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.supersede_chain(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("supersede_chain", CHAIN + "SELECT o_custkey, version::BIGINT AS version, o_orderstatus, n_sources, decision_id, supersedes, superseded_by FROM c")
def supersede_chain(spark, sf_dir):
    return chain(spark, sf_dir).select("o_custkey", "version", "o_orderstatus", "n_sources", "decision_id", "supersedes", "superseded_by")


@query("link_integrity", CHAIN + """, d AS (SELECT decision_id, superseded_by, CASE WHEN version % 3 > 0 THEN supersedes END AS supersedes FROM c WHERE version % 5 > 0)
SELECT a.decision_id FROM d a LEFT JOIN d b ON a.superseded_by = b.decision_id WHERE a.superseded_by IS NOT NULL AND b.supersedes IS DISTINCT FROM a.decision_id
""")
def link_integrity(spark, sf_dir):
    """Versions linked both ways, after every fifth was lost and every third forgot what it superseded."""
    kept = chain(spark, sf_dir).where(F.col("version") % 5 > 0).withColumn("supersedes", F.when(F.col("version") % 3 > 0, F.col("supersedes")))
    return joins.broken_links(kept, "decision_id", "superseded_by", "supersedes").select("decision_id")


@query("keep_n_previous", """
WITH a AS (SELECT *, o_orderstatus = 'P' AS pending, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS current FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, current ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM a),
d AS (SELECT o_custkey, o_orderkey, CASE WHEN current THEN 'current' WHEN pending THEN 'pending' WHEN nth <= 2 THEN 'previous_generation'
             WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'retention_age' END AS reason FROM r)
SELECT o_custkey, o_orderkey, reason, CASE WHEN reason IS NULL THEN 'candidate' ELSE 'protected' END AS decision FROM d
""")
def keep_n_previous(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    last = rows.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    rows = rows.join(last, "o_custkey")
    age = F.when(F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp"), 0).otherwise(7200)
    kept = versions.retention(rows, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderkey") == F.col("last"), F.col("o_orderstatus") == "P", age)
    return kept.select("o_custkey", "o_orderkey", "reason", "decision")


@query("manifest_reconcile", """
WITH m AS (SELECT o_orderkey AS k, (o_orderkey % 4 + 1)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'P'), a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(m.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN m.k IS NULL THEN 'unexpected' WHEN m.n = a.n THEN 'match' ELSE 'mismatch' END AS state FROM m FULL JOIN a ON m.k = a.k
""")
def manifest_reconcile(spark, sf_dir):
    expected = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 4 + 1).alias("n"))
    actual = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.reconcile(expected, actual, ["k"], ["n"])


@query("tree_digest", """
SELECT l_orderkey, count(*) AS files, sum(l_partkey)::BIGINT AS bytes,
       sha256(string_agg(l_linenumber || chr(9) || l_partkey || chr(9) || l_returnflag, chr(10) ORDER BY l_linenumber || chr(9) || l_partkey || chr(9) || l_returnflag)) AS tree_sha256
FROM lineitem GROUP BY l_orderkey
""")
def tree_digest(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("path", F.col("l_linenumber").cast("string"))
    return snapshot.tree_digest(rows, ["l_orderkey"], "path", "l_partkey", "l_returnflag")


@query("theta_or_join", """
SELECT c_custkey, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey
UNION
SELECT c_custkey, o_orderkey FROM customer, orders WHERE c_custkey = o_orderkey
""")
def theta_or_join(spark, sf_dir):
    customers, orders = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return joins.either_key(customers, orders, [("c_custkey", "o_custkey"), ("c_custkey", "o_orderkey")], ["c_custkey", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("array_overlap_semi", """
SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING list_has_any(list(l_linenumber), [4, 6])
""")
def array_overlap_semi(spark, sf_dir):
    sets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("lines"))
    return joins.overlapping(sets, "lines", F.array(F.lit(4), F.lit(6))).select("l_orderkey")


@query("evidence_containment", """
SELECT l_orderkey, bool_and(l_linenumber IN (1, 2, 3)) AS contained FROM lineitem GROUP BY l_orderkey
""")
def evidence_containment(spark, sf_dir):
    sets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("lines"))
    return sets.select("l_orderkey", joins.contained(F.col("lines"), F.array(F.lit(1), F.lit(2), F.lit(3))).alias("contained"))


@query("full_outer_merge", """
WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 8000 GROUP BY ALL), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY ALL)
SELECT coalesce(c.k, s.k) AS k, concat_ws(',', CASE WHEN c.k IS NOT NULL THEN 'staged' END, CASE WHEN s.k IS NOT NULL THEN 'worktree' END) AS scopes FROM c FULL JOIN s ON c.k = s.k
""")
def full_outer_merge(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_acctbal > 8000").select(F.col("c_nationkey").alias("k")).distinct().withColumn("scopes", F.array(F.lit("staged")))
    b = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k")).distinct().withColumn("scopes", F.array(F.lit("worktree")))
    return joins.merge_scopes(a, b, ["k"]).withColumn("scopes", F.array_join("scopes", ","))


@query("anti_unmatched", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_unmatched(spark, sf_dir):
    """Customers without an order."""
    customers, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@query("history_upsert", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders
""")
def history_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return dedup.upsert(old, old.where("o_orderstatus = 'O'").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("replay_counts", """
SELECT o_custkey, greatest(count(*) FILTER (WHERE o_orderstatus <> 'P'), count(*) FILTER (WHERE o_orderstatus <> 'F')) AS count FROM orders GROUP BY o_custkey
""")
def replay_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    old, new = (rows.where(F.col("o_orderstatus") != state).groupBy("o_custkey").count() for state in ("P", "F"))
    return dedup.merge_counts(old, new, ["o_custkey"])


@query("plan_equality", """
SELECT 'again' AS plan, true AS equal UNION ALL SELECT 'changed', count(*) = 0 FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P'
UNION ALL SELECT 'more', count(*) = 0 FROM orders WHERE o_orderstatus = 'P'
""")
def plan_equality(spark, sf_dir):
    """The approved plan against one made again by groups, one with other states, and one that has
    its pending rows twice."""
    orders = read(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", "o_orderstatus")
    again = orders.groupBy("o_orderkey").agg(F.max("o_orderstatus").alias("o_orderstatus"))
    changed = orders.select("o_orderkey", F.when(F.col("o_totalprice") > 100_000, "P").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    more = rows.unionAll(rows.where("o_orderstatus = 'P'"))
    plans = [dedup.same_rows(rows, other).select(F.lit(name).alias("plan"), "equal") for name, other in (("again", again), ("changed", changed), ("more", more))]
    return plans[0].unionAll(plans[1]).unionAll(plans[2])


@query("case_collisions", "SELECT lower(c_mktsegment) AS folded, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def case_collisions(spark, sf_dir):
    return snapshot.path_collisions(read(spark, sf_dir, "customer"), "c_mktsegment")


@query("workspace_list", """
SELECT n_name, r_name, count(c_custkey) AS n_customers, max(c_custkey) AS latest FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name
""")
def workspace_list(spark, sf_dir):
    nation, region, customer = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    current = customer.groupBy("c_nationkey").agg(F.count("*").alias("n_customers"), F.max("c_custkey").alias("latest"))
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).join(current, nation.n_nationkey == current.c_nationkey, "left")
    return rows.select("n_name", "r_name", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), "latest").orderBy(F.lower("n_name"), "n_name")


@query("dashboard_row", """
SELECT (SELECT count(*) FROM events) AS n_events, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors, (SELECT max(event_id) FROM events WHERE event_type = 'error') AS latest_error,
       (SELECT count(*) FROM conversations) AS n_messages, (SELECT count(DISTINCT conv_id) FROM conversations) AS n_conversations, (SELECT max(o_orderkey) FROM orders) AS latest_order
""")
def dashboard_row(spark, sf_dir):
    e = read(spark, sf_dir, "events").agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("latest_error"))
    c = read(spark, sf_dir, "conversations").agg(F.count("*").alias("n_messages"), F.countDistinct("conv_id").alias("n_conversations"))
    o = read(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("latest_order"))
    one = [x.withColumn("_one", F.lit(1)) for x in (e, c, o)]  # one row each
    return one[0].join(one[1], "_one").join(one[2], "_one").drop("_one")


@query("topic_key", """
WITH t AS (SELECT p_partkey, regexp_replace(lower(trim(regexp_replace(p_name || ' ' || p_type, '\\s+', ' ', 'g'))), ' ', '_', 'g') AS k FROM part)
SELECT p_partkey, CASE WHEN length(k) <= 20 THEN k ELSE substr(k, 1, 3) || '_' || substr(sha256(k), 1, 16) END AS topic FROM t
""")
def topic_key(spark, sf_dir):
    from logloom.functions.keys import topic_key as key

    return read(spark, sf_dir, "part").select("p_partkey", key(F.concat_ws(" ", "p_name", "p_type"), 20).alias("topic"))
