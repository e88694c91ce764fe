"""Pending work, cached results and queues across runs, as tables that each run reads and replaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import first_by


def latest_of(rows: DataFrame, by: list[str], value: str, at: str, position: str) -> DataFrame:
    """by and value of the row with the greatest `at`, compared as text; of equal ones the first by
    position. Null times are least."""
    first = [F.coalesce(F.col(at).cast("string"), F.lit("")).desc(), F.col(position).asc()]
    return first_by(rows, by, first).select(*by, value)


def last_wins(rows: DataFrame, key: list[str], value: str, position: str) -> DataFrame:
    """A map as a table: key and the value of its last row."""
    return rows.groupBy(*key).agg(F.max_by(value, position).alias(value))


def latest_history(entries: DataFrame, by: list[str], at: Column, position: str, payload: str) -> DataFrame:
    """by and the payload generated last; of equal times the last by position, and times that are
    no instants before all others."""
    return entries.groupBy(*by).agg(F.max_by(payload, F.struct(at.isNotNull().alias("valid"), at.alias("at"), F.col(position).alias("position"))).alias(payload))


def newly_ended(ended: DataFrame, turns: DataFrame, key: list[str]) -> DataFrame:
    """The ids of turns that this run saw end and that are completed and not rolled back."""
    return ended.select(*key).intersect(turns.where("status = 'completed' and not rolled_back").select(*key))


def unknown_to(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the known ones lack."""
    return rows.join(known.select(*key).distinct(), key, "left_anti")


def next_pending(pending: DataFrame, processed: DataFrame, retry: DataFrame, key: list[str]) -> DataFrame:
    """The pending set after a run: without what was processed, with what may be tried again."""
    left = unknown_to(pending.select(*key), processed, key)
    return left.union(retry.select(*key)).distinct()


def pending_first(rows: DataFrame, pending: Column, position: str) -> DataFrame:
    """Sorted: rows with pending work first, each part as it was."""
    return rows.orderBy(pending.desc(), position)


def queue_heads(queue: DataFrame, by: list[str], sequence: str = "sequence") -> DataFrame:
    """The first item of every queue."""
    return first_by(queue, by, [F.col(sequence).asc()])


def enqueue(queue: DataFrame, items: DataFrame, order: list[Column], by: list[str], sequence: str = "sequence") -> DataFrame:
    """items with the sequence numbers after the queue's last, in the order given."""
    last = queue.groupBy(*by).agg(F.max(sequence).alias("_last"))
    numbered = items.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.join(last, by, "left").withColumn(sequence, F.coalesce("_last", F.lit(0)) + F.col("_nth")).drop("_last", "_nth")


def queue_status(queue: DataFrame, by: list[str], sequence: str, size: Column) -> DataFrame:
    """Per queue: items, bytes, first and last sequence, and the structs (sequence, bytes) of its
    first ten items, oldest first."""
    head = first_by(queue.withColumn("_bytes", size), [*by, sequence], [F.col(sequence)])
    nth = head.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(sequence)))
    shown = F.array_sort(F.collect_list(F.when(F.col("_nth") <= 10, F.struct(F.col(sequence).alias("sequence"), F.col("_bytes").alias("bytes")))))
    return nth.groupBy(*by).agg(F.count("*").alias("items"), F.sum("_bytes").alias("bytes"), F.min(sequence).alias("first"), F.max(sequence).alias("last"), shown.alias("head"))


def running_totals(runs: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Adds total_<column>: the sum up to each run."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumns({f"total_{c}": F.sum(c).over(w) for c in columns})


def roll_up(metrics: DataFrame, by: list[str], event: str, names: list[str], value: Column) -> DataFrame:
    """One row a group, a column for each named event: the sum of value, 0 without any."""
    return metrics.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(event) == n, value)), F.lit(0)).alias(n) for n in names])


def lookup_memo(requests: DataFrame, memo: DataFrame, key: list[str], value: str) -> DataFrame:
    """requests with the memo's value for exactly their key, and hit: whether there is one."""
    known = memo.select(*key, F.col(value), F.lit(True).alias("hit"))
    return requests.join(known, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def unpack_results(entries: DataFrame, kinds: list[str]) -> DataFrame:
    """One row for each kind of result that a combined entry holds, as columns kind and result; null
    results give none."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("result")) for k in kinds])
    rest = [c for c in entries.columns if c not in kinds]
    return entries.select(*rest, F.explode(each).alias("_x")).select(*rest, "_x.kind", "_x.result").where("result is not null")


def pack_results(results: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    """The opposite: one row a group with a column for each kind."""
    return results.groupBy(*by).agg(*[F.max(F.when(F.col("kind") == k, F.col("result"))).alias(k) for k in kinds])


def lost_history(cursors: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """Cursors whose history is gone: they are to be dropped and their logs read anew."""
    return unknown_to(cursors, history, key)


def watch_list(pending: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """What a run looks at: carried-over work first (carried is true), then what has changed."""
    carried = pending.select(*key).distinct().withColumn("carried", F.lit(True))
    return carried.unionByName(unknown_to(changed.select(*key).distinct(), pending, key).withColumn("carried", F.lit(False)))


def run_until_done(run: Callable[[], tuple[int, int, bool]], most: int) -> tuple[int, str]:
    """Calls run() until its (deferred, done, failed) shows that nothing is deferred. Stops as well
    on a failure, without progress, and after `most` runs: the number of runs and the reason."""
    for k in range(1, most + 1):
        deferred, done, failed = run()
        if failed:
            return k, "failed"
        if deferred == 0:
            return k, "complete"
        if done == 0:
            return k, "no_progress"
    return most, "max_runs"


def receipt_keep(receipts: DataFrame, key: list[str], data: DataFrame, current: DataFrame, pending: DataFrame, age_s: Column, least_age_s: int = 604_800) -> DataFrame:
    """Adds decision and reason: a receipt is protected as current, pending, still having data, or
    too young, in this order; else a candidate for deletion."""
    rows = receipts
    for name, table in (("_data", data), ("_current", current), ("_pending", pending)):
        rows = rows.join(table.select(*key).distinct().withColumn(name, F.lit(True)), key, "left")
    reason = F.when(F.col("_current"), "current").when(F.col("_pending"), "pending").when(F.col("_data"), "data_exists").when(age_s < least_age_s, "retention_age")
    return rows.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").isNull(), "candidate").otherwise("protected")).drop("_data", "_current", "_pending")


#: The order in which a plan's kinds are deleted.
DELETION = ("receipt", "staging", "public")


def deletion_order(candidates: DataFrame, kind: str, *then: str) -> DataFrame:
    """Sorted as a plan deletes: receipts, staging, public, each by the columns given."""
    return candidates.orderBy(F.array_position(F.array(*map(F.lit, DELETION)), F.col(kind)), *then)


def totals(candidates: DataFrame, size: str) -> DataFrame:
    """One row: candidates and bytes."""
    return candidates.agg(F.count("*").alias("candidates"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def equal_sets(*tables: DataFrame) -> DataFrame:
    """One row, equal: whether all tables hold the same distinct rows."""
    first, apart = tables[0], None
    for other in tables[1:]:
        for a, b in ((first, other), (other, first)):
            found = a.subtract(b).limit(1)
            apart = found if apart is None else apart.unionAll(found)
    return apart.agg((F.count("*") == 0).alias("equal"))
