"""Turn lifecycle, rollback and current status, as windows over a session's events."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_lifecycle(events: DataFrame, session: str, order: list[str], kind: str) -> DataFrame:
    """One row a start: its columns, number (from 1), status (completed, aborted, incomplete or
    in_progress), reason and the struct `end` of the event that ended it.

    kind holds start, complete or abort; other rows are passed over. The first terminal event
    before the next start ends a turn; a turn without one is superseded by the next start.
    """
    used = events.where(F.col(kind).isin("start", "complete", "abort"))
    w = Window.partitionBy(session).orderBy(*order)
    turn = F.sum(F.when(F.col(kind) == "start", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = used.withColumn("number", turn)
    w_turn = Window.partitionBy(session, "number").orderBy(*order)
    end = F.first(F.when(F.col(kind) != "start", F.struct(F.col(kind).alias("kind"), *order)), ignorenulls=True).over(w_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.max("number").over(Window.partitionBy(session))
    rows = rows.withColumn("end", end).withColumn("_last", last).where(F.col(kind) == "start")
    status = F.when(F.col("end.kind") == "complete", "completed").when(F.col("end.kind") == "abort", "aborted").when(F.col("number") < F.col("_last"), "incomplete").otherwise("in_progress")
    reason = F.when(status == "incomplete", "superseded_by_new_turn")
    return rows.withColumn("status", status).withColumn("reason", reason).drop("_last")


def ends_without_start(events: DataFrame, session: str, order: list[str], kind: str) -> DataFrame:
    """Terminal events that meet no open turn."""
    used = events.where(F.col(kind).isin("start", "complete", "abort"))
    w = Window.partitionBy(session).orderBy(*order)
    return used.withColumn("_before", F.lag(kind).over(w)).where((F.col(kind) != "start") & ~F.coalesce(F.col("_before") == "start", F.lit(False))).drop("_before")


def roll_back(events: DataFrame, session: str, order: list[str], pushes: str, pops: str) -> DataFrame:
    """Adds rolled_back: whether a later rollback undoes the row.

    pushes is 1 where a row ends a turn and 0 elsewhere, pops the number of turns that a row rolls
    back. Ended turns form a stack. Its height after every row is the running sum, lifted by its
    running minimum where rollbacks asked for more than there was; a turn is undone once the
    height falls below the one it was put at.
    """
    w = Window.partitionBy(session).orderBy(*order)
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    rows = events.withColumn("_sum", F.sum(F.col(pushes) - F.col(pops)).over(upto))
    rows = rows.withColumn("_height", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    undone = (F.col(pushes) == 1) & (F.coalesce(F.min("_height").over(after), F.col("_height")) < F.col("_height"))
    return rows.withColumn("rolled_back", undone).drop("_sum", "_height")


def session_status(turns: DataFrame, session: str) -> DataFrame:
    """session, status working, idle or unknown, and the number of the latest turn that counts."""
    counted = turns.where(~F.coalesce(F.col("rolled_back"), F.lit(False))) if "rolled_back" in turns.columns else turns
    working = F.bool_or(F.col("status") == "in_progress")
    return counted.groupBy(session).agg(F.when(working, "working").when(F.count("*") > 0, "idle").otherwise("unknown").alias("status"), F.max("number").alias("latest"))


def recent_turns(turns: DataFrame, session: str, order: str, done: int = 2) -> DataFrame:
    """The newest turn in progress and the last `done` others of each session."""
    active = F.col("status") == "in_progress"
    w = Window.partitionBy(session, active).orderBy(F.desc(order))
    return turns.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= F.when(active, 1).otherwise(done)).drop("_nth")


TURNS = "turn_id string, number long, status string, reason string, start_at long, end_at long, rolled_back boolean"
#: What a turn is after an event of its own.
AFTER = {"start": "in_progress", "complete": "completed", "abort": "failed"}


class TurnFold:
    """The turns of one session, event by event in order.

    turns: by id, numbered as they first appear. open: the id of the turn that runs. standing: the
    numbers of ended turns that no rollback has undone, rising, which is what a rollback takes from.
    """

    def __init__(self, turns: dict[str, dict] | None = None, open_: str | None = None):
        self.turns, self.open = turns or {}, open_
        self.names = list(self.turns)
        self.standing = [t["number"] for t in self.turns.values() if t["end_at"] is not None and not t["rolled_back"]]

    def apply(self, kind: str, ident: str, at: int, count: int | None = None, reason: str | None = None) -> list[str]:
        """Takes one event in; returns the ids of the turns that it changes."""
        if kind == "rollback":
            kept = max(0, len(self.standing) - max(count or 0, 0))
            undone = [self.names[n - 1] for n in self.standing[kept:]]
            del self.standing[kept:]
            for name in undone:
                self.turns[name]["rolled_back"] = True
            return undone
        changed = [ident]
        if kind == "start" and self.open not in (None, ident):
            changed.append(self.open)
            self._set(self.open, "incomplete", at, "superseded_by_new_turn")
        self._set(ident, AFTER[kind], at, reason)
        return changed

    def _set(self, ident: str, status: str, at: int, reason: str | None) -> None:
        runs = status == "in_progress"
        if ident not in self.turns:
            self.names.append(ident)
            self.turns[ident] = {"number": len(self.names), "status": status, "reason": None, "start_at": at, "end_at": None, "rolled_back": False}
        turn = self.turns[ident]
        turn["status"], turn["end_at"] = status, None if runs else at
        if not runs:
            turn["reason"] = reason
        place = bisect.bisect_left(self.standing, turn["number"])
        listed = self.standing[place : place + 1] == [turn["number"]]
        if listed and runs:
            del self.standing[place]
        elif not listed and not runs and not turn["rolled_back"]:
            self.standing.insert(place, turn["number"])
        if runs:
            self.open = ident
        elif self.open == ident:
            self.open = None


def turn_events(events: DataFrame, session: str, order: str | list[str], turn_id: str, kind: str, count: str | None = None, reason: str | None = None) -> DataFrame:
    """session, at, id, kind, count, reason of the rows that turns_by_id takes. A row without a turn
    id gets one of its session and place."""
    places = [order] if isinstance(order, str) else order
    ident = F.coalesce(F.col(turn_id).cast("string"), F.concat(F.lit("turn_"), F.sha2(F.concat_ws("\0", F.col(session).cast("string"), *(F.col(c).cast("string") for c in places)), 256)))
    used = events.where(F.col(kind).isin(*AFTER, "rollback"))
    # several columns of an order become one number
    at = F.col(order).cast("long") if isinstance(order, str) else F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long")
    none = F.lit(None)
    return used.select(
        F.col(session).alias("session"), at.alias("at"), ident.alias("id"), F.col(kind).alias("kind"),
        (none if count is None else F.col(count)).cast("long").alias("count"), (none if reason is None else F.col(reason)).cast("string").alias("reason"),
    )


def turns_by_id(events: DataFrame, session: str, order: str | list[str], turn_id: str, kind: str, count: str | None = None, reason: str | None = None) -> DataFrame:
    """One row a turn of a session: session and TURNS, numbered as they first appear.

    kind is start, complete, abort or rollback; other rows are passed over. A start opens a turn,
    or opens it again; a turn still open is then incomplete, superseded by the new one. An end
    closes its own turn, whichever is open, and makes one if it has none. A rollback undoes the
    last `count` turns, as numbered, that are closed by then and not undone yet; one undone stays
    so. A row without a turn id is a turn of its own. order: a number, or several columns such as
    (time, path, offset) for a session of several files; start_at and end_at are then places in
    that order.

    Rows are sorted by session and order and read as they come: what a task holds are the turns of
    one session, not its rows.
    """
    used = turn_events(events, session, order, turn_id, kind, count, reason)
    key = events.schema[session].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, made = object(), TurnFold(), None

        def shut() -> Iterator[pa.RecordBatch]:
            if fold.turns:
                yield pa.RecordBatch.from_pylist([{"session": now, "turn_id": t, **turn} for t, turn in fold.turns.items()], schema=made)

        for batch in batches:
            made = made or pa.schema([("session", batch.schema.field("session").type), ("turn_id", pa.string()), ("number", pa.int64()), ("status", pa.string()), ("reason", pa.string()), ("start_at", pa.int64()), ("end_at", pa.int64()), ("rolled_back", pa.bool_())])
            for row in batch.to_pylist():
                if row["session"] != now:
                    yield from shut()
                    now, fold = row["session"], TurnFold()
                fold.apply(row["kind"], row["id"], row["at"], row["count"], row["reason"])
        yield from shut()

    found = used.repartition("session").sortWithinPartitions("session", "at").mapInArrow(run, f"session {key}, {TURNS}")
    return found.withColumnRenamed("session", session)
