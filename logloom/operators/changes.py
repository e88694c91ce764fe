"""Version-control changes: working tree, index and commits of a session merged by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a numstat entry, and the scopes in their order.
MEASURED, BINARY, NOT_INSPECTED, NOT_APPLICABLE, FAILED = "measured", "binary", "not_inspected", "not_applicable", "failed"
SCOPES = ("committed_in_session", "staged", "worktree")


def current_scopes(index: Column, worktree: Column) -> Column:
    """Where a change of the working tree stands, as an array."""
    staged = F.when(~index.isin("none", "untracked"), "staged")
    tree = F.when((worktree != "none") | (index == "untracked"), "worktree")
    return F.array_compact(F.array(staged, tree))


def pending_state(scope: str, scopes: Column, index: Column, worktree: Column) -> Column:
    """A scope's numstat state until an entry is found: failed where there should be one."""
    untracked = (index == "untracked") | (worktree == "untracked")
    return F.when(~F.array_contains(scopes, scope), NOT_APPLICABLE).when(untracked, NOT_INSPECTED).otherwise(FAILED)


def merged_changes(status: DataFrame, staged: DataFrame, unstaged: DataFrame, names: DataFrame, committed: DataFrame, by: list[str]) -> DataFrame:
    """One row a changed path of a group, without regard to case: by, path, old_path, index, worktree,
    committed (the commits' status or none), scopes, the structs staged, unstaged and
    committed_in_session (state, added, deleted), and binary.

    status has path, old_path, index and worktree of the working tree, names path, old_path and
    status of the session's commits, the three numstats path, added, deleted and binary. Of several
    rows of one input for a path the last by its spelling holds (of equal ones a measured one, then
    the greater); a path is spelled as in the status, else as in the commits. Rows without a path,
    and numstats of a path that neither status nor commits have, are left out; groups may be null.
    The inputs are stacked and dealt out once.
    """
    counted = F.struct(F.when(F.col("binary"), BINARY).otherwise(MEASURED).alias("state"), F.col("added").cast("long").alias("added"), F.col("deleted").cast("long").alias("deleted"))
    inputs = {"_tree": (status, F.struct("path", "old_path", "index", "worktree")), "_log": (names, F.struct("path", "old_path", "status")), "_staged": (staged, counted), "_unstaged": (unstaged, counted), "_committed": (committed, counted)}
    stacked = None
    for name, (rows, value) in inputs.items():
        rows = rows.select(*by, "path", value.alias(name))
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
    last = [F.max(F.when(F.col(name).isNotNull(), F.struct("path", name)))[name].alias(name) for name in inputs]
    found = stacked.where("path is not null").groupBy(*by, F.lower("path").alias("_folded")).agg(*last).where("_tree is not null or _log is not null")

    index, worktree, logged, empty = F.col("_tree.index"), F.col("_tree.worktree"), F.col("_log").isNotNull(), F.lit(None).cast("long")
    none = F.array().cast("array<string>")
    now = F.when(F.col("_tree").isNotNull(), current_scopes(index, worktree)).otherwise(none)
    def told(entry: Column, pending: Column) -> Column:
        return F.coalesce(entry, F.struct(pending.alias("state"), empty.alias("added"), empty.alias("deleted")))
    def current(entry: str, scope: str) -> Column:
        return told(F.when(F.col("_tree").isNotNull(), F.col(entry)), pending_state(scope, now, index, worktree))
    rows = found.select(
        *by, F.coalesce("_tree.path", "_log.path").alias("path"), F.coalesce("_tree.old_path", "_log.old_path").alias("old_path"), F.coalesce(index, F.lit("none")).alias("index"), F.coalesce(worktree, F.lit("none")).alias("worktree"),
        F.coalesce("_log.status", F.lit("none")).alias("committed"), F.concat(F.when(logged, F.array(F.lit(SCOPES[0]))).otherwise(none), now).alias("scopes"),
        current("_staged", "staged").alias("staged"), current("_unstaged", "worktree").alias("unstaged"), told(F.col("_committed"), F.when(logged, FAILED).otherwise(NOT_APPLICABLE)).alias("committed_in_session"),
    )
    return rows.withColumn("binary", any_binary("staged", "unstaged", "committed_in_session"))


def any_binary(*scopes: str) -> Column:
    """True if a scope is binary, else false if one is measured, else null."""
    states = F.array(*[F.col(s)["state"] for s in scopes])
    return F.when(F.array_contains(states, BINARY), True).when(F.array_contains(states, MEASURED), False)


def missing_numstat(changes: DataFrame, by: list[str]) -> DataFrame:
    """Issues, one for each scope of a group that has a failed numstat: by, scope."""
    scopes = F.array(*[F.when(F.col(s)["state"] == FAILED, s) for s in ("staged", "unstaged", "committed_in_session")])
    return changes.select(*by, F.explode(F.array_compact(scopes)).alias("scope")).distinct()


def by_path(changes: DataFrame, path: str = "path") -> DataFrame:
    """Sorted by path without regard to case, then by its spelling."""
    return changes.orderBy(F.lower(path), path)
