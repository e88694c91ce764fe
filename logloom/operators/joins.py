"""As-of, containment and reconciliation joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_latest(left: DataFrame, right: DataFrame, key: list[str], left_order: str, right_order: str, columns: list[str], how: str = "left") -> DataFrame:
    """Each left row with the named columns of the latest right row of its key that precedes it.

    Both sides are shuffled once by key and read in order: a left row takes the last right row
    seen. how: left keeps rows without a match, semi drops them, anti keeps only them.
    """
    payload = F.struct(*[F.col(c).alias(c) for c in columns])
    one = left.select(*key, F.col(left_order).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_found"))
    two = right.select(*key, F.col(right_order).alias("_at"), F.lit(2).alias("_side"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), payload.alias("_found"))
    # at equal places the left row comes first, so that only earlier rows attach
    order = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, -1)
    seen = one.unionByName(two).withColumn("_last", F.last("_found", ignorenulls=True).over(order)).where("_side = 1")
    if how == "anti":
        return seen.where("_last is null").select("_row.*")
    if how == "semi":
        seen = seen.where("_last is not null")
    return seen.select("_row.*", *[F.col("_last")[c].alias(c) for c in columns])


def either_key(left: DataFrame, right: DataFrame, conditions: list[tuple[str, str]], ident: list[str]) -> DataFrame:
    """left joined to right where any of the column pairs is equal, each pair of rows once: one
    equi join a condition instead of one nested loop."""
    parts = [left.join(right, left[a] == right[b]) for a, b in conditions]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(ident)


def reconcile(expected: DataFrame, actual: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """Full join of a manifest with what is there: key, state missing, unexpected, mismatch or
    match."""
    a = expected.select(*[F.col(k) for k in key], F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in compare])
    b = actual.select(*[F.col(k) for k in key], F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in compare])
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(same, "match").otherwise("mismatch")
    return a.join(b, key, "full").select(*key, state.alias("state"))


def overlapping(df: DataFrame, ids: str, allowed: Column) -> DataFrame:
    """Rows whose array of ids meets the allowed ones."""
    return df.where(F.arrays_overlap(F.col(ids), allowed))


def contained(ids: Column, allowed: Column) -> Column:
    """Whether all ids are among the allowed."""
    return F.size(F.array_except(ids, allowed)) == 0


def broken_links(df: DataFrame, ident: str, forward: str, backward: str) -> DataFrame:
    """Rows whose forward link names no row, or one that doesn't link back."""
    other = df.select(F.col(ident).alias("_id"), F.col(backward).alias("_back"))
    return df.where(F.col(forward).isNotNull()).join(other, F.col(forward) == F.col("_id"), "left").where(~F.col(ident).eqNullSafe(F.col("_back"))).select(*df.columns)


def merge_scopes(current: DataFrame, committed: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge of two change lists with array column scopes; scopes in fixed order."""
    a = current.select(*key, F.col("scopes").alias("_a"))
    b = committed.select(*key, F.col("scopes").alias("_b"))
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("_a", none), F.coalesce("_b", none))
    fixed = F.array(*map(F.lit, ("committed_in_session", "staged", "worktree")))
    return a.join(b, key, "full").select(*key, F.filter(fixed, lambda s: F.array_contains(both, s)).alias("scopes"))
