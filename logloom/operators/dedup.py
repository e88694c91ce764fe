"""Deduplication, multiset and upsert operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.keys import digest


def number_occurrences(df: DataFrame, key: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """1, 2, ... among rows of an equal key (nulls are equal), in the order given."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def dedup_records(df: DataFrame, session: str, native_id: str | None, fingerprint: str, physical: list[str], order: list[Column], types: tuple[str, ...] = ()) -> DataFrame:
    """Adds identity, duplicate (a row of this identity came before) and conflict (so it did, with
    another fingerprint).

    A row with a native id (an empty one is none) is that id's among the rows of its types; one
    without is the n-th of its fingerprint in the session, where rows at one physical place count
    once. Intended repeats so stay apart, while a
    replay from the start finds every identity again.
    """
    native = F.nullif(F.col(native_id).cast("string"), F.lit("")) if native_id else F.lit(None).cast("string")
    place = Window.partitionBy(session, fingerprint, native.isNull(), *physical).orderBy(*order)
    marked = df.withColumn("_again", native.isNull() & (F.row_number().over(place) > 1))
    count = F.sum(F.when(~F.col("_again"), 1).otherwise(0)).over(Window.partitionBy(session, fingerprint, native.isNull()).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    identity = F.when(native.isNotNull(), digest(F.lit("native"), F.col(session), *map(F.col, types), native)).otherwise(digest(F.lit("fallback"), F.col(session), F.col(fingerprint), count))
    same = Window.partitionBy("identity").orderBy(*order)
    out = marked.withColumn("identity", identity).withColumn("duplicate", F.row_number().over(same) > 1)
    return out.withColumn("conflict", F.col(fingerprint) != F.first(fingerprint).over(same)).drop("_again")


def new_identities(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a deduplicated batch whose identity the state table lacks."""
    return batch.where("not duplicate").join(known.select("identity"), "identity", "left_anti")


def merge_counts(old: DataFrame, new: DataFrame, key: list[str], count: str = "count") -> DataFrame:
    """State after a replay: the larger count of each key."""
    return old.select(*key, count).union(new.select(*key, count)).groupBy(*key).agg(F.max(count).alias(count))


def multiset_except(left: DataFrame, right: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """EXCEPT ALL that keeps left's other columns: of n equal keys in right the first n in left go."""
    counts = right.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count("*").alias("_n"))
    numbered = number_occurrences(left, key, order, "_nth")
    on = [numbered[k].eqNullSafe(counts[f"_{k}"]) for k in key]
    kept = numbered.join(counts, on, "left").where(F.col("_nth") > F.coalesce("_n", F.lit(0)))
    return kept.select(*left.columns)


def reference_repeats(df: DataFrame, key: list[str], order: list[Column], ident: str) -> DataFrame:
    """Adds duplicate_of (the first row's id, null for the first) and occurrence_count (for the
    first, of all; else null)."""
    ordered = Window.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(ordered) == 1
    total = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("duplicate_of", F.when(~first, F.first(ident).over(ordered))).withColumn("occurrence_count", F.when(first, total))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; new ones win."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key."""
    return number_occurrences(df, key, order, "_nth").where("_nth = 1").drop("_nth")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row, equal: whether both hold the same rows, as often."""
    apart = left.exceptAll(right).limit(1).unionAll(right.exceptAll(left).limit(1))
    return apart.agg((F.count("*") == 0).alias("equal"))
