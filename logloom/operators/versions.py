"""Versioned decisions, retention and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.keys import bound, digest, normalized, safe_identifier, sum_of_hex
from logloom.functions.records import strict_text


def supersede_chain(rows: DataFrame, topic: str, choice: list[str], order: list[str], ident: str) -> DataFrame:
    """Versions of a topic: rows that confirm the choice before them merge into its version; a
    change starts another. One row a version: topic, version, the choice, decision_id, n_sources,
    first and last (structs of the order columns), supersedes and superseded_by."""
    w = Window.partitionBy(topic).orderBy(*order)
    meaning = F.struct(*choice)
    fresh = F.when(F.lag(meaning).over(w).isNull() | (F.lag(meaning).over(w) != meaning), 1).otherwise(0)
    rows = rows.withColumn("_new", fresh)
    rows = rows.withColumn("version", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*order)
    versions = rows.groupBy(topic, "version").agg(*[F.first(c).alias(c) for c in choice], F.count("*").alias("n_sources"), F.min(place).alias("first"), F.max(place).alias("last"), F.min_by(ident, place).alias("_first_id"))
    versions = versions.withColumn("decision_id", F.concat(F.lit("decision_"), digest(F.col(topic), F.col("_first_id")))).drop("_first_id")
    w = Window.partitionBy(topic).orderBy("version")
    return versions.withColumn("supersedes", F.lag("decision_id").over(w)).withColumn("superseded_by", F.lead("decision_id").over(w))


def decision_versions(rows: DataFrame, topic: str, choice: list[str], reason: str, order: list[str], ident: str, restored: str | None = None) -> DataFrame:
    """Versions of a topic's decisions with their reasons: a row confirms the version before it if
    it makes the same choice and one of the two has no reason, or both have the same; it then lends
    the version its reason if that had none. Any other row starts a version.

    One row a version: topic, version, the choice, reason, decision_id, n_sources, restored, first
    and last (structs of the order columns), supersedes and superseded_by. restored: a column with
    the decision_id of a version kept from before, null in new rows; such rows must come first in
    their topic, and new ones join or follow them. Windows with running frames hold one row's state.
    """
    w = Window.partitionBy(topic).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    changed = ~F.coalesce(F.struct(*choice).eqNullSafe(F.lag(F.struct(*choice)).over(w)) & F.lag(F.lit(True)).over(w), F.lit(False))
    rows = rows.withColumn("_run", F.sum(changed.cast("int")).over(upto)).withColumn("_reason", F.nullif(normalized(F.col(reason)), F.lit("")))
    # within a run of one choice the last reason given is that of the version that is open
    given = F.last("_reason", ignorenulls=True).over(Window.partitionBy(topic, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(Window.partitionBy(topic, "_run").orderBy(*order)) == 1
    kept = F.col(restored) if restored else F.lit(None).cast("string")
    fresh = first | F.coalesce(F.col("_reason") != given, F.lit(False)) | kept.isNotNull()
    rows = rows.withColumn("_fresh", fresh).withColumn("version", F.sum(F.col("_fresh").cast("long")).over(upto)).withColumn("_kept", kept)
    place = F.struct(*order)
    found = rows.groupBy(topic, "version").agg(
        *[F.min_by(c, place).alias(c) for c in choice], F.min_by(reason, F.when(F.col("_reason").isNotNull(), place)).alias("reason"), F.count("*").alias("n_sources"),
        F.min(place).alias("first"), F.max(place).alias("last"), F.min_by(F.col(ident).cast("string"), place).alias("_first_id"), F.max("_kept").alias("_kept"),
    )
    made = F.concat(F.lit("decision_"), digest(F.col(topic), F.col("_first_id")))
    found = found.withColumn("decision_id", F.coalesce("_kept", made)).withColumn("restored", F.col("_kept").isNotNull()).drop("_first_id", "_kept")
    w = Window.partitionBy(topic).orderBy("version")
    return found.withColumn("supersedes", F.lag("decision_id").over(w)).withColumn("superseded_by", F.lead("decision_id").over(w))


#: What receipts of deliveries and of commits hold.
RECEIPT_KEYS = {"deliveries": ("body_sha256", "relative_json_path", "snapshot_id", "workspace_id"), "commits": ("body_sha256", "snapshot_id", "workspace_id")}


def read_receipts(receipts: DataFrame, kind: str, name: str, body: str) -> DataFrame:
    """Adds workspace, snapshot and issue (null for a good receipt) to rows of a receipt's kind
    (deliveries or commits), file name and body: bad_name unless it is a UUID with .json, bad_json,
    wrong_fields unless it has exactly its kind's fields, as texts, bad_digest, bad_identity,
    bad_path."""
    part = r"[A-Za-z0-9][A-Za-z0-9._-]*"

    def told(v: Column) -> Column:
        names = F.array_sort(F.json_object_keys(F.when(v.isNotNull(), F.col(body))))
        texts = F.struct(*(strict_text(v, f"$.{k}").alias(k) for k in RECEIPT_KEYS["deliveries"]), names.alias("names"), v.isNull().alias("bad"))
        return bound(texts, judged)

    def judged(t: Column) -> Column:
        wanted = F.lit(False)
        for of, fields in RECEIPT_KEYS.items():
            has = F.coalesce(t["names"] == F.array(*map(F.lit, fields)), F.lit(False))
            for field in fields:
                has = has & t[field].isNotNull()
            wanted = F.when(F.col(kind) == of, has).otherwise(wanted)
        path_fine = (F.col(kind) != "deliveries") | F.coalesce(t["relative_json_path"].rlike(rf"^{part}(/{part})*\z") & t["relative_json_path"].endswith(".json"), F.lit(False))
        issue = F.when(~F.coalesce(F.col(name).rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\.json\z"), F.lit(False)), "bad_name").when(t["bad"], "bad_json").when(~wanted, "wrong_fields")
        issue = issue.when(~t["body_sha256"].rlike(r"^[0-9a-f]{64}\z"), "bad_digest").when(~(safe_identifier(t["workspace_id"]) & safe_identifier(t["snapshot_id"])), "bad_identity").when(~path_fine, "bad_path")
        return F.struct(t["workspace_id"].alias("workspace"), t["snapshot_id"].alias("snapshot"), issue.alias("issue"))

    # a generator is a fence: a body is made and parsed once, and no condition on it is moved below it
    kept = [c for c in receipts.columns if c not in ("workspace", "snapshot", "issue")]
    return receipts.select(*kept, F.inline(F.array(bound(F.try_parse_json(F.col(body)), told))))


def receipt_groups(receipts: DataFrame, kind: str, name: str, body: str, at: str, cutoff: Column) -> DataFrame:
    """Per kind, workspace and snapshot of good receipts: n, bytes, fingerprint and latest, and n,
    bytes and fingerprint of those no younger than cutoff (old_...). A fingerprint is the sum modulo
    2**256 of the digests of name, size and body digest, so that receipts may come in any order and
    Spark merges partial sums."""
    size = F.octet_length(body)
    token = F.sha2(F.concat(F.lit('["'), F.col(name), F.lit('",'), size.cast("string"), F.lit(',"'), F.sha2(F.col(body), 256), F.lit('"]')), 256)
    rows = read_receipts(receipts, kind, name, body).where("issue is null").withColumn("_token", token).withColumn("_size", size.cast("long")).withColumn("_old", F.coalesce(F.col(at) <= cutoff, F.lit(False)))
    only = lambda c: F.when(F.col("_old"), F.col(c))
    return rows.groupBy(F.col(kind).alias("kind"), "workspace", "snapshot").agg(
        F.count("*").alias("n"), F.sum("_size").alias("bytes"), sum_of_hex(F.col("_token")).alias("fingerprint"), F.max(at).alias("latest"),
        F.count_if("_old").alias("old_n"), F.coalesce(F.sum(only("_size")), F.lit(0)).alias("old_bytes"), sum_of_hex(only("_token")).alias("old_fingerprint"),
    )


def retention(rows: DataFrame, workspace: str, order: list[Column], current: Column, pending: Column, age_s: Column, least_age_s: int = 3600, keep: int = 2) -> DataFrame:
    """Adds decision candidate or protected and its reason, the first that holds of: current,
    pending, previous_generation (the last `keep` besides the current), retention_age."""
    w = Window.partitionBy(workspace, current).orderBy(*order)
    rows = rows.withColumn("_nth", F.row_number().over(w))
    reason = F.when(current, "current").when(pending, "pending").when(F.col("_nth") <= keep, "previous_generation").when(age_s < least_age_s, "retention_age")
    return rows.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").isNull(), "candidate").otherwise("protected")).drop("_nth")


def multiset_digest(rows: DataFrame, by: list[str], token: Column) -> DataFrame:
    """Per group a digest that doesn't depend on order, and the number of rows: tokens are summed
    as eight 32-bit pieces of their SHA-256, each of which stays exact in a decimal."""
    hashed = F.sha2(token, 256)
    pieces = [F.sum(F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"_{k}") for k in range(8)]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *pieces)
    return sums.select(*by, "n", F.sha2(F.concat_ws(":", *[F.col(f"_{k}").cast("string") for k in range(8)]), 256).alias("digest"))


def within_budget(rows: DataFrame, by: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Of each group the rows, in order, until their summed cost exceeds the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def usable_entries(entries: DataFrame, key: list[str], position: str, now: Column, expires: str = "expires_at") -> DataFrame:
    """The last entry of each key, if it hasn't expired; a null expiry never does."""
    w = Window.partitionBy(*key).orderBy(F.desc(position))
    last = entries.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
    return last.where(F.col(expires).isNull() | (now < F.col(expires)))
