"""Keyed state over streams: identities of records, and the turns of sessions.

Both take rows in any cut into micro-batches and give what the batch operators give on all of
them, without joining what came before: the state of a key goes from batch to batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.functions.keys import digest
from logloom.operators.turns import TURNS, TurnFold


def stream_identities(rows: DataFrame, session: str, native_id: str, fingerprint: str, path: str, offset: str, at: str, types: tuple[str, ...] = (), carry: str | None = None) -> DataFrame:
    """session, path, offset, fingerprint, identity, duplicate, conflict of each row of a stream, as
    operators.dedup.dedup_records gives them in the order (at, path, offset); and the text column
    carry as it came.

    The key is finer than a session, so a large session is spread: a native id's state is the
    fingerprint first seen, that of a fingerprint without an id are the places where it stood. A
    row that comes again from its place, as after a replay, is a duplicate. Batches must keep the
    order of a key's rows.
    """
    native = F.nullif(F.col(native_id).cast("string"), F.lit(""))
    key = F.when(native.isNotNull(), digest(F.lit("native"), F.col(session), *map(F.col, types), native)).otherwise(digest(F.lit("fallback"), F.col(session), F.col(fingerprint)))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (session, path, offset)}
    keyed = rows.select(key.alias("key"), native.isNotNull().alias("native"), F.col(session).alias("session"), F.col(path).alias("path"), F.col(offset).alias("offset"), F.col(fingerprint).cast("string").alias("fingerprint"), F.col(at).alias("at"), (F.lit(None) if carry is None else F.col(carry)).cast("string").alias("carry"))
    out = f"session {kinds[session]}, path {kinds[path]}, offset {kinds[offset]}, fingerprint string, key string, native boolean, occurrence long, duplicate boolean, conflict boolean, carry string"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, places = json.loads(state.get[0]) if state.exists else (None, [])
        seen = {tuple(p) for p in places}
        table = pd.concat(list(frames)).sort_values(["at", "path", "offset"], na_position="first", kind="stable")
        found = []
        for r in table.itertuples(index=False):
            if r.native:
                found.append((0, first is not None, first is not None and r.fingerprint != first))
                first = r.fingerprint if first is None else first
            else:
                place = (r.path, int(r.offset))
                again = place in seen
                seen.add(place)
                found.append((len(seen), again, False))
        state.update((json.dumps([first, sorted(seen)]),))
        table["occurrence"], table["duplicate"], table["conflict"] = zip(*found, strict=True)
        table["key"] = key[0]
        yield table[["session", "path", "offset", "fingerprint", "key", "native", "occurrence", "duplicate", "conflict", "carry"]]

    judged = keyed.groupBy("key").applyInPandasWithState(run, out, "seen string", "append", GroupStateTimeout.NoTimeout)
    identity = F.when(F.col("native"), F.col("key")).otherwise(digest(F.lit("fallback"), F.col("session"), F.col("fingerprint"), F.col("occurrence")))
    return judged.select(F.col("session").alias(session), F.col("path").alias(path), F.col("offset").alias(offset), F.col("fingerprint").alias(fingerprint), identity.alias("identity"), "duplicate", "conflict", *([] if carry is None else [F.col("carry").alias(carry)]))


def stream_turns(events: DataFrame, session: str, order: list[str], turn_id: str, kind: str, count: str | None = None, reason: str | None = None) -> DataFrame:
    """The turns that each micro-batch changes, session and TURNS, as operators.turns.turns_by_id
    gives them for all rows so far: a sink that upserts by session and turn_id holds its result.

    A session's state are its turns, not its events; start_at and end_at count the session's turn
    events. Batches must keep the order of a session's rows; within one they are sorted.
    """
    from pyspark.sql.types import StructType

    kind_of = events.schema[session].dataType.simpleString()
    ident = F.coalesce(F.col(turn_id).cast("string"), F.concat(F.lit("turn_"), F.sha2(F.concat_ws("\0", F.col(session).cast("string"), *(F.col(c).cast("string") for c in order)), 256)))
    none = F.lit(None)
    used = events.where(F.col(kind).isin("start", "complete", "abort", "rollback")).select(
        F.col(session).alias("session"), ident.alias("id"), F.col(kind).alias("kind"), (none if count is None else F.col(count)).cast("long").alias("count"),
        (none if reason is None else F.col(reason)).cast("string").alias("reason"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)),
    )
    names = StructType.fromDDL(TURNS).names

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns, open_, n = json.loads(state.get[0]) if state.exists else ({}, None, 0)
        fold, changed = TurnFold(turns, open_), {}
        table = pd.concat(list(frames)).sort_values([f"o{k}" for k in range(len(order))], na_position="first", kind="stable")
        for r in table.itertuples(index=False):
            n += 1
            rolled = None if pd.isna(r.count) else int(r.count)
            changed |= dict.fromkeys(fold.apply(r.kind, r.id, n, rolled, None if pd.isna(r.reason) else r.reason))
        state.update((json.dumps([fold.turns, fold.open, n]),))
        if changed:
            out = pd.DataFrame([{"session": key[0], "turn_id": t, **fold.turns[t]} for t in changed])
            out["end_at"] = out["end_at"].astype("Int64")
            yield out[["session", *names]]

    turns = used.groupBy("session").applyInPandasWithState(run, f"session {kind_of}, {TURNS}", "turns string", "update", GroupStateTimeout.NoTimeout)
    return turns.withColumnRenamed("session", session)
