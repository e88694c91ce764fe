"""Decisions with reasons, receipts, chunks."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import chunks, versions
from logloom.operators.publish import encode_json


def plain_versions(rows):
    out, open_ = [], {}
    for topic, choice, reason, at, ident, kept in rows:
        v = open_.get(topic)
        same = v and v["choice"] == choice and (reason is None or v["reason"] is None or " ".join(v["reason"].split()).lower() == " ".join(reason.split()).lower())
        if same and kept is None:
            v["reason"] = v["reason"] or reason
            v["n"] += 1
            continue
        made = kept or "decision_" + hashlib.sha256(f"{topic}\0{ident}".encode()).hexdigest()
        new = {"topic": topic, "choice": choice, "reason": reason, "id": made, "n": 1, "restored": kept is not None, "before": v and v["id"], "after": None}
        if v:
            v["after"] = made
        open_[topic] = new
        out.append(new)
    return sorted((v["topic"], v["id"], v["choice"], v["reason"], v["n"], v["restored"], v["before"], v["after"]) for v in out)


@pytest.mark.parametrize("seed", range(3))
def test_decisions_equal_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [(t, rnd.choice("xy"), rnd.choice([None, "cheap"]), -k, f"h{t}{k}", f"old{t}{k}") for t in "ab" for k in (2, 1)]
    rows += [(rnd.choice("aab"), rnd.choice("xxy"), rnd.choice([None, None, "cheap", " CHEAP ", "fast"]), k, f"m{k}", None) for k in range(80)]
    df = spark.createDataFrame(rows, "topic string, choice string, reason string, at int, ident string, kept string").repartition(4)
    out = versions.decision_versions(df, "topic", ["choice"], "reason", ["at"], "ident", "kept").collect()
    assert sorted((r.topic, r.decision_id, r.choice, r.reason, r.n_sources, r.restored, r.supersedes, r.superseded_by) for r in out) == plain_versions(sorted(rows, key=lambda r: r[3]))


def receipt(**fields):
    return json.dumps({"workspace_id": "w", "snapshot_id": "s", "body_sha256": "0" * 64} | fields)


def test_receipts_are_checked(spark):
    name = "0f8fad5b-d9cb-469f-a165-70867728950e.json"
    path = {"relative_json_path": "a/b.json"}
    cases = [
        ("commits", name, receipt(), None), ("deliveries", name, receipt(**path), None), ("commits", name[:-5], receipt(), "bad_name"), ("commits", name.upper(), receipt(), "bad_name"), ("commits", None, receipt(), "bad_name"),
        ("commits", name, "{", "bad_json"), ("commits", name, None, "bad_json"), ("commits", name, "[]", "wrong_fields"), ("commits", name, receipt(**path), "wrong_fields"), ("deliveries", name, receipt(), "wrong_fields"), ("other", name, receipt(), "wrong_fields"),
        ("commits", name, receipt(workspace_id=1), "wrong_fields"), ("commits", name, receipt(body_sha256="x"), "bad_digest"), ("commits", name, receipt(snapshot_id="../s"), "bad_identity"),
        *(("deliveries", name, receipt(relative_json_path=p), "bad_path") for p in ("../a.json", "/a.json", "a//b.json", "a.txt", "a/.b.json", "a.json\n")),
    ]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, kind string, name string, body string, want string")
    got = versions.read_receipts(df, "kind", "name", "body").orderBy("k").collect()
    assert [r.issue for r in got] == [r.want for r in got]


def test_receipt_sums_equal_integers(spark):
    rnd = random.Random(2)
    rows = [("commits", "%08x-0000-4000-8000-%012x.json" % (rnd.getrandbits(32), k), receipt(snapshot_id=rnd.choice("st")), rnd.randrange(10)) for k in range(300)]
    df = spark.createDataFrame(rows, "kind string, name string, body string, at int").repartition(5)
    got = {r.snapshot: r for r in versions.receipt_groups(df, "kind", "name", "body", "at", F.lit(4)).collect()}
    for snapshot in "st":
        mine = [r for r in rows if json.loads(r[2])["snapshot_id"] == snapshot]
        token = lambda r: int(hashlib.sha256(json.dumps([r[1], len(r[2]), hashlib.sha256(r[2].encode()).hexdigest()], separators=(",", ":")).encode()).hexdigest(), 16)
        old = [r for r in mine if r[3] <= 4]
        assert (got[snapshot].n, got[snapshot].bytes, got[snapshot].fingerprint, got[snapshot].latest) == (len(mine), sum(len(r[2]) for r in mine), f"{sum(map(token, mine)) % (1 << 256):064x}", max(r[3] for r in mine))
        assert (got[snapshot].old_n, got[snapshot].old_bytes, got[snapshot].old_fingerprint) == (len(old), sum(len(r[2]) for r in old), f"{sum(map(token, old)) % (1 << 256):064x}")


def test_receipts_are_dealt_out_and_parsed_once(spark, tmp_path):
    from logloom.plans import commits

    rows = spark.range(1000).selectExpr("id o_orderkey", "id o_custkey", "timestamp'1996-01-01' o_orderdate", "'1-URGENT' o_orderpriority")
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    before, commits.RECEIPTS_A_TASK = getattr(commits, "RECEIPTS_A_TASK", 0), 100
    try:
        plan = commits.receipt_groups(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        commits.RECEIPTS_A_TASK = before
    assert plan.lower().count("parse_json(") + plan.lower().count("parsejson(") <= 1 and "RepartitionByExpression [o_orderkey" in plan and ", 11" in plan


CONTEXT = {"workspace_id": "w", "snapshot_id": "s", "generated_at": "now"}


def plain_chunks(message, blocks, most):
    """Grows every part character by character and measures whole documents."""
    size = lambda part, parts, held: len(encode_json(chunks.chunk_document(CONTEXT, message, part, parts, held)).encode())
    parts = 1
    while True:
        out, held = [], []
        for block in blocks:
            rest = block["text"]
            while True:
                if size(len(out) + 1, parts, [*held, block | {"text": rest}]) <= most:
                    held.append(block | {"text": rest})
                    break
                if held:
                    out.append(held)
                    held = []
                    continue
                n = 0
                while n < len(rest) and size(len(out) + 1, parts, [block | {"text": rest[: n + 1]}]) <= most:
                    n += 1
                out.append([block | {"text": rest[:n]}])
                rest = rest[n:]
                if not rest:
                    break
        if held:
            out.append(held)
        if len(out) == parts:
            return out
        parts = len(out)


@pytest.mark.parametrize("parts", [1, 2, 9, 10, 11, 99, 100, 101])
def test_chunks_equal_brute_force(parts):
    rnd = random.Random(parts)
    letters = "ab\n\"\\\t\x01é漢😀"
    empty = len(encode_json(chunks.chunk_document(CONTEXT, "m", 1, 1, [{"kind": "code", "language": "py", "text": ""}])).encode())
    most, met = empty + 24, set()
    for n in range(max(1, parts * 8 - 60), parts * 8 + 60, 11 if parts < 50 else 23):
        text = "".join(rnd.choice(letters) for _ in range(n))
        cut = sorted(rnd.randrange(n + 1) for _ in range(3))
        blocks = [{"kind": rnd.choice(["text", "code"]), "language": rnd.choice([None, "py"]), "text": t} for t in (text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] :])]
        got = chunks.chunk_documents(CONTEXT, "m", blocks, most)
        assert [d["content"]["blocks"] for d in got] == plain_chunks("m", blocks, most)
        assert all(len(encode_json(d).encode()) <= most and d["parts"] == len(got) and d["part"] == k for k, d in enumerate(got, 1))
        met.add(len(got))
    assert len(met) > 1
    with pytest.raises(ValueError):
        chunks.chunk_documents(CONTEXT, "m", [{"kind": "text", "language": None, "text": "x"}], empty - 20)


def test_chunks_of_messages(spark):
    rows = [(1, [("text", None, "x" * 300_000), ("code", "py", "é" * 200_000)], "m1"), (2, [], "m2"), (3, None, "m3"), (4, [("text", None, None)], "m4")]
    df = spark.createDataFrame(rows, f"id int, blocks {chunks.BLOCKS}, stem string")
    got = chunks.chunked_messages(df, "id", "blocks", CONTEXT, "stem").orderBy("id", "part").collect()
    assert [(r.id, r.part, r.parts) for r in got] == [(1, 1, 4), (1, 2, 4), (1, 3, 4), (1, 4, 4), (4, 1, 1)]  # the first block's rest has no room for the second
    assert all(r.bytes <= 262_144 and r.sha256 == hashlib.sha256(r.body.encode()).hexdigest() for r in got) and got[0].path == "messages/chunks/m1-part-000001.json"
    blocks = [b for r in got if r.id == 1 for b in json.loads(r.body)["content"]["blocks"]]
    assert "".join(b["text"] for b in blocks) == "x" * 300_000 + "é" * 200_000
