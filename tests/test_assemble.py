"""Whole snapshots."""

import json
import random

from pyspark.sql import functions as F

from logloom.operators import assemble, chunks, documents


def test_every_link_of_a_snapshot_resolves(spark, tmp_path):
    rnd = random.Random(1)
    by = ["workspace_id", "snapshot_id"]
    texts = {("w1", k): [("text", None, rnd.choice("aé\n\"") * rnd.choice([3, 40, 700, 5000])), ("code", "py", None)] for k in range(1, 41)} | {("w2", 1): [], ("w2", 2): None}
    messages = spark.createDataFrame([(w, "s", f"m/{k}", k, "user", None, "now", b) for (w, k), b in texts.items()], f"workspace_id string, snapshot_id string, message_id string, sequence int, role string, phase string, generated_at string, blocks {chunks.BLOCKS}").repartition(5)
    summaries = spark.createDataFrame([("w1", "s", k, f"t{k}", "x" * 900) for k in range(1, 12)], "workspace_id string, snapshot_id string, sequence int, turn_id string, summary string")
    errors = spark.createDataFrame([("w1", "s", 2, "later"), ("w1", "s", 1, None)], "workspace_id string, snapshot_id string, sequence int, what string")
    built = assemble.build_snapshot(messages, summaries, {"errors": errors}, by, most_chunk=2000, most_items=7, most_bytes=ASSEMBLED)
    built.write.parquet(str(tmp_path / "built"))
    whole = assemble.with_manifest(spark.read.parquet(str(tmp_path / "built")), by)
    whole.write.parquet(str(tmp_path / "whole"))
    stored = spark.read.parquet(str(tmp_path / "whole"))
    assert assemble.snapshot_faults(stored, by).collect() == []
    bodies = {(r.workspace_id, r.path): r.body for r in stored.collect()}
    read = {k: json.loads(b) for k, b in bodies.items()}
    for (w, path), document in read.items():
        if path.startswith("messages/chunks/"):
            assert len(bodies[w, path].encode()) <= 2000
        elif "/pages/" in path:
            assert len(document["items"]) == 1 or len(document["items"]) <= 7 and len(bodies[w, path].encode()) <= ASSEMBLED
    # messages read back in order from index, pages and chunks
    for w in ("w1", "w2"):
        got = {}
        for page in read[w, "messages.json"]["pages"]:
            for item in read[w, page["path"]]["items"]:
                content = item["content"]
                parts = content["blocks"] if content["kind"] == "blocks" else [b for c in content["chunks"] for b in read[w, c["path"]]["content"]["blocks"]]
                got[item["sequence"]] = "".join(b["text"] for b in parts)
                assert item["phase"] is None and item["message_id"] == f"m/{item['sequence']}"
        want = {k: "".join(t or "" for _, _, t in b or []) for (v, k), b in texts.items() if v == w}
        assert got == want and list(got) == sorted(want)
    assert [r["what"] for r in read["w1", "errors.json"]["items"]] == [None, "later"] and read["w2", "errors.json"]["items"] == []
    assert sum(p["items"] for p in read["w1", "messages.json"]["summary_pages"]) == 11 and read["w2", "messages.json"]["summary_pages"] == []
    # one document gone, one changed, one put in
    page, chunk = "messages/pages/page-000002.json", next(p for w, p in read if p.startswith("messages/chunks/"))
    broken = stored.where(~((F.col("workspace_id") == "w1") & (F.col("path") == page))).withColumn("body", F.when(F.col("path") == chunk, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    broken = broken.unionByName(stored.where(f"path = '{documents.LAST}'").withColumn("path", F.lit("extra.json")))
    faults = sorted((r.workspace_id, r.path, r.fault, r.source) for r in assemble.snapshot_faults(broken, by).collect())
    assert ("w1", page, "missing", documents.LAST) in faults and ("w1", page, "missing", "messages.json") in faults and ("w2", "extra.json", "unlisted", documents.LAST) in faults
    assert {f[2] for f in faults if f[1] == chunk} == {"changed"} and {f[3] for f in faults if f[1] == chunk} >= {documents.LAST}
    assert {f[1] for f in faults} == {page, chunk, "extra.json"}


ASSEMBLED = 12_000


def test_no_message_is_no_snapshot(spark):
    messages = spark.createDataFrame([], f"workspace_id string, message_id string, sequence int, blocks {chunks.BLOCKS}")
    none = spark.createDataFrame([], "workspace_id string, sequence int, summary string")
    assert assemble.with_manifest(assemble.build_snapshot(messages, none, {"errors": none}, ["workspace_id"]), ["workspace_id"]).collect() == []


def test_batches_of_a_snapshot_are_bounded(spark, sf, monkeypatch):
    """What goes to Python at once is bounded by bytes, and what comes back is not made in Python again."""
    from logloom.functions import storage
    from logloom.plans import commits, registry

    bounds = []
    for name in ("build_snapshot", "with_manifest"):
        monkeypatch.setattr(assemble, name, lambda *a, f=getattr(assemble, name), **k: bounds.append(name) or f(*a, **k))
    out = registry.QUERIES["snapshot_build"](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(bounds) == 2 and "Python" not in plan and "InArrow" not in plan
    before = spark.conf.get(storage.ARROW_BYTES, None)
    with storage.small_batches(spark):
        sizes = spark.range(64).coalesce(1).select(F.repeat(F.lit("x"), 500_000).alias("t")).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "t string").count()
    assert sizes >= 6 and spark.conf.get(storage.ARROW_BYTES, None) == before
    assert commits.materialise is storage.materialise
