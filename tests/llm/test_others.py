"""URL filter, mixing, media, neighbours, toxicity, language model."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import ann, lm, media, mixing, toxicity, url_filter
from logloom.llm.queries import ORACLES, QUERIES, URL_RULES


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(name, spark, sf):
    from tests.test_queries import TABLES, comparable
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, sql = QUERIES[name](spark, sf), con.execute(ORACLES[name])
    names = [c[0] for c in sql.description]
    assert comparable(got.collect(), got.columns) == comparable(sql.fetchall(), names)


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def test_url_rules_equal_brute_force(spark):
    urls = ["http://a.COM/en/7", "https://example.com/en/7x?q#f", "x://sub.example.net/de/8", "x://example.net/de/9", "x://net/de/", "x://org", "x://notorg/es/1", "a.com/en/", None, "", "://", "x://com/en", "x://com./en/", "x://b.org/es/?u=://c.com/en/", "x://b.org/es/?u=://c.com/en/"]
    pages = spark.createDataFrame([(k, u, "k") for k, u in enumerate(urls)], "page_id long, url string, keys string")
    out = url_filter.filter_urls(pages, URL_RULES)
    assert out.columns == ["page_id", "url", "keys", "host", "path", "rule", "verdict"]
    for r in out.collect():
        fitting = [x for x in URL_RULES if fits(x, r.host, r.path)]
        best = max(fitting, key=lambda x: len(x.key), default=None)
        assert (r.rule, r.verdict) == ((best.key, best.action) if best else (None, "allow"))
        if "://" not in (r.url or ""):
            assert (r.host, r.path) == ("", "")
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_url_verdicts_are_the_contract_s(spark, tmp_path):
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://x.example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://x.EXAMPLE.net/de/8": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block"), "http://a.net/fr/8": (None, "allow"), "a.com/en/1": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in QUERIES["op6_url_filter"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(len(want))] == list(want.values())


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("substring(key, 2) % 7 = 0")
    cascade = url_filter.build_cascade(listed, universe, 4000)
    assert len(cascade.levels) > 1
    judged = universe.select("key", cascade.contains(F.col("key")).alias("member"))
    assert {r.key for r in judged.where("member").collect()} == {r.key for r in listed.collect()}


def test_mixing_meets_the_weights(spark, odd_docs, no_docs):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 5000, "big").otherwise("small").alias("source"))
    out = mixing.mix_sources(docs, weights={"big": 0.25, "small": 0.75}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n["big"] - 1500) < 200 and abs(n["small"] - 4500) < 300
    high = mixing.mix_sources(docs.where("doc_id < 3"), epochs=40.0).count()
    assert 80 < high < 160
    rows = mixing.mix_sources(odd_docs, alpha=1.0, epochs=3.0)
    again = mixing.mix_sources(odd_docs.repartition(5), alpha=1.0, epochs=3.0)
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect())) and rows.count() > 10
    assert mixing.mix_sources(no_docs).count() == 0


def test_media_round_trip(spark, odd_docs, odd_rows, no_docs):
    rows = media.media_columns(odd_docs).collect()
    want = []
    for r in odd_rows:
        b = (r[1] or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        want.append((str(r[0]), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), 192, len(p) // 192))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.width, r.height) for r in rows) == sorted(want)
    assert all(r.digest == r.payload_sha256 and r.length == r.media_bytes for r in rows)
    same = {(r.shard, r.offset) for r in rows if r.doc_id in (1, 6)}
    assert len(same) == 1
    first = rows[0]
    stored = media.ShardReader().read(first.shard, first.offset, first.length)
    assert hashlib.sha256(stored).hexdigest() == first.media_sha256
    assert media.media_columns(no_docs).count() == 0


def test_shards_are_tar_files(spark, odd_docs):
    import tarfile

    shard = media.media_columns(odd_docs).first().shard
    with tarfile.open(shard.removeprefix("file://").removeprefix("file:")) as tar:
        for member in tar:
            payload = media.decode_png(tar.extractfile(member).read())
            assert hashlib.sha256(payload).hexdigest() + ".png" == member.name


def test_graph_recall():
    rnd = np.random.default_rng(1)
    data = rnd.normal(size=(2000, 24)) * rnd.uniform(0.5, 2, size=(2000, 1))
    graph = ann.build_graph(data, np.arange(2000))
    queries = data[::20]
    hit = sum(len(set(np.argsort(-(data @ q))[:20]) & set(f.tolist())) for q, f in zip(queries, graph.search(queries), strict=True))
    assert hit / (20 * len(queries)) >= 0.9


def test_neighbours_with_odd_vectors(spark):
    rows = [(k, [float(k % 5 + 1), 1.0]) for k in range(50)] + [(60, None), (80, [0.0, 0.0]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, [1.0]), (None, [1.0, 2.0]), (160, [None, 1.0]), (20, [1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 3, 0.1) for i, v in rows], "vec_id long, embedding array<float>, `rank` int, score double")
    out = ann.nearest(table, k=4).orderBy("query_id", "rank").collect()
    fine = rows[:50]
    for q, v in ((0, [1.0, 1.0]), (20, [1.0, 1.0]), (40, [1.0, 1.0])):
        want = sorted(((-(v[0] * x[0] + v[1] * x[1]), i) for i, x in fine if i != q))[:4]
        assert [(r.vec_id, r.score) for r in out if r.query_id == q] == [(i, -s) for s, i in want]
    assert {r.query_id for r in out} == {0, 20, 40}
    few = ann.nearest(table.where("vec_id < 3"), k=20).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [2, 1]
    assert ann.nearest(table.limit(0)).count() == 0


def test_toxicity_learns_held_out_labels(spark, odd_docs, no_docs):
    rnd = np.random.default_rng(2)
    words = ["".join(rnd.choice(list("aeioumnprst"), 5)) for _ in range(200)]
    rows = [(k, " ".join(rnd.choice(words, 40)) + (" Zqxvile " if k % 3 == 0 else " ") + " ".join(rnd.choice(words, 20))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_on(docs, labels)
    out = toxicity.score_texts(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 3 == 0) == int(r.score >= 0.3) for r in out)
    assert {r.doc_id for r in out if r.held_out} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert toxicity.drop_toxic(docs, model).count() == sum(k % 3 != 0 for k in range(400))
    odd = toxicity.score_texts(odd_docs, model).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd) and len({r.score for r in odd if r.doc_id in (2, 3)}) == 1
    assert toxicity.drop_toxic(odd_docs, model).columns == odd_docs.columns
    none = toxicity.train_on(no_docs, labels)
    assert toxicity.score_texts(no_docs, none).count() == 0
    assert {r.predicted for r in toxicity.score_texts(odd_docs, none).collect()} == {0}


def test_language_model_base_scores(spark, odd_docs, odd_rows, no_docs):
    out = lm.score_texts(odd_docs).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(w for r in odd_rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = []
    for r in odd_rows:
        t = tokens(r[1])
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want.append((str(r[0]), held(r[0]), len(t), sum(count[w] > 0 for w in t), n, f"{base:.8g}"))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.8g}") for r in out) == sorted(want)
    assert all(r.score < 0 for r in out)
    assert lm.score_texts(no_docs).count() == 0


def test_bit_predictions_make_a_distribution():
    """The probabilities of all bytes that can follow a text sum to one."""
    tables = [np.random.default_rng(k).integers(0, 9, (1 << lm.ROW_BITS, 16)) for k in range(len(lm.ORDERS))]
    model = lm.Model([lm.logits(t).tobytes() for t in tables])
    for start in (b"", b"the c", b"Zo\xc3"):
        cases = [start + bytes([b]) for b in range(256)]
        first = model._score([start])[0] if start else 0.0
        codes = [10.0 ** (model._score([c])[0] - first) for c in cases]
        # what is missing are the code words of common bytes behind an escape, which no text uses
        assert 0 <= 1 - sum(codes) < 1


def test_language_model_prefers_what_it_has_seen(spark):
    rows = [(k, "the quick brown fox jumps over the lazy dog " * 3) for k in range(60)] + [(1000, "xkqz wvvj qqpt zzxk")]
    out = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = next(k for k in range(60) if zlib.crc32(str(k).encode()) % 10 == 0)
    assert out[held].bits_per_byte < 1 < out[1000].bits_per_byte
    assert out[held].score == out[held + 1].score


def copied_docs(spark):
    """17 MB of random letters, in which a held-out text is a copy of a learnt one."""
    rnd = np.random.default_rng(5)
    rows = [(k, rnd.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8), 50_000).tobytes().decode()) for k in range(1, 390)]
    held = next(k for k in range(1, 390) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows[held - 1] = (held, rows[held][1])
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), held


def test_contexts_stay_apart_in_much_text(spark):
    """The rows of long contexts grow with the training text: a copy is known among random letters."""
    docs, held = copied_docs(spark)
    out = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    others = [r.bits_per_byte for r in out.values() if r.held_out and r.doc_id != held]
    assert len(out) == 389 and min(others) > 4
    assert out[held].bits_per_byte < 3 and out[held].score == out[held + 1].score


def test_bucketed_contexts_equal_broadcast_ones(spark, monkeypatch, odd_docs):
    columns = ["doc_id", "text"]
    docs = odd_docs.select(*columns).union(spark.createDataFrame([(k, f"the {k % 7} brown fox jumps over é the lazy dog " * (k % 5)) for k in range(20, 60)], odd_docs.select(*columns).schema))
    key = lambda r: (str(r.doc_id), r.held_out, r.n_tokens, f"{r.score:.6g}", f"{r.base_score:.8g}", f"{r.bits_per_byte:.6g}")
    want = sorted(map(key, lm.score_texts(docs).collect()))
    for name, value in (("BUCKET_BYTES", 40_000), ("WIDE_CHUNK", 2_000)):
        monkeypatch.setattr(lm, name, value)
    assert sorted(map(key, lm.score_texts(docs).collect())) == want


def test_distinct_cells():
    for most in (50, 1 << 60):
        cells = np.random.default_rng(1).integers(0, most, 1000)
        found, place = lm.distinct(cells)
        assert (found == np.unique(cells)).all() and (found[place] == cells).all()
    assert (lm._unpack(lm._pack(found)) == found).all()


def test_weights_last_through_a_text():
    """What is learnt early in a text helps later: its second half costs less in one pass than alone."""
    tables = [np.zeros((1 << lm.ROW_BITS, 16), int) for _ in lm.ORDERS]
    model = lm.Model([lm.logits(t).tobytes() for t in tables])
    nibble = np.tile(np.arange(4, dtype=np.uint8), 1024)
    # the first predictor is right and the second wrong, each time
    right = np.where(np.arange(16)[:, None] >> np.array([3, 2, 1, 0]) & 1, 20, -20).astype(np.int8).view(np.uint32).reshape(-1)
    wrong = np.where(np.arange(16)[:, None] >> np.array([3, 2, 1, 0]) & 1, -20, 20).astype(np.int8).view(np.uint32).reshape(-1)
    model._paths = [right, wrong, np.zeros(16, np.uint32), np.zeros(16, np.uint32)]
    text = bytes(lm.COMMON[n] for n in nibble)

    def cost(size):
        model_cells = lm.nibbles
        try:
            lm.nibbles = lambda texts, bits=lm.ROW_BITS: (*[(f := model_cells(texts, bits))[0]], [f[0].astype(np.int64)] * 4, f[2])
            return -model._score([text[:size]])[0]
        finally:
            lm.nibbles = model_cells

    assert cost(4096) - cost(2048) < 0.7 * cost(2048)


def plain_score(model, text):
    """A text's log10 probability, bit by bit in plain Python."""
    nibble, cells, _ = lm.nibbles([text])
    tables = [np.frombuffer(t, np.int8).reshape(-1, 16) for t in model.tables]
    weight = [[lm.START] * len(tables) for _ in range(4)]
    edges = [1 / (1 + math.exp(-x)) for x in np.linspace(-8, 8, lm._MAP_BINS)]
    refined = [list(edges) for _ in range(4)]
    total = 0.0
    for at, n in enumerate(nibble.tolist()):
        rows = [t[int(c[at]) >> 4] for t, c in zip(tables, cells)]
        for place in range(4):
            node, bit = (1 << place) + (n >> (4 - place)), n >> (3 - place) & 1
            x = [int(r[node]) / lm.STEPS for r in rows]
            dot = min(8.0, max(-8.0, sum(w * v for w, v in zip(weight[place], x))))
            p = 1 / (1 + math.exp(-dot))
            cell = math.floor(dot * (lm._MAP_BINS - 1) / 16) + lm._MAP_BINS // 2
            q = refined[place][cell]
            refined[place][cell] += lm.MAP_RATE * (bit - q)
            mixed = p + lm.MAP_SHARE * (q - p)
            total += math.log(mixed if bit else 1 - mixed)
            weight[place] = [w - lm.RATE * (p - bit) * v for w, v in zip(weight[place], x)]
    return total / math.log(10)


@pytest.mark.parametrize("size", [0, 1, 700, 20_000])
def test_scores_equal_a_plain_loop(size):
    """Alone, among others of all lengths, and over many windows."""
    rnd = np.random.default_rng(size)
    tables = [lm.logits(np.random.default_rng(k).integers(0, 9, (1 << lm.ROW_BITS, 16))).tobytes() for k in range(len(lm.ORDERS))]
    letters = np.frombuffer("the quick brown fox Zé9 ".encode(), np.uint8)
    text = lm.stream(rnd.choice(letters, size).tobytes())
    want = plain_score(lm.Model(tables), text)
    model = lm.Model(tables)
    others = [lm.stream(rnd.choice(letters, n).tobytes()) for n in (0, 5, 3000, 9000, *rnd.integers(0, 2000, 1500))]
    alone, among = model._score([text])[0], model._score([*others, text, text])[-2:]
    assert alone == among[0] == among[1] and alone == pytest.approx(want, rel=1e-4)


def test_lookups():
    rnd = np.random.default_rng(3)
    for most in (1000, 1 << 40):
        cells = np.unique(rnd.integers(0, most, 500))
        values = rnd.integers(0, 1 << 32, len(cells)).astype(np.uint32)
        asked = rnd.choice(cells, 3000)
        assert (lm.looked_up(cells, values)(asked) == values[np.searchsorted(cells, asked)]).all()
    keys = np.unique(np.append(rnd.integers(0, (1 << 63) - 1, 5000), 0))
    asked = rnd.choice(keys, 20_000)
    assert (lm.probed(keys, keys)(asked) == asked).all() and (lm.probed(keys[:1], keys[:1])(asked[:0]) == asked[:0]).all()
    with pytest.raises(KeyError):
        lm.probed(keys, keys)(np.array([keys[-1] + 1]))


def test_token_keys_name_tokens():
    streams = [lm.stream(t.encode()) for t in ("a b a", "", "é long" + "x" * 200 + " b")]
    keys, size = lm.token_keys(streams)
    names = [w for s in streams for w in s.split(b" ")]
    assert size.tolist() == [4, 1, 4] and len(keys) == len(names)
    assert len(set(zip(keys.tolist(), names))) == len(set(keys.tolist())) == len(set(names)) and all((k == 0) == (n == lm.END) for k, n in zip(keys.tolist(), names))


def test_repeated_query_ids_are_answered_each(spark):
    rows = [(k, [float(k % 7), float(k % 5) + 1]) for k in range(1, 40)] + [(20, [-3.0, 1.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=4).where("query_id = 20").collect()
    assert sorted(r["rank"] for r in out) == sorted([1, 2, 3, 4] * 2)
    found = sorted((r.vec_id, r.score) for r in out)
    want = []
    for q in (rows[19][1], rows[-1][1]):
        want += sorted(((q[0] * x[0] + q[1] * x[1], -i) for i, x in rows if i != 20), reverse=True)[:4]
    assert found == sorted((-i, s) for s, i in want)


def test_recall_over_shards_and_blocks(spark, monkeypatch):
    """Four shards and three blocks of queries against brute force."""
    monkeypatch.setattr(ann, "SHARD", 500)
    monkeypatch.setattr(ann, "QUERIES", 40)
    rnd = np.random.default_rng(4)
    data = (rnd.normal(size=(2000, 16)) * rnd.uniform(0.5, 2, size=(2000, 1))).astype(np.float32)
    out = ann.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "vec_id long, embedding array<float>"), k=20).collect()
    exact = data.astype(np.float64) @ data[::20].astype(np.float64).T
    hit = 0
    for q in range(0, 2000, 20):
        score = exact[:, q // 20].copy()
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & {r.vec_id for r in out if r.query_id == q})
    assert len(out) == 2000 and hit / 2000 >= 0.9
