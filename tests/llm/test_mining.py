"""Phrase collocations, language identification and hard negatives against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from logloom.llm import collocations as co
from logloom.llm import hard_negatives as hn
from logloom.llm import language_id as li
from logloom.llm.queries import QUERIES


# --- collocations ---


def phrases_by_brute_force(rows, longest, least, percent, top):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, cut = min((1_000_000 * a * a // (f[p[:c]] * f[p[c:]]), c) for c in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        found.sort()
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def some_texts(seed, n):
    rnd = random.Random(seed)
    words = ["The", "of", "cat", "ÉTÉ", "été", "x" * 50, "new", "york", "city", "a\x00b"]
    texts = [("".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ". ", "\n", ", ", ""]) for _ in range(rnd.randrange(60))), rnd.choice(["en", "en", "fr", None])) for _ in range(n)]
    return texts + [(None, "en"), ("", "de"), (" \t. ;", "de"), texts[0], texts[0]]


@pytest.mark.parametrize("longest, least, top", [(3, 10, 2000), (2, 3, 7), (4, 5, 30)])
def test_collocations_equal_brute_force(spark, monkeypatch, longest, least, top):
    # small blocks, shares and tries, so that several of each meet
    monkeypatch.setattr(co, "BLOCK", 300)
    monkeypatch.setattr(co, "SHARE", 500)
    monkeypatch.setattr(co, "PHRASES", 40)
    rows = some_texts(longest, 150)
    docs = spark.createDataFrame([(t, lang, 1, "clash", 2.0) for t, lang in rows], "text string, lang string, n long, phrase string, score double")
    out = co.collocations(docs, longest, least, 50, top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == phrases_by_brute_force(rows, longest, least, 50, top)


def test_collocations_of_nothing(spark, no_docs):
    assert co.collocations(no_docs).collect() == []


def test_long_texts_are_cut_at_breaks():
    rnd = random.Random(1)
    text = "".join(rnd.choice("ab .,\n") for _ in range(5000)).encode() + b"z" * 900 + b"." + b"y" * 10
    for most in (7, 100, 10_000):
        parts = list(co.split_text(text, most))
        assert b"".join(parts) == text
        assert all(p[-1:] in (b".", b",", b"\n") for p in parts[:-1])


def test_trie_accepts_its_phrases_alone():
    rnd = np.random.default_rng(3)
    for n, words, k in ((1, 1, 2), (500, 30, 3), (3000, 5000, 2), (4000, 90, 2)):
        phrases = np.unique(rnd.integers(0, words, (n, k)) * 7 + (1 << 31), axis=0)
        trie = co.build_trie(phrases)
        ids = np.arange(words + 5, dtype=np.int64) * 7 + (1 << 31)
        codes = rnd.integers(-1, len(ids), 20_000).astype(np.int32)
        at, phrase = trie.follow(codes, ids)
        wanted = {tuple(p): j for j, p in enumerate(phrases)}
        padded = codes.tolist() + [-1] * k
        expected = []
        for i in range(len(codes)):
            window = padded[i : i + k]
            if min(window) >= 0 and (j := wanted.get(tuple(ids[window]))) is not None:
                expected.append((i, j))
        assert sorted(zip(at.tolist(), phrase.tolist(), strict=True)) == expected


def test_op11_is_collocations(spark, sf, texts):
    import pyarrow.dataset as ds

    rows = ds.dataset(f"{sf}/documents.parquet").to_table(columns=["text", "lang"]).to_pylist()
    got = sorted(map(tuple, QUERIES["op11_phrase_collocations"](spark, sf).collect()))
    assert got == phrases_by_brute_force([(r["text"], r["lang"]) for r in rows], 3, 10, 50, 2000)


# --- language identification ---


def plain_states(gru, text, backwards):
    units = gru.weights.shape[1] - 1
    w, b = gru.weights[:, :-1].astype(float), gru.weights[:, -1].astype(float)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    h, out = np.zeros(units), {}
    for t in reversed(range(len(text))) if backwards else range(len(text)):
        a, u = gru.table[:, text[t]].astype(float), w @ h + b
        z, r = sigmoid(a[:units] + u[:units]), sigmoid(a[units : 2 * units] + u[units : 2 * units])
        n = np.tanh(a[2 * units :] + r * u[2 * units :])
        h = out[t] = (1 - z) * n + z * h
    return out


def plain_pool(net, text):
    total = np.zeros(len(net.names))
    for at in range(0, len(text), li.LENGTH):
        window = text[at : at + li.LENGTH]
        one, two = plain_states(net.forwards, window, False), plain_states(net.backwards, window, True)
        for t in range(len(window)):
            logit = net.readout.astype(float) @ np.concatenate([one[t], two[t], [1]])
            p = np.exp(logit - logit.max())
            total += p / p.sum()
    return total / max(len(text), 1)


def random_network(units=li.UNITS, names=("a", "b", "c")):
    rnd = np.random.default_rng(2)
    draw = lambda *shape: rnd.standard_normal(shape).astype(np.float32)
    return li.Network(li.Gru(draw(3 * units, 256), draw(3 * units, units + 1)), li.Gru(draw(3 * units, 256), draw(3 * units, units + 1)), draw(len(names), 2 * units + 1), list(names))


def test_pooled_probabilities_equal_a_plain_network(monkeypatch):
    monkeypatch.setattr(li, "LANES", 5)
    net, rnd = random_network(), random.Random(4)
    texts = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 63, 64, 65, 200, 640, 3, 64, 1000)]
    assert np.allclose(net.pool(texts), [plain_pool(net, t) for t in texts], atol=1e-5)


def test_gradients_equal_differences():
    net, rnd = random_network(3), np.random.default_rng(5)
    for gru in (net.forwards, net.backwards):
        gru.table, gru.weights = gru.table * 0.5, gru.weights * 0.5
    x = rnd.integers(0, 4, (6, 5)).astype(np.uint8)
    valid = (np.arange(6)[:, None] < np.array([6, 6, 4, 3, 1])).astype(np.float32)
    label = np.array([0, 1, 2, 0, 1])

    def loss():
        p = net.label(x, valid)[:, label, np.arange(5)].astype(float)
        return -(np.log(p) * valid).sum() / valid.sum()

    found = li.gradients(net, x, valid, label)
    for w, g in zip([net.forwards.table, net.forwards.weights, net.backwards.table, net.backwards.weights, net.readout], found, strict=True):
        for _ in range(12):
            at = tuple(rnd.integers(0, n) if n != 256 else rnd.integers(0, 4) for n in w.shape)
            before, step = w[at], np.float32(1e-2)
            w[at] = before + step
            up = loss()
            w[at] = before - step
            down = loss()
            w[at] = before
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def test_op12_is_right_on_held_out_documents(spark, sf):
    import pyarrow.dataset as ds

    rows = {r["doc_id"]: r for r in ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table().to_pylist()}
    out = QUERIES["op12_language_id"](spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id]["lang"] for r in judged) >= 0.97 * len(judged)


def test_languages_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    net = random_network()
    got = li.predict_languages(odd_docs, net).collect()
    assert len(got) == len(odd_rows)
    for r, (i, text, *_) in zip(got, odd_rows, strict=True):
        assert r.doc_id == i and r.held_out == (i is None or zlib.crc32(str(i).encode()) % 4 == 2)
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif len(text) < 1000:
            p = plain_pool(net, text.encode())
            assert r.lang_pred == net.names[p.argmax()] and abs(r.score - p.max()) < 1e-5
    assert li.train_languages(no_docs) is None
    assert li.predict_languages(no_docs, net).collect() == []
    assert {(r.lang_pred, r.score) for r in li.predict_languages(odd_docs, None).collect()} == {("und", 0.0)}


def test_languages_are_learnt_from_training_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(li, "EPOCHS", 1)
    rows = [(i, ("zzz aaa " if zlib.crc32(str(i).encode()) % 4 != 2 else "qqq ") * 9, "xx" if zlib.crc32(str(i).encode()) % 4 != 2 else "secret") for i in range(40)] + [(900, "no language", None)]
    net = li.train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.names == ["xx"]


# --- hard negatives ---


def negatives_by_brute_force(rows, every, positives, negatives, low, high):
    out = []
    width = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, label, np.array(list(v) + [0] * (width - len(v)), dtype=object)) for i, label, v in rows]
    for i, label, v in rows:
        if i % every:
            continue
        met = sorted((-int(v @ w) if width else 0, j, m) for j, m, w in rows if j != i)
        for s, p, _ in [x for x in met if x[2] == label][:positives]:
            window = [(t, j) for t, j, m in met if m != label and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1, 40, 1 << 20])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(hn, "BLOCK", 90)
    monkeypatch.setattr(hn, "GROUP", 9)
    monkeypatch.setattr(hn, "TOGETHER", 4)
    rnd = np.random.default_rng(spread)
    centre = rnd.integers(-spread, spread + 1, (4, 12))
    rows = [(i, int(k), (centre[k] + rnd.integers(-spread, spread + 1, 12)).tolist()) for i, k in enumerate(rnd.integers(0, 4, 300))]
    rows += [(1000 + j, 7, [0] * 12) for j in range(3)] + [(1010, 8, [5]), (1020, 1, []), (1030, 1, rows[4][2]), (1040, 2, rows[4][2])]
    df = spark.createDataFrame([(i, k, v, "clash", 1) for i, k, v in rows], "id long, label long, vector array<long>, anchor_id string, rank int")
    out = hn.mine_negatives(df, df.id % 10 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == negatives_by_brute_force(rows, 10, 5, 3, 50, 95)


def test_rows_that_take_no_part(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.3], 1), (1, None, 1), (2, [0.1, None], 1), (3, [nan, 1.0], 1), (4, [1.0, -inf], 1), (5, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (6, [], 2), (7, [0.999, 1.0], 3), (7, [0.999, 1.0], 3), (7, [0.2, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.id: (r.label, r.vector) for r in hn.integer_rows(df, F.col("label")).collect()}
    assert got == {0: (1, [128, -77]), 6: (2, []), 7: (3, [51, 256])}
    none = hn.mine_negatives(hn.integer_rows(df.limit(0), F.col("label")), F.col("id") % 50 == 0)
    assert none.collect() == []


def test_small_graphs_are_searched_whole():
    from logloom.llm import ann

    rnd = np.random.default_rng(9)
    for n in (1, 2, 7, 20, 33, 60, 128):
        data = np.unique(np.concatenate([rnd.standard_normal((n // 2 + 1, 8)), rnd.standard_normal((n, 8)) * 0.01 + 5])[:n].round(4), axis=0)
        graph = ann.build_graph(data, np.arange(len(data)))
        found = graph.search(np.concatenate([data[:3], -data[:2]]))
        most = min(len(data), 20)
        for row, q in zip(found, np.concatenate([data[:3], -data[:2]]), strict=True):
            met = set(row[row >= 0].tolist())
            best = np.argsort(-(data @ q), kind="stable")[:most]
            assert len(met) >= most and len(met & set(best.tolist())) >= 0.9 * most
