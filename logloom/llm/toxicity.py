"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a text's bytes (A-Z lower-cased, white space as spaces, a
space at both ends), hashed to BITS bits. Over the labelled training texts each gram has a
log-count ratio r of its document frequencies in both classes; grams whose r stands out of its
own sampling error are kept. A logistic regression is fitted on the features r * presence; a
text's score is its sigmoid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

GRAMS = (3, 4, 5)
BITS = 20
#: Labelled texts that the classifier is fitted on at most: those first in the order of a hash of
#: their id. Scores cover all texts.
MAX_TRAIN = 8_000
#: Least ratio of r to its standard error of a gram that is kept.
LEAST_Z = 3.5
#: Bytes that are hashed at once.
WINDOW = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[9:14] = 32
_FOLD[65:91] += 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each between spaces and followed by a zero; and their starts."""
    starts = np.cumsum([0, *(len(t) + 3 for t in texts)])
    # a zero byte inside a text counts as a space, so that zeros stand only between texts
    return _FOLD[np.frombuffer(b"".join(b" " + t.replace(b"\0", b" ") + b" \0" for t in texts), dtype=np.uint8)], starts


def gram_hashes(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the n-grams of data that don't cross a zero."""
    count = len(data) - n + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    packed = np.zeros(count, dtype=np.uint64)
    clean = np.ones(count, dtype=bool)
    for k in range(n):
        part = data[k : k + count]
        packed = packed << np.uint64(8) | part
        clean &= part != 0
    hashed = ((packed + np.uint64(n << 48)) * _MIX >> np.uint64(64 - BITS)).astype(np.uint32)
    return np.nonzero(clean)[0], hashed


def hits(texts: list[bytes], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of text number and gram hash for the hashes that wanted marks."""
    data, starts = flat(texts)
    pairs = [np.empty(0, np.int64)]
    for begin in range(0, len(data), WINDOW):
        for n in GRAMS:
            at, hashed = gram_hashes(data[begin : begin + WINDOW + n - 1], n)
            at = at[wanted[hashed[at]]]
            text = np.searchsorted(starts, at + begin, side="right") - 1
            pairs.append(np.unique(text << BITS | hashed[at].astype(np.int64)))
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> BITS, pairs & (1 << BITS) - 1


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray  # of each gram hash, r included; zero for grams left out

    def score(self, texts: list[bytes]) -> np.ndarray:
        text, gram = hits(texts, self.weights != 0)
        total = self.bias + np.bincount(text, self.weights[gram], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _fit(text: np.ndarray, gram: np.ndarray, label: np.ndarray, ratio: np.ndarray, l2: float = 1.0, steps: int = 500) -> Model:
    """Logistic regression on r * presence, by full-batch Adam: its step is scaled by coordinate,
    so that rare grams converge as frequent ones do."""
    kept, column = np.unique(gram, return_inverse=True)
    scale, n, rate = ratio[kept], len(label), label.mean()
    w = np.zeros(len(kept) + 1)
    w[-1] = np.log(rate / (1 - rate))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        score = w[-1] + np.bincount(text, (scale * w[:-1])[column], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(score, -35, 35))) - label
        grad = np.append(scale * np.bincount(column, error[text], minlength=len(kept)) + l2 * w[:-1], error.sum()) / n
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= 0.03 * first / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[kept] = scale * w[:-1]
    return Model(float(w[-1]), weights)


def train(labelled: DataFrame) -> Model:
    """Fits on rows of id, text, label (0 or 1), of which there must be a bounded number. Without
    rows of both classes the score is the share of label 1, 0 without any row. Grams are counted
    by task, and chosen and weighed in one task; only the chosen grams' ratios and all weights
    come to the driver."""
    rows = labelled.select(text_bytes("text").alias("bytes"), F.col("label").cast("int").alias("label"), F.xxhash64("id").alias("place")).repartition(8).persist()
    spark = labelled.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros((2, 1 << BITS), np.int32), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, _ = flat([text])
                found = np.unique(np.concatenate([h[at] for at, h in (gram_hashes(data, n) for n in GRAMS)]))
                seen[label, found] += 1
                total[label] += 1
        if sum(total):
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()) for t in total] + [pa.array([s.tobytes()], pa.binary()) for s in seen], names=["n0", "n1", "seen0", "seen1"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros(2), np.zeros((2, 1 << BITS))
        for batch in batches:
            for k in range(2):
                n[k] += sum(batch.column(k).to_pylist())
                for part in batch.column(2 + k):
                    seen[k] += np.frombuffer(part.as_py(), np.int32)
        q, p = seen + 1.0
        ratio = np.log(p / (n[1] + 2)) - np.log(q / (n[0] + 2))
        kept = np.nonzero((seen.sum(axis=0) >= 3) & (np.abs(ratio) >= LEAST_Z * np.sqrt(1 / p + 1 / q)))[0]
        yield pa.RecordBatch.from_arrays([pa.array([n[0]]), pa.array([n[1]]), pa.array([kept.astype("<i4").tobytes()], pa.binary()), pa.array([ratio[kept].tobytes()], pa.binary())], names=["n0", "n1", "kept", "ratio"])

    try:
        chosen = rows.select("bytes", "label").mapInArrow(count, "n0 long, n1 long, seen0 binary, seen1 binary").coalesce(1).mapInArrow(choose, "n0 double, n1 double, kept binary, ratio binary").first()
        if not (chosen and chosen["n0"] and chosen["n1"]):
            share = chosen["n1"] / (chosen["n0"] + chosen["n1"]) if chosen and chosen["n0"] + chosen["n1"] else 0.0
            return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(1 << BITS))
        ratio = np.zeros(1 << BITS)
        ratio[np.frombuffer(chosen["kept"], "<i4")] = np.frombuffer(chosen["ratio"])
        shared = spark.sparkContext.broadcast(ratio)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text, gram = hits(batch.column(0).to_pylist(), shared.value != 0)
                cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
                found = [gram[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["label", "place", "grams"])

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            label, grams = [], []
            for batch in batches:
                label += batch.column(0).to_pylist()
                grams += [np.frombuffer(g.as_py(), "<i4") for g in batch.column(2)]
            text = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
            model = _fit(text, np.concatenate(grams), np.array(label, float), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([model.bias]), pa.array([model.weights.tobytes()], pa.binary())], names=["bias", "weights"])

        marked = rows.mapInArrow(keep, "label int, place long, grams binary").coalesce(1).sortWithinPartitions("place", "label", "grams")
        found = marked.mapInArrow(fit, "bias double, weights binary").first()
        return Model(found["bias"], np.frombuffer(found["weights"]))
    finally:
        rows.unpersist()


def held_out(id_col: str, modulus: int = 4, remainder: int = 2):
    """Whether a row is never learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = MAX_TRAIN) -> Model:
    """Fits on the texts of docs that labels covers and that are not held out: of those with label
    0 or 1, at most `limit` documents, the first in the order of a hash of the id. A document with
    several labels counts as toxic if one says so; of an id's several texts the least is read."""
    marks = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    bound = marks.orderBy(F.xxhash64("id"), "id").limit(limit)  # ids and labels only
    texts = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # `limit` rows of two numbers are broadcast, so that no text but the sample's moves
    return train(texts.join(F.broadcast(bound), "id").groupBy("id", "label").agg(F.min("text").alias("text")))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id_col, held_out boolean, score double, predicted int (1 if score >= threshold) of every
    row. Only the text enters the score. A null text counts as empty and scores as a text without
    features; null ids stay null and count as held out; repeated rows score alike; texts of any
    length are read whole; an empty table gives an empty result; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_bytes(text_col).alias("bytes"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(shared.value.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
