"""Language identification: a bidirectional gated recurrent network over the bytes of a text.

A text's bytes are cut into windows. In each window one gated recurrent unit reads forwards and
one backwards; from both states at a byte a softmax gives that byte a language. A document's
probabilities are the mean over all of its bytes. The network is trained in numpy by
backpropagation through time on windows of a bounded number of documents, where every byte's
label is the language of its document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

#: Documents that the network is fitted on at most, shared out evenly among the languages that
#: occur; those of a language that come first by a hash of the id.
MAX_TRAIN = 4_000
#: Windows of a training document, at random places of its whole text.
WINDOWS = 8
#: Bytes of a window, and units of each direction.
LENGTH, UNITS = 64, 6
#: Windows of a training step, passes over the training windows, and the first step's length.
TOGETHER, EPOCHS, RATE = 256, 4, 0.02
#: Windows that are labelled together.
LANES = 1024


@dataclass
class Gru:
    """A gated recurrent unit. table: what each byte adds to the update gate, the reset gate and
    the candidate (three blocks of rows); weights: what the state adds, the last column the bias."""

    table: np.ndarray
    weights: np.ndarray

    def states(self, x: np.ndarray, valid: np.ndarray | None, backwards: bool, trace: list | None = None, project: np.ndarray | None = None) -> np.ndarray:
        """States (step, unit, lane) over bytes x (step, lane), or rows of project times them; where
        valid is 0 the state is 0."""
        steps, lanes = x.shape
        units = self.weights.shape[1] - 1
        h = np.zeros((units + 1, lanes), np.float32)
        h[-1] = 1
        state = h[:-1]
        out = np.empty((steps, units if project is None else len(project), lanes), np.float32)
        a, u = np.empty((3 * units, lanes), np.float32), np.empty((3 * units, lanes), np.float32)
        gates, n, d = a[: 2 * units], a[2 * units :], np.empty((units, lanes), np.float32)
        for t in range(steps - 1, -1, -1) if backwards else range(steps):
            np.take(self.table, x[t], axis=1, out=a, mode="clip")
            np.matmul(self.weights, h, out=u)
            gates += u[: 2 * units]
            gates *= 0.5
            np.tanh(gates, out=gates)  # a sigmoid is half of this, plus a half
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[units:], u[2 * units :], out=d)
            n += d
            np.tanh(n, out=n)
            if trace is not None:
                trace.append((t, h.copy(), gates[:units].copy(), gates[units:].copy(), n.copy(), u[2 * units :].copy()))
            np.subtract(state, n, out=d)
            d *= gates[:units]
            np.add(n, d, out=state)
            if valid is not None:
                state *= valid[t]
            if project is None:
                out[t] = state
            else:
                np.matmul(project, state, out=out[t])
        return out

    def gradients(self, x: np.ndarray, valid: np.ndarray, trace: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and weights, given that of the states, backwards through the steps."""
        units = self.weights.shape[1] - 1
        carry, d_weights = np.zeros_like(d_out[0]), np.zeros_like(self.weights)
        d_a = np.empty((len(x), 3 * units, x.shape[1]), np.float32)
        for t, h, z, r, n, u in reversed(trace):
            dh = (d_out[t] + carry) * valid[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz, dr = dh * (h[:-1] - n) * z * (1 - z), dn * u * r * (1 - r)
            d_a[t] = np.concatenate([dz, dr, dn])
            du = np.concatenate([dz, dr, dn * r])
            d_weights += du @ h.T
            carry = dh * z + self.weights[:, :-1].T @ du
        at = x.reshape(-1)
        d_table = np.stack([np.bincount(at, row.reshape(-1), minlength=256) for row in d_a.transpose(1, 0, 2)])
        return d_table.astype(np.float32), d_weights


@dataclass
class Network:
    forwards: Gru
    backwards: Gru
    readout: np.ndarray  # a row a language: both directions' units and a bias
    names: list[str]

    def label(self, x: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
        """Probabilities (step, language, lane) of every byte of x (step, lane)."""
        units = self.forwards.weights.shape[1] - 1
        parts = (np.ascontiguousarray(p) for p in (self.readout[:, :units], self.readout[:, units:-1]))
        out, other = (gru.states(x, valid, back, project=p) for gru, back, p in zip((self.forwards, self.backwards), (False, True), parts, strict=True))
        for one, two in zip(out, other, strict=True):  # a step at a time stays in the cache
            one += two
            one += self.readout[:, -1:]
            one -= one.max(axis=0)
            np.exp(one, out=one)
            one /= one.sum(axis=0)
        return out

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """A row a text of its mean probabilities over all bytes; zeros for an empty text."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        total = np.zeros((len(texts), len(self.names)))
        for text, start, length in windows_of(size):
            x, valid = gather(data, start, length)
            met = self.label(x, valid)
            if valid is not None:
                met *= valid[:, None]
            sums = met.sum(axis=0, dtype=np.float64)
            for k in range(len(self.names)):
                total[:, k] += np.bincount(text, sums[k], minlength=len(texts))
        return total / np.maximum(size, 1)[:, None]


def windows_of(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, start and length of all windows of texts of these sizes that lie one behind another,
    in lots of LANES: first those of full length, then shorter ones by length."""
    begin = np.cumsum(size) - size
    for full in (True, False):
        count = size // LENGTH if full else (size % LENGTH > 0).astype(np.int64)
        ends = np.cumsum(count)
        order = None if full else np.argsort(-(size % LENGTH)[count > 0], kind="stable")
        only = np.flatnonzero(count)
        for at in range(0, int(ends[-1]) if len(ends) else 0, LANES):
            number = np.arange(at, min(at + LANES, int(ends[-1])))
            if full:
                text = np.searchsorted(ends, number, side="right")
                yield text, begin[text] + (number - (ends - count)[text]) * LENGTH, np.full(len(text), LENGTH)
            else:
                text = only[order[number]]
                rest = size[text] % LENGTH
                yield text, begin[text] + size[text] - rest, rest


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Bytes (step, lane) of windows, and which of them are there; None if all are."""
    step = np.arange(int(length.max()))[:, None]
    x = data[np.minimum(start + step, len(data) - 1)]
    return x, None if int(length.min()) == len(step) else (step < length).astype(np.float32)


def fit(texts: list[bytes], label: np.ndarray, names: list[str], seed: int = 5, epochs: int = EPOCHS) -> Network:
    """Trains on windows of at most LENGTH bytes, none empty, and the numbers of their languages."""
    rnd = np.random.default_rng(seed)
    draw = lambda rows, columns, by: (rnd.standard_normal((rows, columns)) * by).astype(np.float32)
    net = Network(*(Gru(draw(3 * UNITS, 256, 0.3), draw(3 * UNITS, UNITS + 1, 0.3)) for _ in range(2)), draw(len(names), 2 * UNITS + 1, 0.3), names)
    weights = [net.forwards.table, net.forwards.weights, net.backwards.table, net.backwards.weights, net.readout]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    steps, k = epochs * -(-len(texts) // TOGETHER), 0
    for _ in range(epochs):
        order = rnd.permutation(len(texts))
        for at in range(0, len(order), TOGETHER):
            some, k = order[at : at + TOGETHER], k + 1
            x, valid = gather(data, begin[some], size[some])
            found = gradients(net, x, np.ones(x.shape, np.float32) if valid is None else valid, label[some])
            rate = RATE * (1 - (k - 1) / steps)
            for w, g, m, v in zip(weights, found, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return net


def gradients(net: Network, x: np.ndarray, valid: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over all bytes, in the order of fit's weights."""
    traces: tuple[list, list] = ([], [])
    one, two = net.forwards.states(x, valid, False, traces[0]), net.backwards.states(x, valid, True, traces[1])
    seen = np.concatenate([one, two, np.ones_like(one[:, :1])], axis=1)
    logit = np.matmul(net.readout, seen)
    logit -= logit.max(axis=1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(axis=1, keepdims=True)
    p[:, label, np.arange(len(label))] -= 1
    p *= valid[:, None] / valid.sum()
    d_readout = np.einsum("tlb,tub->lu", p, seen, optimize=True)
    d_seen = np.matmul(net.readout.T, p)
    units = one.shape[1]
    return [*net.forwards.gradients(x, valid, traces[0], d_seen[:, :units]), *net.backwards.gradients(x, valid, traces[1], d_seen[:, units : 2 * units]), d_readout]


# --- Spark -------------------------------------------------------------------------------------


def held_out(id_col: str, modulus: int = 4, remainder: int = 2):
    """Whether a row is never learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = MAX_TRAIN) -> Network | None:
    """A network fitted on rows that aren't held out and have a language and a letter: at most
    `limit` documents, shared out evenly among the `limit` commonest languages. None without any.
    Their windows are bounded by limit, WINDOWS and LENGTH; they are fitted in one task, and only
    the weights come to the driver."""
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("name"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit(23)).alias("place"))
    counts = usable.groupBy("name").agg(F.count("*").alias("of")).orderBy(F.desc("of"), "name").limit(limit).persist()
    try:
        names = [r.name for r in counts.orderBy("name").collect()]  # `limit` names at most
        if not names:
            return None
        share = max(1, limit // len(names))
        # first a draw that leaves some four times as many as wanted, then the first windows by hash
        drawn = usable.join(F.broadcast(counts), "name").where(F.pmod("place", F.lit(1 << 30)) < F.lit(4.0 * share * (1 << 30)) / F.col("of") + 1)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for name, place, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    rnd = np.random.default_rng(place & (1 << 63) - 1)
                    most = len(text) - LENGTH
                    starts = [0] if most <= 0 else np.unique(rnd.integers(0, most + 1, WINDOWS)).tolist()
                    rows += [(name, place, s, text[s : s + LENGTH]) for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["name", "place", "start", "window"])

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            label, texts = [], []
            for batch in batches:
                label += [names.index(x) for x in batch.column(0).to_pylist()]
                texts += batch.column(3).to_pylist()
            net = fit(texts, np.array(label), names)
            parts = [net.forwards.table, net.forwards.weights, net.backwards.table, net.backwards.weights, net.readout]
            yield pa.RecordBatch.from_arrays([pa.array([p.astype("<f4").tobytes()], pa.binary()) for p in parts], names=list("abcde"))

        with small_batches(docs.sparkSession):
            windows = drawn.select("name", "place", text_bytes("text").alias("bytes")).mapInArrow(cut, "name string, place long, start long, window binary")
            first = windows.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("place", "start", "window"))).where(F.col("nth") <= share * WINDOWS)
            row = first.drop("nth").coalesce(1).sortWithinPartitions("place", "start", "window", "name").mapInArrow(learn, "a binary, b binary, c binary, d binary, e binary").first()
        a, b, c, d, e = (np.frombuffer(x, "<f4") for x in row)
        return Network(Gru(a.reshape(-1, 256), b.reshape(3 * UNITS, -1)), Gru(c.reshape(-1, 256), d.reshape(3 * UNITS, -1)), e.reshape(len(names), -1), names)
    finally:
        counts.unpersist()


def predict_languages(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", unknown: str = "und") -> DataFrame:
    """id_col, held_out boolean, lang_pred string, score double of every row: the language whose
    mean probability over the text's bytes is largest (of equal ones the first by name), and that
    probability. Only the text enters.

    Texts that are null or have no letter, and all texts if nothing was learnt, get `unknown` and
    score 0. Texts are read whole, whatever their length; repeated rows are judged alike; a null id
    stays null and counts as held out; other columns are ignored; an empty table gives an empty
    result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.when(F.col(text_col).rlike(r"\p{L}"), text_bytes(text_col))
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text.alias("bytes"))
    if net is None:
        return rows.select(F.col("id").alias(id_col), "held_out", F.lit(unknown).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 60 kB, and a row a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.names, unknown], object)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            pooled = shared.value.pool([t or b"" for t in texts])
            known = np.array([t is not None for t in texts], bool)
            best = np.where(known, pooled.argmax(axis=1), len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(np.where(known, pooled.max(axis=1), 0.0))], names=["id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
