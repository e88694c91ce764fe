"""Language-model scoring: online logistic mixing of hashed-context bit predictors.

A text is its tokens (A-Z lower-cased runs of bytes other than 9-13 and 32), each followed by a
space, and an end. Bytes are coded as nibbles: COMMON ones as one, others as an escape and two.
Four bits a nibble are predicted one by one from several contexts. A context, hashed to a row,
holds counts of the nibbles that followed it in the training texts; at each node of a nibble's
binary tree they give a probability, whose logit is a predictor's output. A mixer weighs the
outputs: p = squash(sum w_i * stretch(p_i)). Its weight set is gated by the bit's place, and
after every bit moves along the coding error's gradient. An adaptive map from (place, mixed
probability) to what came true refines the result. Weights and map start anew with each text and
go through the whole of it, so that a score depends on its text and the model alone.

Spark gathers the model and brings it to the texts, with nothing broadcast or sent to the driver:

1. chunks: texts are dealt out by length, so many bytes a partition, and written as chunks of
   about CHUNK bytes, for texts that are mixed in step to be of similar length;
2. requests: each chunk asks for its distinct cells (context and nibble) and tokens, and says how
   often it has learnt each; requests are summed in buckets of a hash, as many as the text needs
   (tokens count by a hash of 63 bits);
3. answers: every bucket sends back to each chunk the logits or counts of what it asked for;
4. scores: a chunk and its answers meet in one task, which holds no more than one chunk.

The rows that contexts of more than SHORT bytes are hashed to grow with the training text, WIDE
for every byte of it; shorter ones, of which a language has few, have 2^ROW_BITS rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import materialise
from .setjoin import hash_words, words

#: Bytes of one nibble, most frequent first; the sixteenth nibble is the escape.
COMMON = b" etaoinsrhldcum"
END = b"\n"
#: Contexts: so many bytes before, up to 7.
ORDERS = (2, 3, 4, 6)
ROW_BITS, SHORT, WIDE = 19, 3, 4
#: Bytes of text in a chunk, and in a bucket of the longest contexts and of tokens.
WIDE_CHUNK, BUCKET_BYTES = 1 << 24, 1 << 24
#: The buckets of other contexts are fewer by these factors, as there are fewer contexts.
SHARES = {2: 64, 3: 32, 4: 8}
LANES = 2048
RATE, START, MAP_RATE, MAP_SHARE = 0.02, 0.3, 0.03, 0.4
#: Logits are kept as signed bytes of this many steps a unit.
STEPS = 16.0
#: Nibbles that are mixed together; bytes whose contexts are hashed, and counted, together.
WINDOW, BLOCK, PIECE = 3 << 18, 1 << 15, 1 << 19
#: Cells below this are told apart by a table, others by sorting.
DENSE = 1 << 24

_U = np.uint64
_ODD, _MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_ROW = ~_U(15)
_CODE = np.full(256, 15, np.uint8)
_CODE[list(COMMON)] = np.arange(15)
_MAP_BINS = 24


def stream(text: bytes) -> bytes:
    """The bytes that are scored; cut at spaces they are the tokens and the end."""
    return b" ".join([*words(text), END])


def nibbles(texts: list[bytes], bits: int = ROW_BITS, before: list[bytes] | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The nibbles of all streams, each context's cell (row * 16 + nibble), and the streams'
    starts among the nibbles. Before each stream go eight bytes: zeros, or what it continues.
    Contexts of more than SHORT bytes are hashed to 2^bits rows."""
    gap = b"\0" * 8
    padded = np.frombuffer(b"".join([b + t for b, t in zip(before or [gap] * len(texts), texts, strict=True)]) + gap, np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size + 8) - size
    inside = np.ones(len(padded) - 8, bool)
    inside[(start[:, None] - np.arange(1, 9)).reshape(-1)] = False
    inside = inside[8:]
    window = np.ascontiguousarray(np.ndarray((len(inside),), "<u8", padded, strides=(1,)))[inside]  # the eight bytes before
    flat = padded[8:-8][inside]
    code = _CODE[flat]
    rare = code == 15
    length = np.where(rare, 3, 1)
    head = np.cumsum(length) - length
    second = head[rare] + 1
    high, low = flat[rare] >> 4, flat[rare] & 15
    out = np.empty(length.sum(), np.uint8)
    out[head], out[second], out[second + 1] = code, high, low
    window, salt, nibble = np.repeat(window, length), np.zeros(len(out), np.uint64), out.astype(np.uint64)
    salt[second], salt[second + 1] = _U(1 << 32), _U(2) + high << _U(32)
    cells, spare = [], np.empty(len(out), np.uint64)
    for order in ORDERS:
        context = window >> _U(64 - 8 * order)
        context *= _ODD
        context += salt
        np.right_shift(context, _U(31), out=spare)
        context ^= spare
        context *= _MIX
        context >>= _U(60 - (bits if order > SHORT else ROW_BITS))
        context &= _ROW
        context |= nibble
        cells.append(context.view(np.int64))
    begin = np.cumsum(size) - size
    return out, cells, np.append(head[begin], len(out))


def distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells, ascending, and each cell's place among them."""
    shift, most = len(cells).bit_length(), int(cells.max(initial=0))
    if most < min(DENSE, 64 * len(cells)):
        mark = np.zeros(most + 1, bool)
        mark[cells] = True
        found = np.flatnonzero(mark)
        place = np.empty(most + 1, np.int32)
        place[found] = np.arange(len(found))
        return found, place.take(cells)
    if most.bit_length() + shift > 63:
        return np.unique(cells, return_inverse=True)
    packed = cells << shift
    packed |= np.arange(len(cells))
    packed.sort()
    at = packed & (1 << shift) - 1
    packed >>= shift
    new = np.diff(packed, prepend=-1) != 0
    place = np.empty(len(cells), np.int64)
    place[at] = np.cumsum(new) - 1
    return packed[new], place


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def tallied(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells, ascending, and how often each occurs."""
    if len(cells) and cells.max() < 1 << 31:
        cells = cells.astype(np.int32)  # sorts faster
    cells = np.sort(cells)
    first = _starts(cells)
    return cells[first].astype(np.int64), np.diff(first, append=len(cells))


def looked_up(cells: np.ndarray, values: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function from arrays of cells to their values; the given cells ascend."""
    if len(cells) and cells[-1] < DENSE:
        table = np.zeros(int(cells[-1]) + 1, values.dtype)
        table[cells] = values
        return lambda asked: table.take(asked)

    def sorted_out(asked: np.ndarray) -> np.ndarray:
        shift = len(asked).bit_length()
        if not len(asked) or int(cells[-1]).bit_length() + shift > 63:
            return values.take(np.searchsorted(cells, asked))
        packed = asked << shift
        packed |= np.arange(len(asked))
        packed.sort()
        at = packed & (1 << shift) - 1
        packed >>= shift
        first = _starts(packed)
        out = np.empty(len(asked), values.dtype)
        out[at] = np.repeat(values.take(np.searchsorted(cells, packed[first])), np.diff(first, append=len(packed)))
        return out

    return sorted_out


def probed(keys: np.ndarray, values: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """As looked_up, for keys that are spread evenly over 63 bits."""
    bits = max(1, len(keys).bit_length())
    start = np.searchsorted(keys, np.arange(1 << bits) << (63 - bits)).astype(np.int32)

    def probe(asked: np.ndarray) -> np.ndarray:
        at = start.take(asked >> (63 - bits))
        left = np.flatnonzero(keys.take(at, mode="clip") != asked)
        while len(left):
            at[left] += 1
            if at[left[-1]] > len(keys):
                raise KeyError("a key that wasn't given")
            left = left[keys.take(at[left], mode="clip") != asked[left]]
        return values.take(at, mode="clip")

    return probe


class _Tally:
    """Distinct cells with their counts, merged as they come."""

    def __init__(self):
        self.cells, self.counts, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, cells: np.ndarray, learnt: bool) -> None:
        found, count = tallied(cells)
        self.waiting.append((found, count if learnt else np.zeros(len(found), np.int64)))
        self.size += len(found)
        if self.size > max(2 * WINDOW, len(self.cells)):
            self.merge()

    def merge(self) -> None:
        cells, counts = (np.concatenate(x) for x in zip((self.cells, self.counts), *self.waiting, strict=True))
        self.cells, place = distinct(cells)
        self.counts = np.bincount(place, counts, minlength=len(self.cells)).astype(np.int64)
        self.waiting, self.size = [], 0


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, for those that are zero to take no room."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def _pieces(texts: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts in turn, in lists of about so many bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


#: Nibbles of each byte.
_LENGTH = np.where(_CODE == 15, 3, 1).astype(np.uint8)


def cost(text: bytes) -> int:
    """A stream's nibbles."""
    return int(_LENGTH.take(np.frombuffer(text, np.uint8)).sum(dtype=np.int64))


def _cuts(text: bytes, step: int) -> list[int]:
    """Where a stream is cut after about every step nibbles, and its end."""
    upto = np.cumsum(_LENGTH.take(np.frombuffer(text, np.uint8)), dtype=np.int64)
    return [*np.searchsorted(upto, np.arange(step, upto[-1], step)).tolist(), len(text)]


def _windows(texts: list[bytes], step: int) -> Iterator[tuple[list[bytes], list[bytes] | None]]:
    """Texts, those of most nibbles first, cut at about every step nibbles: the pieces of those that
    reach so far, with the eight bytes before each."""
    cuts = [_cuts(t, step) for t in texts]
    yield [t[: c[0]] for t, c in zip(texts, cuts, strict=True)], None
    for k in range(1, len(cuts[0])):
        while len(cuts[-1]) <= k:
            cuts.pop()
        live = list(zip(texts, cuts, strict=False))
        yield [t[c[k - 1] : c[k]] for t, c in live], [t[max(0, c[k - 1] - 8) : c[k - 1]].rjust(8, b"\0") for t, c in live]


def _hashed(pieces: list[bytes], bits: int, before: list[bytes] | None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """As nibbles(), block by block."""
    out, done, size = [], 0, 0
    for block in _pieces(pieces, BLOCK):
        nibble, cells, start = nibbles(block, bits, before[done : done + len(block)]) if before else nibbles(block, bits)
        out.append((nibble, cells, start[:-1] + size))
        done, size = done + len(block), size + len(nibble)
    nibble, cells, start = zip(*out, strict=True)
    return np.concatenate(nibble), [np.concatenate(c) for c in zip(*cells, strict=True)], np.append(np.concatenate(start), size)


def logits(counts: np.ndarray) -> np.ndarray:
    """Rows of 16 nibble counts -> rows of 16 signed bytes: the logits of nodes 1 to 15."""
    out = np.zeros(counts.shape, np.int8)
    level = counts.astype(np.float64)
    for depth in (3, 2, 1, 0):
        ones, zeros = level[:, 1::2] + 0.3, level[:, 0::2] + 0.3
        out[:, 1 << depth : 2 << depth] = np.clip(np.round(np.log(ones / zeros) * STEPS), -127, 127)
        level = level[:, 0::2] + level[:, 1::2]
    return out


def paths(table: np.ndarray) -> np.ndarray:
    """Of every cell the four logits on the way to its nibble, as one 32-bit word."""
    nibble = np.arange(16)
    nodes = np.stack([np.ones(16, int), 2 + (nibble >> 3), 4 + (nibble >> 2), 8 + (nibble >> 1)], axis=1)
    return np.ascontiguousarray(table[:, nodes]).view(np.uint32).reshape(-1)


@dataclass
class Model:
    """What texts are scored by: of each context its logits in a table of rows of 16 signed bytes,
    or for contexts beyond the tables, known: what gives cells their paths."""

    tables: list[bytes]

    def ready(self) -> list[np.ndarray]:
        if not hasattr(self, "_paths"):
            self._paths = [paths(np.frombuffer(t, np.int8).reshape(-1, 16)) for t in self.tables]
        return self._paths

    def _score(self, texts: list[bytes], bits: int = ROW_BITS, known: list[Callable[[np.ndarray], np.ndarray]] | None = None) -> np.ndarray:
        """log10 probability of each stream. Equal ones are scored once, up to LANES in step."""
        apart = sorted(set(texts), key=lambda t: (-cost(t), t))
        tables, total = self.ready(), np.zeros(len(apart))
        for first in range(0, len(apart), LANES):
            lanes = apart[first : first + LANES]
            mixer = _Mixer(len(lanes), len(ORDERS))
            for pieces, before in _windows(lanes, max(256, WINDOW // len(lanes))):
                nibble, cells, start = _hashed(pieces, bits, before)
                outputs = [t.take(c, mode="clip") for t, c in zip(tables, cells, strict=False)]
                outputs += [look_up(asked) for look_up, asked in zip(known or [], cells[len(tables) :], strict=True)]
                mixer.go(nibble, outputs, start[:-1], np.diff(start))
            total[first : first + len(lanes)] = mixer.total
        number = dict(zip(apart, (total / math.log(10)).tolist(), strict=True))
        return np.array([number[t] for t in texts])


#: A nibble's bits, one a byte.
_BITS = (np.arange(16)[:, None] >> np.array([3, 2, 1, 0]) & 1).astype(np.int8).view(np.int32).reshape(-1)


class _Mixer:
    """Weights, maps, and the natural logarithm of the probability so far, of lanes that go through
    their texts together, window by window."""

    def __init__(self, lanes: int, inputs: int):
        edges = 1 / (1 + np.exp(-np.linspace(-8, 8, _MAP_BINS)))
        self.weight = np.full((inputs, lanes, 4), START, np.float32)
        self.map = np.tile(edges.astype(np.float32), (lanes, 4, 1))
        self.total = np.zeros(lanes)

    def go(self, nibble: np.ndarray, outputs: list[np.ndarray], begin: np.ndarray, length: np.ndarray) -> None:
        """The first lanes go on by length nibbles from begin."""
        order = np.argsort(-length, kind="stable")
        weight, table, total = self.weight.take(order, axis=1), self.map.take(order, axis=0), self.total.take(order)
        _mix_lanes(nibble, outputs, begin[order], length[order], weight.reshape(len(weight), -1), table.reshape(-1), total)
        self.weight[:, order], self.map[order], self.total[order] = weight, table, total


def _mix_lanes(nibble: np.ndarray, outputs: list[np.ndarray], begin: np.ndarray, length: np.ndarray, weight: np.ndarray, table: np.ndarray, total: np.ndarray) -> None:
    """Lanes come longest first, and go through length nibbles from begin together; weight, table
    and total are changed in place."""
    lanes, inputs = len(begin), len(outputs)
    base = np.arange(4 * lanes) * _MAP_BINS + _MAP_BINS // 2
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    # what a step needs, side by side
    upto = np.cumsum(active)
    at = np.arange(upto[-1]) - np.repeat(upto - active, active)
    at = begin.take(at)
    at += np.repeat(np.arange(len(active)), active)
    bits = _BITS.take(nibble.take(at)).view(np.int8).astype(np.float32)
    found = np.empty((inputs, 4 * len(at)), np.int8)
    for k in range(inputs):
        outputs[k].take(at, out=found[k].view(np.uint32), mode="clip")
    true = np.empty(4 * len(at), np.float32)  # the probability of what came true
    del at
    inputs_, products, mixed, spare = (np.empty((k, 4 * lanes), np.float32) for k in (inputs, inputs, 1, 1))
    end = 0
    for n in active.tolist():
        start, end = end, end + 4 * n
        w, x, product, dot, part, bit = weight[:, : 4 * n], inputs_[:, : 4 * n], products[:, : 4 * n], mixed[0, : 4 * n], spare[0, : 4 * n], bits[start:end]
        x[...] = found[:, start:end]
        np.multiply(w, x, out=product)
        np.add.reduce(product, axis=0, out=dot)
        np.minimum(dot, 8 * STEPS, out=dot)
        np.maximum(dot, -8 * STEPS, out=dot)
        cell = np.floor(np.multiply(dot, (_MAP_BINS - 1) / 16 / STEPS, out=part), out=part).astype(np.int64)
        cell += base[: 4 * n]
        dot *= -1 / STEPS
        np.exp(dot, out=dot)
        dot += 1
        p = np.reciprocal(dot, out=dot)
        q = table.take(cell, mode="clip")
        np.subtract(bit, q, out=part)
        part *= MAP_RATE
        part += q
        table[cell] = part
        q -= p
        q *= MAP_SHARE
        q += p
        np.add(q, bit, out=true[start:end])
        p -= bit
        p *= RATE / STEPS
        x *= p
        w -= x
    true -= 1  # or its negative
    true = true.reshape(-1, 4)
    logs = np.log(np.abs(true[:, 0] * true[:, 1] * true[:, 2] * true[:, 3], dtype=np.float64))
    end = 0
    for n in active.tolist():
        start, end = end, end + n
        total[:n] += logs[start:end]


def held_out(id_col: str, modulus: int = 10) -> Column:
    """Whether a row is never learnt from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == 0, F.lit(True))


def _by_length(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows dealt out to partitions of about WIDE_CHUNK bytes, in order of length; the bytes of all
    and of those that are learnt. Of the lengths, only sums for each eighth of a power of two, at
    most some 250 numbers, come to the driver."""
    grade = F.floor(F.log2(F.length("bytes") + 1) * 8).cast("int")
    sums = rows.groupBy(grade.alias("grade")).agg(F.sum(F.length("bytes") + 1).alias("size"), F.sum(F.when(~F.col("held"), F.length("bytes"))).alias("learnt")).orderBy("grade").collect()
    if not sums:
        return rows, 0, 0
    volume, learnt, ends, upto = sum(s["size"] for s in sums), sum(s["learnt"] or 0 for s in sums), {}, 0
    for s in sums:
        ends[s["grade"]] = (upto / volume, s["size"] / volume)
        upto += s["size"]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(volume / WIDE_CHUNK))
    begin, width = (F.element_at(F.create_map(*[F.lit(x) for g, e in ends.items() for x in (g, e[k])]), grade) for k in (0, 1))
    spread = F.pmod(F.xxhash64("id", "bytes"), F.lit(1 << 20)) / (1 << 20)
    part = F.least(F.floor((begin + width * spread) * parts), F.lit(parts - 1)).cast("int")
    return rows.repartitionById(parts, part), volume, learnt


def _chunks(rows: DataFrame) -> DataFrame:
    """part, streams (one after the other, packed), sizes, and rows (the texts' id and held)."""
    names = ["part", "streams", "sizes", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        streams, own, size = [], [], 0

        def shut() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own[0].schema) as out:
                for o in own:
                    out.write_batch(o)
            sizes = np.array([len(s) for s in streams], "<u4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([x], pa.binary()) for x in (zstandard.compress(b"".join(streams), 3), sizes, sink.getvalue().to_pybytes()))], names=names)

        for batch in batches:
            first = 0
            for k, text in enumerate(batch.column("bytes")):
                streams.append(stream(text.as_py()))
                size += len(streams[-1])
                if 2 * size > 3 * WIDE_CHUNK:
                    own.append(batch.select(["id", "held"]).slice(first, k + 1 - first))
                    yield shut()
                    streams, own, size, first, part = [], [], 0, k + 1, part + 1
            if first < batch.num_rows:
                own.append(batch.select(["id", "held"]).slice(first))
        if streams:
            yield shut()

    return rows.mapInArrow(run, "part long, streams binary, sizes binary, rows binary")


def _open(streams: bytes, sizes: bytes, rows: bytes) -> tuple[list[bytes], pa.Table]:
    flat, ends = zstandard.decompress(streams), np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
    with pa.ipc.open_stream(rows) as own:
        return [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)], own.read_all()


#: What a chunk asks a bucket for: cells (steps from the bucket's first) or tokens, and how often
#: the chunk has learnt each.
_ASKED = "part long, bucket int, a binary, b binary"


def _asked(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "bucket", "a", "b"])


@dataclass(frozen=True)
class _Buckets:
    """bits: those of long contexts' rows. counts: of each context, then of tokens, the number of
    its buckets; they are numbered one after the other."""

    bits: int
    counts: tuple[int, ...]

    def first(self, kind: int) -> int:
        return sum(self.counts[:kind])

    def edges(self, kind: int) -> np.ndarray:
        """The first cell of each bucket of a context, and what ends the last."""
        bits = self.bits if ORDERS[kind] > SHORT else ROW_BITS
        return np.array([(b << bits) // self.counts[kind] << 4 for b in range(self.counts[kind] + 1)])

    def kind(self, bucket: int) -> int:
        return int(np.searchsorted(np.cumsum(self.counts), bucket, side="right"))


def _context_requests(chunks: DataFrame, plan: _Buckets) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, *packed = (c[k].as_py() for c in batch.columns)
                streams, own = _open(*packed)
                held = own["held"].to_pylist()
                tallies = [_Tally() for _ in ORDERS]
                for learnt in (True, False):
                    for piece in _pieces([t for t, out in zip(streams, held, strict=True) if out != learnt], PIECE):
                        for tally, cell in zip(tallies, _hashed(piece, plan.bits, None)[1], strict=True):
                            tally.add(cell, learnt)
                for kind, tally in enumerate(tallies):
                    tally.merge()
                    edges = plan.edges(kind)
                    cuts = np.searchsorted(tally.cells, edges)
                    rows = []
                    for b in np.nonzero(np.diff(cuts))[0].tolist():
                        mine = slice(cuts[b], cuts[b + 1])
                        rows.append((part, plan.first(kind) + b, _pack(np.diff(tally.cells[mine], prepend=edges[b])), _pack(tally.counts[mine])))
                    yield _asked(rows)

    return chunks.mapInArrow(run, _ASKED)


def _per_bucket(asked: DataFrame, buckets: int, answer, schema: str) -> DataFrame:
    """answer(bucket, rows) for all rows of each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for part, bucket, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and bucket != now:
                    yield from answer(now, rows)
                    rows = []
                now = bucket
                rows.append((part, a, b))
        if rows:
            yield from answer(now, rows)

    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _context_answers(asked: DataFrame, plan: _Buckets) -> DataFrame:
    """To every request its cells as they were, and in place of counts the paths by all counts."""
    def answer(bucket: int, rows: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        kind = plan.kind(bucket)
        begin = plan.edges(kind)[bucket - plan.first(kind)]
        asked = [np.cumsum(_unpack(a)) + begin for _, a, _ in rows]
        found, place = distinct(np.concatenate(asked) - begin)
        found += begin
        count = np.bincount(place, np.concatenate([_unpack(b) for *_, b in rows]), minlength=len(found))
        context = np.cumsum(np.diff(found >> 4, prepend=-1) != 0) - 1
        known = np.empty(len(found), np.uint32)
        for first in range(0, int(context[-1]) + 1, BLOCK):
            mine = slice(*np.searchsorted(context, (first, first + BLOCK)))
            cell = (context[mine] - first) << 4 | found[mine] & 15
            table = np.zeros(16 * (int(cell[-1] >> 4) + 1))
            table[cell] = count[mine]
            known[mine] = paths(logits(table.reshape(-1, 16))).take(cell)
        ends = np.cumsum([len(x) for x in asked])
        for (part, a, _), cells, end in zip(rows, asked, ends.tolist(), strict=True):
            own = np.ascontiguousarray(known.take(place[end - len(cells) : end]).astype("<u4").view(np.uint8).reshape(-1, 4).T)
            yield _asked([(part, bucket, a, zstandard.compress(own.tobytes(), 1))])

    return _per_bucket(asked, plan.first(len(ORDERS)), answer, _ASKED)


def _token_requests(chunks: DataFrame, plan: _Buckets) -> DataFrame:
    """Tokens go by their 64-bit hashes; of two that share one the counts would be summed."""
    first, buckets = plan.first(len(ORDERS)), plan.counts[-1]
    edges = _token_edges(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, *packed = (c[k].as_py() for c in batch.columns)
                streams, own = _open(*packed)
                held = own["held"].to_pylist()
                tally = _Tally()
                for learnt in (True, False):
                    for piece in _pieces([t for t, out in zip(streams, held, strict=True) if out != learnt], PIECE):
                        tally.add(token_keys(piece)[0], learnt)
                tally.merge()
                tokens, count = tally.cells, tally.counts
                cuts = np.append(np.searchsorted(tokens, edges), len(tokens))
                yield _asked([(part, first + b, _pack(np.diff(tokens[cuts[b] : cuts[b + 1]], prepend=edges[b])), _pack(count[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts)).tolist()])

    return chunks.mapInArrow(run, _ASKED)


def token_keys(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the streams' tokens, stream by stream with the end as its last, and the number of
    each stream's. A hash is of 63 bits; no token but the end has hash 0."""
    hashed, size = hash_words(streams)
    hashed = np.maximum((hashed >> _U(1)).view(np.int64), 1)
    ends = np.cumsum(size + 1) - 1
    out = np.zeros(len(hashed) + len(size), np.int64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = hashed
    return out, size + 1


def _token_edges(buckets: int) -> np.ndarray:
    """The first hash of each bucket of tokens."""
    return np.array([(b << 63) // buckets for b in range(buckets)])


def _token_answers(asked: DataFrame, plan: _Buckets) -> DataFrame:
    """To every request its tokens as they were, and their counts over all chunks; in one row of a
    bucket also how many tokens it has learnt, and how many different ones."""
    def answer(bucket: int, rows: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        tokens = [np.cumsum(_unpack(a)) for _, a, _ in rows]  # from the bucket's first
        found, place = distinct(np.concatenate(tokens))
        total = np.bincount(place, np.concatenate([_unpack(b) for *_, b in rows]), minlength=len(found)).astype(np.int64)
        end = 0
        for k, (part, a, _) in enumerate(rows):
            begin, end = end, end + len(tokens[k])
            own = _asked([(part, bucket, a, _pack(total.take(place[begin:end])))])
            sums = ((total > 0).sum(), total.sum()) if k == 0 else (0, 0)
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([int(x)], pa.int64()) for x in sums)], names=[*own.schema.names, "v", "n"])

    return _per_bucket(asked, plan.counts[-1], answer, f"{_ASKED}, v long, n long")


def _scores(chunks: DataFrame, answers: DataFrame, plan: _Buckets, kind: str) -> DataFrame:
    """id, held, n_tokens, n_known, summed (the sum over tokens of log10(c + 0.1)), size, score."""
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.sort_by("bucket")
        numbers = right["bucket"].to_numpy()
        for k in range(left.num_rows):
            streams, own = _open(*(left[c][k].as_py() for c in ("streams", "sizes", "rows")))
            known = []
            for context in range(len(ORDERS)):
                edges, cells, path = plan.edges(context), [], []
                for r in np.flatnonzero((numbers >= plan.first(context)) & (numbers < plan.first(context + 1))).tolist():
                    cells.append(np.cumsum(_unpack(right["a"][r].as_py())) + edges[numbers[r] - plan.first(context)])
                    path.append(np.ascontiguousarray(np.frombuffer(zstandard.decompress(right["b"][r].as_py()), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1))
                known.append(looked_up(np.concatenate(cells), np.concatenate(path)))
            scored = Model([])._score(streams, plan.bits, known)
            edges, keys, count = _token_edges(plan.counts[-1]), [], []
            for r in np.flatnonzero(numbers >= plan.first(len(ORDERS))).tolist():
                keys.append(np.cumsum(_unpack(right["a"][r].as_py())) + edges[numbers[r] - plan.first(len(ORDERS))])
                count.append(_unpack(right["b"][r].as_py()))
            counted = probed(np.concatenate(keys), np.concatenate(count))
            pieces = [token_keys(piece) for piece in _pieces(streams, PIECE)]
            tokens, c = np.concatenate([x[1] for x in pieces]), np.concatenate([counted(x[0]) for x in pieces])
            first = np.cumsum(tokens) - tokens  # no text lacks its end
            columns = {"n_tokens": tokens, "n_known": np.add.reduceat((c > 0).astype(np.int64), first), "summed": np.add.reduceat(np.log10(c + 0.1), first), "size": [len(t) for t in streams], "score": scored}
            for name, values in columns.items():
                own = own.append_column(name, pa.array(values, pa.float64() if name in ("summed", "score") else pa.int64()))
            out.append(own)
        return pa.concat_tables(out) if out else made.empty_table()

    schema = f"id {kind}, held boolean, n_tokens long, n_known long, summed double, size long, score double"
    made = pa.schema([(n, pa.null()) for n in ("id", "held", "n_tokens", "n_known", "summed", "size", "score")])
    return chunks.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, schema)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10) -> DataFrame:
    """id_col, held_out boolean, n_tokens, n_known, train_tokens long, base_score, score double,
    bits_per_byte double of every row.

    Rows whose crc32(id as text) mod modulus is 0 are held out; all others are learnt from.
    base_score is the unigram's: the sum over tokens of log10((c+0.1)/(N+0.1*(V+1))). score is the
    mixed model's log10 probability of the token sequence; bits_per_byte is that in bits by the
    bytes of its stream. A null text counts as empty (one token: the end); a null id as held out;
    repeated rows are all learnt from and score alike; texts of any length are read whole; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, modulus).alias("held"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    dealt, volume, learnt = _by_length(rows)
    chunks = materialise(_chunks(dealt), "lm-chunks")
    buckets = max(1, math.ceil(volume / BUCKET_BYTES))
    bits = min(56, max(ROW_BITS, math.ceil(math.log2(max(1, WIDE * learnt)))))
    plan = _Buckets(bits, (*(math.ceil(buckets / SHARES.get(order, 1)) for order in ORDERS), buckets))
    counts = materialise(_token_answers(_token_requests(chunks, plan), plan), "lm-tokens")
    sums = counts.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    v, n = sums["v"] or 0, sums["n"] or 0
    answers = _context_answers(_context_requests(chunks, plan), plan).union(counts.select("part", "bucket", "a", "b"))
    scored = _scores(chunks, answers, plan, docs.schema[id_col].dataType.simpleString())
    unigram = F.col("summed") - F.col("n_tokens") * math.log10(n + 0.1 * (v + 1))
    return scored.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), unigram.alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("size")).alias("bits_per_byte"))
