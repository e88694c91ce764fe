"""Exact set-similarity join of texts by Jaccard similarity of their token sets.

A unit is a document or a line; its tokens are the distinct k-word shingles of its words (a
shorter unit is one token). The join takes five steps, none of which holds a group of unbounded
size in one task or emits the pairs within a group:

1. rarity: over all units, counts of hashed words and a bitmap of the hashed tokens that occur
   twice or more, both of bounded size, give every token a place in one global order: those that
   occur once, then those with the rarest words first;
2. units: of every unit the number of tokens, a 128-bit signature of its set (units of equal sets
   are one class from here on), and its prefix: the n - ceil(t*n) + 1 rarest tokens, of which two
   units of similarity t or more share one at least;
3. candidates: classes that share a prefix token are joined to the least of them, token by token,
   within each task first; connected components of these stars are the candidate groups;
4. linking: within a group, a prefix index with length, positional and suffix filters finds
   candidate pairs, each of which is verified once, and only if its outcome still matters. Groups
   beyond a block's size are dealt out as pairs of blocks;
5. results: component of each class, or whether an earlier class matches it.

Candidate tokens travel as packed arrays, so that Spark shuffles few rows; a false match between
them costs a comparison and never changes a result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Hash buckets of the word counts, and the pages in which they are summed.
WORD_BITS, PAGES = 22, 64
#: Bits of the bitmap: about one for each word of the input, within these powers of two.
LEAST_BITS, MOST_BITS = 20, 30
#: Bytes of text that are turned into tokens at once; longer texts are taken one by one.
CHUNK = 1 << 20
#: Prefix tokens that a task keeps, to find stars among them, before it deals them out.
PREFIXES = 1 << 20
#: Bytes of a word that are hashed in steps of eight, all words together; the rest goes at once.
HEAD = 64
#: A group with more units or tokens than this is dealt out as pairs of blocks.
BLOCK_UNITS, BLOCK_TOKENS = 4096, 3_000_000
#: Bins of the suffix filter.
BINS = 16

_U = np.uint64
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x + _U(salt)) * _ODD[0]
    x ^= x >> _U(29)
    x = x * _ODD[1]
    x ^= x >> _U(32)
    return x


#: Odd multipliers of a shingle's words, by place.
_POWERS = mix(np.arange(1, 65, dtype=np.uint64), 77) | _U(1)


def words(unit: bytes) -> list[bytes]:
    """A-Z lower-cased runs of bytes other than 9-13 and 32."""
    return unit.lower().split()


def whole(text: bytes) -> list[bytes]:
    """A document as one unit."""
    return [text]


def lines(text: bytes) -> list[bytes]:
    """The units of a document cut at line feeds."""
    return text.split(b"\n")


@dataclass(frozen=True)
class Join:
    """k words a shingle; two units link if 100 * intersection >= percent * union; cut makes units
    of a text."""

    k: int
    percent: int
    cut: Callable[[bytes], list[bytes]] = whole

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.percent * n // 100) + 1

    def links(self, both: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
        return 100 * both >= self.percent * (n + m - both)


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hash_words(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the units, one after the other, and each unit's number of
    words. Words are hashed eight bytes a step, all of them together."""
    joined = b"\n" + b"\n".join(units).lower() + b"\n"
    letters = np.frombuffer(joined, np.uint8)
    inside = (letters != 32) & ((letters - np.uint8(9)) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, size = edges[0::2], edges[1::2] - edges[0::2]
    ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1) + 1
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    hashed = size.astype(np.uint64)
    eights = np.ndarray((len(letters),), "<u8", joined + bytes(8), strides=(1,))
    for begin in range(0, len(start), CHUNK):
        chosen = slice(begin, begin + CHUNK)
        first, length, out = start[chosen], size[chosen], hashed[chosen]
        near = np.ascontiguousarray(eights[first[0] : first[-1] + HEAD])
        at, rest = first - first[0], np.arange(len(first))
        for step in range(0, HEAD, 8):
            out[rest] = mix(out[rest] ^ near[at[rest] + step] & _MASK[np.minimum(length[rest] - step, 8)], step)
            rest = rest[length[rest] > step + 8]
            if not len(rest):
                break
        for k in rest.tolist():
            out[k] = xxhash.xxh3_64_intdigest(joined[first[k] : first[k] + length[k]])
    return hashed, counts


@dataclass(frozen=True)
class Rarity:
    """words: of each of 2**WORD_BITS hash buckets 0 if its words occur once or never, else 1 and
    more, growing with the logarithm of the count, up to 255. twice: a bitmap of 2**bits hash
    buckets, set where tokens occur more than once. Whatever shares a bucket makes a token seem
    less rare than it is, never rarer."""

    words: np.ndarray
    twice: np.ndarray
    bits: int


def _hashed(batch: pa.RecordBatch, join: Join) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and tokens, with repeats, of the units of a batch of texts."""
    for _, _, units in chunks(join, ((None, b.as_py()) for b in batch.column(0))):
        hashed, size = hash_words(units)
        full, short = _tokens(join, hashed, size)
        yield hashed, np.concatenate([full[1], short[1]])


def _packed(page: np.ndarray) -> bytes:
    return zstandard.compress(page.tobytes(), 1)


def _unpacked(page: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(page), kind)


def _cells(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a bitmap and their bits, of ascending bit numbers."""
    cell, bit = at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    return cell[first], np.bitwise_or.reduceat(bit, first) if len(at) else bit


def measure_rarity(texts: DataFrame, join: Join) -> Rarity:
    """Counts over all rows of texts (column bytes). Tasks count into tables of their own, pages of
    which are summed on the executors; the driver gets one byte a word bucket and one bit a token
    bucket."""
    volume = texts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(volume, 1) / 4))))
    width = (1 << bits) // 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros(1 << WORD_BITS, np.uint32), False
        once, twice = np.zeros(width, np.uint8), np.zeros(width, np.uint8)
        for batch in batches:
            for hashed, token in _hashed(batch, join):
                some = True
                np.add.at(table, (hashed >> _U(64 - WORD_BITS)).astype(np.int64), np.uint32(1))
                at = np.sort(_bucket(token, bits))
                new = np.diff(at, prepend=-1) != 0
                again, more = _cells(at[~new])
                twice[again] |= more
                cell, bit = _cells(at[new])
                known = once[cell]
                twice[cell] |= known & bit
                once[cell] = known | bit
        if some:
            pack = [[_packed(p) for p in t.reshape(PAGES, -1)] for t in (table, once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PAGES), pa.int32()), *(pa.array(x, pa.binary()) for x in pack)], names=["page", "words", "once", "twice"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for page, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words_, once, twice = (_unpacked(x, t) for x, t in zip(packed, (np.uint32, np.uint8, np.uint8), strict=True))
                if page in sums:
                    had = sums[page]
                    sums[page] = [had[0] + words_, had[1] | once, had[2] | twice | had[1] & once]
                else:
                    sums[page] = [words_.astype(np.int64), once, twice]
        for page, (words_, _, twice) in sums.items():
            scale = np.minimum(255, np.where(words_ > 1, np.log2(np.maximum(words_, 1)) * 8 - 7, 0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([scale.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())], names=["page", "words", "twice"])

    summed = texts.select("bytes").mapInArrow(count, "page int, words binary, once binary, twice binary").repartition(PAGES, "page").mapInArrow(add, "page int, words binary, twice binary")
    with small_batches(texts.sparkSession):
        pages = summed.collect()
    table, twice = np.zeros((PAGES, (1 << WORD_BITS) // PAGES), np.uint8), np.zeros((PAGES, width // PAGES), np.uint8)
    for page in pages:
        table[page["page"]], twice[page["page"]] = np.frombuffer(page["words"], np.uint8), np.frombuffer(page["twice"], np.uint8)
    return Rarity(table.reshape(-1), twice.reshape(-1), bits)


def _bucket(token: np.ndarray, bits: int) -> np.ndarray:
    return (token >> _U(64 - bits)).astype(np.int64)


def _tokens(join: Join, hashed: np.ndarray, size: np.ndarray) -> tuple[tuple, tuple]:
    """Owner, token and first word of the shingles, then of the units shorter than a shingle."""
    k = join.k
    unit = np.repeat(np.arange(len(size)), size)
    count = max(0, len(hashed) - k + 1)
    token = hashed[:count] * _POWERS[0]
    for j in range(1, k):
        token += hashed[j : j + count] * _POWERS[j % len(_POWERS)] + _U(j)
    inside = np.nonzero(unit[:count] == unit[k - 1 : k - 1 + count])[0]
    short = np.nonzero((size > 0) & (size < k))[0]
    begin = (np.cumsum(size) - size)[short]
    digest = [xxhash.xxh3_64_intdigest(hashed[b : b + n].tobytes()) for b, n in zip(begin, size[short], strict=True)]
    return (unit[inside], mix(token[inside]), inside), (short, mix(np.array(digest, np.uint64), 99), begin)


def token_sets(join: Join, units: list[bytes], rarity: Rarity | None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of units: (starts, keys), where unit u's distinct keys, ascending, are
    keys[starts[u]:starts[u+1]]. The first byte of a key is its rarity, 0 for a token that occurs
    once (1 for all without tables)."""
    hashed, size = hash_words(units)
    full, short = _tokens(join, hashed, size)
    owner, token, at = (np.concatenate(x) for x in zip(full, short, strict=True))
    if rarity is None:
        least = np.ones(len(token), np.uint8)
    else:
        rare = rarity.words[(hashed >> _U(64 - WORD_BITS)).astype(np.int64)]
        span = rare[: max(0, len(rare) - join.k + 1)].copy()
        for j in range(1, join.k):
            np.minimum(span, rare[j : j + len(span)], out=span)
        few = [rare[b : b + size[u]].min() for u, b in zip(short[0], short[2], strict=True)]
        least = np.concatenate([span[full[2]], np.array(few, np.uint8)])
        cell = _bucket(token, rarity.bits)
        least[rarity.twice[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 0] = 0
    key = least.astype(np.uint64) << _U(56) | token >> _U(8)
    order = np.argsort(owner.astype(np.uint64) << _U(40) | key >> _U(24))
    owner, key = owner[order], key[order]
    if np.any((owner[1:] == owner[:-1]) & (key[1:] < key[:-1])):  # keys that differ in the last bits only
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    owner, key = owner[first], key[first]
    return np.searchsorted(owner, np.arange(len(units) + 1)), key


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of values between starts."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[starts[1:]] - total[starts[:-1]]


def signatures(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that depend only on a unit's set."""
    keys = keys & _U((1 << 56) - 1)
    return tuple(mix(_sums(mix(keys, salt), starts), salt).view(np.int64) for salt in (7, 1001))


def chunks(join: Join, texts: Iterator[tuple[object, bytes]]) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Units of (id, text) pairs with id and place in the text, in pieces of about CHUNK bytes."""
    ids, at, units, size = [], [], [], 0
    for ident, text in texts:
        found = join.cut(text)
        ids.extend([ident] * len(found))
        at.extend(range(len(found)))
        units.extend(found)
        size += len(text)
        if size > CHUNK:
            yield ids, at, units
            ids, at, units, size = [], [], [], 0
    if units:
        yield ids, at, units


#: Rows of the first pass: kind 0 is a unit; kind 1 packed prefix tokens for a bucket; kind 2
#: packed edges between classes that met within a task.
_PASS = "kind int, doc long, line int, n int, sig1 long, sig2 long, bucket int, a binary, b binary"


def _first_pass(docs: DataFrame, join: Join, rarity, buckets: int) -> DataFrame:
    def deal(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        token, node = mix(np.concatenate([t for t, _ in held])), np.concatenate([s for _, s in held])
        token, node, src, dst = star(token, node)
        if len(src):
            yield _rows(1, kind=pa.array([2], pa.int32()), a=pa.array([src.tobytes()], pa.binary()), b=pa.array([dst.tobytes()], pa.binary()))
        bucket = (token % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        short = (token >> _U(32)).astype("<u4")[order]
        node, cuts = node[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.nonzero(np.diff(cuts))[0]
        yield _rows(len(full), kind=pa.array(np.ones(len(full), np.int32)), bucket=pa.array(full.astype(np.int32)), a=pa.array([short[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()), b=pa.array([node[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), (b.as_py() for b in batch.column(1)), strict=True)
            for ids, at, units in chunks(join, pairs):
                starts, keys = token_sets(join, units, rarity.value)
                n = np.diff(starts)
                sig1, sig2 = signatures(starts, keys)
                rows = len(n)
                yield _rows(rows, kind=pa.array(np.zeros(rows, np.int32)), doc=pa.array(ids, pa.int64()), line=pa.array(at, pa.int32()), n=pa.array(n.astype(np.int32)), sig1=pa.array(sig1), sig2=pa.array(sig2))
                place = np.arange(len(keys)) - np.repeat(starts[:-1], n)
                chosen = place < np.repeat(join.prefix(n), n)
                chosen &= keys >> _U(56) > 0  # no other unit has the others
                held.append((keys[chosen], np.repeat(sig1, n)[chosen]))
                size += len(held[-1][0])
                if size > PREFIXES:
                    yield from deal(held)
                    held, size = [], 0
        if held:
            yield from deal(held)

    return docs.mapInArrow(run, _PASS)


_TYPES = {"kind": pa.int32(), "doc": pa.int64(), "line": pa.int32(), "n": pa.int32(), "sig1": pa.int64(), "sig2": pa.int64(), "bucket": pa.int32(), "a": pa.binary(), "b": pa.binary()}


def _rows(count: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(count, t)) for c, t in _TYPES.items()], names=list(_TYPES))


def star(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its least node, and the distinct edges from its other nodes to that one."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    least = node[first][np.cumsum(first) - 1] if len(token) else node
    apart = least != node
    edges = np.unique(np.stack([node[apart], least[apart]], axis=1), axis=0)
    return token[first], node[first], edges[:, 0].copy(), edges[:, 1].copy()


def _edges(passed: DataFrame, buckets: int) -> DataFrame:
    """Distinct edges src > dst between class numbers that share a prefix token."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.setdefault(bucket, []).append((np.frombuffer(a, "<u4"), np.frombuffer(b, np.int64)))
        for parts in held.values():
            _, _, src, dst = star(np.concatenate([t for t, _ in parts]), np.concatenate([s for _, s in parts]))
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], names=["src", "dst"])

    met = passed.where("kind = 1").select("bucket", "a", "b").repartition(buckets, "bucket").mapInArrow(meet, "src long, dst long")
    local = passed.where("kind = 2").select("a", "b").mapInArrow(unpack, "src long, dst long")
    return met.union(local).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(src, dst); component is the least node reachable.

    Every round takes the least label among neighbours, then the label of that label, until none
    changes; each round's labels are written to the shared folder."""
    both = materialise(edges.where("src != dst").union(edges.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "edges")
    labels = materialise(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("root"))
        after = materialise(least.join(jump, "new").select("node", F.least("new", "root").alias("component"), (F.least("new", "root") != F.col("old")).alias("moved")), "labels")
        labels = after.select("node", "component")
        if after.where("moved").isEmpty():
            return labels


class Group:
    """Links the units of one group (or of a pair of its blocks)."""

    def __init__(self, join: Join, sets: list[np.ndarray], block: np.ndarray | None = None):
        self.join = join
        self.order = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[u] for u in self.order]
        self.n = np.array([len(s) for s in sets], np.int64)
        self.block = block[self.order] if block is not None and len(set(block.tolist())) > 1 else None
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(df), np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(df))
        self.unique = int((df == 1).sum())  # ranks below this occur in one unit only
        owner = np.repeat(np.arange(len(sets)), self.n)
        ranks = rank[inverse]
        self.ranks = ranks[np.lexsort((ranks, owner))]
        self.bins = np.zeros((len(sets), BINS), np.int32)
        np.add.at(self.bins, (owner, self.ranks * BINS // max(len(df), 1)), 1)
        self.mark = np.zeros(len(df), bool)

    def run(self, needed: Callable[[int, np.ndarray], np.ndarray], link: Callable[[int, np.ndarray], None]) -> None:
        """For every unit in order of size, finds the smaller units that it could link with.
        needed(x, others) tells which pairs still matter; link(x, others) is told of links."""
        n, starts, ranks, percent = self.n, self.starts, self.ranks, self.join.percent
        prefix = self.join.prefix(n)
        place = np.arange(len(ranks)) - np.repeat(starts[:-1], n)
        indexed = (place < np.repeat(prefix, n)) & (ranks >= self.unique)
        room = np.bincount(ranks[indexed], minlength=len(self.mark))
        head = np.cumsum(room) - room
        fill = head.copy()
        unit_at, place_at = np.zeros(room.sum(), np.int64), np.zeros(room.sum(), np.int64)
        shared = np.zeros(len(n), np.int64)
        for x in range(len(n)):
            size = int(n[x])
            mine = ranks[starts[x] : starts[x] + prefix[x]]
            met = []
            for i, token in enumerate(mine):
                if token < self.unique:
                    continue
                span = slice(head[token], fill[token])
                others, places = unit_at[span], place_at[span]
                long_enough = 100 * n[others] >= percent * size  # length filter
                if not long_enough.all():
                    others, places = others[long_enough], places[long_enough]
                if len(others):
                    least = -(-percent * (n[others] + size) // (100 + percent))
                    most = np.maximum(shared[others], 0) + 1 + np.minimum(n[others] - places, size - i) - 1  # positional filter
                    shared[others] = np.where((most >= least) & (shared[others] >= 0), shared[others] + 1, -1)
                    met.append(others)
                unit_at[fill[token]], place_at[fill[token]] = x, i
                fill[token] += 1
            if not met:
                continue
            met = np.unique(np.concatenate(met))
            others = met[shared[met] > 0]
            shared[met] = 0
            if self.block is not None:
                others = others[self.block[others] != self.block[x]]
            others = others[needed(x, others)] if len(others) else others
            if len(others):
                least = -(-percent * (n[others] + size) // (100 + percent))
                apart = np.abs(self.bins[others] - self.bins[x]).sum(axis=1)
                others = others[apart <= n[others] + size - 2 * least]  # suffix filter
            self.mark[ranks[starts[x] : starts[x + 1]]] = True
            step = 16
            while len(others):
                now, others = others[-step:], others[:-step]
                where = np.concatenate([np.arange(starts[y], starts[y + 1]) for y in now])
                both = np.add.reduceat(self.mark[ranks[where]].astype(np.int64), np.concatenate([[0], np.cumsum(n[now])[:-1]]))
                linked = now[self.join.links(both, n[now], size)]
                if len(linked):
                    link(x, linked)
                    others = others[needed(x, others)] if len(others) else others
                step *= 2
            self.mark[ranks[starts[x] : starts[x + 1]]] = False


def _pair_links(join: Join, a: np.ndarray, b: np.ndarray) -> bool:
    short, long = sorted((len(a), len(b)))
    if 100 * short < join.percent * long:  # length filter
        return False
    return bool(join.links(np.array(len(np.intersect1d(a, b, assume_unique=True))), np.array(len(a)), len(b)))


def link_components(join: Join, sets: list[np.ndarray], block: np.ndarray | None = None) -> np.ndarray:
    """Least index of each unit's linked component."""
    if len(sets) == 2:  # most groups are one pair
        return np.array([0, 0 if _pair_links(join, *sets) else 1])
    group = Group(join, sets, block)
    label = np.arange(len(sets))

    def needed(x: int, others: np.ndarray) -> np.ndarray:
        return label[others] != label[x]

    def link(x: int, others: np.ndarray) -> None:
        joined = np.append(label[others], label[x])
        label[np.isin(label, joined)] = joined.min()

    group.run(needed, link)
    out = np.empty(len(sets), np.int64)
    for members in pd.Series(group.order).groupby(label).indices.values():
        out[group.order[members]] = group.order[members].min()
    return out


def link_earlier(join: Join, sets: list[np.ndarray], block: np.ndarray | None = None) -> np.ndarray:
    """Whether a unit links with one before it in the order given."""
    if len(sets) == 2:
        return np.array([False, _pair_links(join, *sets)])
    group = Group(join, sets, block)
    place, gone = group.order, np.zeros(len(sets), bool)

    def later(x: int, others: np.ndarray) -> np.ndarray:
        return np.where(place[others] > place[x], others, x)

    def link(x: int, others: np.ndarray) -> None:
        gone[later(x, others)] = True

    group.run(lambda x, others: ~gone[later(x, others)], link)
    out = np.empty(len(sets), bool)
    out[group.order] = gone
    return out


@dataclass(frozen=True)
class Classes:
    """units: doc, line, n, sig1, sig2 of every unit. classes: sig1, sig2, n and first, the
    struct(doc, line) of the first unit of each distinct set with tokens. linked: what step 4
    gives, for classes of candidate groups only: first and either root (the first unit of its
    component) or gone."""

    units: DataFrame
    classes: DataFrame
    linked: DataFrame


def similar_sets(docs: DataFrame, join: Join, mode: str, id_col: str = "doc_id", text_col: str = "text") -> Classes:
    """mode: components or earlier. Rows of docs with a null id take no part."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    rarity = spark.sparkContext.broadcast(measure_rarity(texts, join))  # at most 4 MB + 2**MOST_BITS bits
    buckets = 8 * max(8, texts.rdd.getNumPartitions())
    passed = materialise(_first_pass(texts, join, rarity, buckets), "units")
    rarity.destroy()  # nothing is made from it again
    units = passed.where("kind = 0").select("doc", "line", "n", "sig1", "sig2")
    classes = units.where("n > 0").groupBy("sig1", "sig2").agg(F.min(F.struct("doc", "line")).alias("first"), F.first("n").alias("n"))
    groups = components(_edges(passed, buckets))
    candidates = materialise(classes.join(groups, classes.sig1 == groups.node).select("component", "first", "n", "sig1", "sig2"), "candidates")
    sizes = candidates.groupBy("component").agg(F.count("*").alias("units"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("units") / BLOCK_UNITS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    sized = candidates.join(sizes.where("units > 1").select("component", blocks.alias("blocks")), "component")
    own = F.pmod(F.xxhash64("sig1", "sig2", F.lit(5)), F.col("blocks")).cast("int")
    dealt = sized.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "first", "sig1", "sig2")
    marks, bits = _marks(candidates.select("first.doc", "first.line"))
    shared = spark.sparkContext.broadcast(marks)
    linked = _link(_unit_texts(texts, join, dealt, shared, bits), join, mode)
    shared.destroy()
    if mode == "components":
        spread = linked.where("root != first")
        if sized.where("blocks > 1").isEmpty():
            linked = spread
        else:
            linked = _merge_roots(spread)
    else:
        linked = linked.where("gone").select("first", "gone").distinct()
    return Classes(units, classes, linked)


def _place(doc: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    return _bucket(mix(doc.astype(np.int64).view(np.uint64) ^ mix(line.astype(np.uint64), 5), 9), bits)


def _marks(units: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashed (doc, line), sixteen bits a unit up to 2**MOST_BITS, or-ed by page on the
    executors."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(1, units.count())))))
    width = (1 << bits) // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(width, np.uint8)
        for batch in batches:
            at = _place(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits)
            np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        pages = [(k, _packed(p)) for k, p in enumerate(table.reshape(PAGES, -1)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pages], pa.int32()), pa.array([p for _, p in pages], pa.binary())], names=["page", "bits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = _unpacked(packed, np.uint8)
                sums[page] = sums[page] | part if page in sums else part
        for page, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["page", "bits"])

    table = np.zeros((PAGES, width // PAGES), np.uint8)
    summed = units.mapInArrow(mark, "page int, bits binary").repartition(PAGES, "page").mapInArrow(add, "page int, bits binary")
    with small_batches(units.sparkSession):
        rows = summed.collect()
    for row in rows:
        table[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1), bits


def _unit_texts(texts: DataFrame, join: Join, dealt: DataFrame, shared, bits: int) -> DataFrame:
    """The units that dealt names, cut out of their documents' texts. A bitmap of the candidates
    keeps most other texts out of the shuffle; the join that follows decides."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lines_, found = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                units = join.cut(text.as_py())
                at = _place(np.array([doc]), np.arange(len(units)), bits)
                for k in np.nonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)[0].tolist():
                    docs.append(doc)
                    lines_.append(k)
                    found.append(units[k])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lines_, pa.int32()), pa.array(found, pa.binary())], names=["doc", "line", "bytes"])

    wanted = dealt.withColumn("doc", F.col("first.doc")).withColumn("line", F.col("first.line"))
    return texts.mapInArrow(cut, "doc long, line int, bytes binary").join(wanted, ["doc", "line"]).select("bytes", "component", "i", "j", "block", "first", "sig1", "sig2")


def _link(rows: DataFrame, join: Join, mode: str) -> DataFrame:
    out = "root struct<doc:long,line:int>" if mode == "components" else "gone boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("first", pa.struct([("doc", pa.int64()), ("line", pa.int32())])), (out.split(" ")[0], pa.struct([("doc", pa.int64()), ("line", pa.int32())]) if mode == "components" else pa.bool_())])
        held: list[dict] = []
        for table in _groups(batches, ["component", "i", "j"]):
            first, block = table["first"].to_pylist(), table["block"].to_numpy()
            starts, keys = token_sets(join, table["bytes"].to_pylist(), None)
            sig1, sig2 = signatures(starts, keys)
            # a document id that occurs with several texts brings texts of another class along
            right = (sig1 == table["sig1"].to_numpy()) & (sig2 == table["sig2"].to_numpy())
            number = table["group"].to_numpy()
            cuts = np.concatenate([[0], np.nonzero(np.diff(number))[0] + 1, [len(number)]])
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                kept = {(sig1[u], sig2[u]): u for u in range(begin, end) if right[u]}.values()
                if len(kept) < 2:
                    continue
                kept = sorted(kept, key=lambda u: (first[u]["doc"], first[u]["line"]))
                sets = [keys[starts[u] : starts[u + 1]] for u in kept]
                got = link_components(join, sets, block[kept]) if mode == "components" else link_earlier(join, sets, block[kept])
                for u, g in zip(kept, got.tolist(), strict=True):
                    held.append({made.names[0]: first[u], made.names[1]: first[kept[g]] if mode == "components" else g})
            if len(held) > 10_000:
                yield pa.RecordBatch.from_pylist(held, schema=made)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=made)

    parts = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return materialise(parts.mapInArrow(run, f"first struct<doc:long,line:int>, {out}"), "linked")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Whole runs of rows that agree in `by`, of batches that are sorted by it: as many runs a
    table as end within a batch, numbered in column group."""
    held: list[pa.RecordBatch] = []
    last, number = None, 0
    for batch in batches:
        keys = list(zip(*(batch[c].to_pylist() for c in by), strict=True))
        numbers = []
        for key in keys:
            number += key != last
            last = key
            numbers.append(number)
        batch = batch.append_column("group", pa.array(numbers, pa.int64()))
        cut = numbers.index(number)  # what lies before is complete
        if cut or (held and held[-1]["group"][-1].as_py() != number):
            done = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(done).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _merge_roots(linked: DataFrame) -> DataFrame:
    """Joins components that pairs of blocks found separately."""
    number = F.xxhash64(F.col("f.doc"), F.col("f.line"))
    names = linked.select(F.col("first").alias("f")).union(linked.select(F.col("root").alias("f"))).distinct().withColumn("node", number)
    edges = linked.select(F.xxhash64("first.doc", "first.line").alias("src"), F.xxhash64("root.doc", "root.line").alias("dst")).distinct()
    found = names.join(components(edges), "node")
    roots = found.groupBy("component").agg(F.min("f").alias("root"))
    return found.join(roots, "component").select(F.col("f").alias("first"), "root").where("root != first")
