"""Phrase collocations: frequent phrases by Apriori levels, counted with double-array tries.

Texts are cut once into blocks of local word numbers; words that are frequent in their language
get global ids, and everything else becomes a gap. Phrases of k words can only be frequent if
they are made of frequent shorter ones: such candidates go into double-array tries of a bounded
number of phrases, one of which is broadcast at a time. A trie's alphabet is six-bit digits of its
word numbers; numpy advances the states of all positions of a block together, level by level,
counts accepting states, and Spark sums the blocks' counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release, small_batches, text_bytes

#: Bytes of text that are cut into words together.
BLOCK = 4 << 20
#: Keys that a task holds before it merges and sends them, and places of the texts whose keys are
#: summed together.
HELD, SHARE = 1 << 19, 1 << 21
#: Stands for no further word; ids of words lie below it.
NONE = (1 << 32) - 1
#: Phrases of a trie, which bounds what is broadcast: some 60 bytes a phrase.
PHRASES = 1 << 19
#: Bits of a digit, so that the children of a trie's node fit a word of 64 bits.
DIGIT = 6

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes that part words, and those that part pieces.
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(BREAKS)] = 2


def _pack(values: np.ndarray, width: int) -> bytes:
    """Integers of `width` bytes, byte by byte, so that bytes that hardly differ stand together."""
    return values.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<i{width}").reshape(-1)


# --- words -------------------------------------------------------------------------------------


def split_text(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of at most `most` bytes cut behind a break; a piece longer than that stays whole."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(b, at, at + most) for b in (bytes([x]) for x in BREAKS))
        if cut < 0:
            cut = min((p for p in (text.find(bytes([x]), at + most) for x in BREAKS) if p >= 0), default=-1)
        if cut < 0:
            break
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def cut_words(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of data, the place where each starts, and whether a break lies before it."""
    folded = _FOLD[np.frombuffer(data, np.uint8)]
    kind = _KIND[folded]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(folded[inside])])
    breaks = np.flatnonzero(kind == 2)
    before = np.searchsorted(breaks, start)
    return words, start, np.diff(before, prepend=-1) > 0


def _numbered(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, list[str], pa.Array, np.ndarray]:
    """Local numbers of the words of texts, frequent words first, with -1 between pieces; and
    language, word and count of each number."""
    words, start, fresh = cut_words(b"\n".join(texts))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    names = sorted(set(langs))
    of = np.array([names.index(x) for x in langs], np.int64)[np.searchsorted(starts, start, side="right") - 1]
    coded = words.dictionary_encode()
    key, number, count = np.unique(coded.indices.to_numpy().astype(np.int64) * len(names) + of, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    key, count, place = key[order], count[order], np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    number = place[number]
    out = np.full(len(number) + int(fresh.sum()), -1, np.int32)
    out[np.arange(len(number)) + np.cumsum(fresh)] = number
    return out, [names[k] for k in key % len(names)], coded.dictionary.take(pa.array(key // len(names))), count


def _cut_blocks(docs: DataFrame) -> DataFrame:
    """block, codes (packed local numbers, -1 between pieces) and words (language, word
    and count of each local number)."""
    item = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, size, made = [], [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            codes, lang, word, count = _numbered(texts, langs)
            entries = pa.StructArray.from_arrays([pa.array(lang, pa.string()), word.cast(pa.string()), pa.array(count)], fields=list(item))
            listed = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([_pack(codes, 4)], pa.binary()), listed], names=["block", "codes", "words"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in split_text(text, BLOCK):
                    if texts and size + len(part) > BLOCK:
                        yield block()
                        texts, langs, size, made = [], [], 0, made + 1
                    texts.append(part)
                    langs.append(lang)
                    size += len(part) + 1
        if texts:
            yield block()

    return docs.mapInArrow(run, "block long, codes binary, words array<struct<lang:string,word:string,n:long>>")


def _with_ids(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """block, codes and ids: the blocks with frequent words only, an id of eight bytes for each
    local number. Words beside which no frequent word stands can't be in a phrase and go."""
    each = blocks.select("block", F.posexplode("words").alias("place", "w")).select("block", "place", "w.lang", "w.word")
    found = each.join(frequent.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = _unpack(batch.column(1)[row].as_py(), 4)
                entries = batch.column(2)[row].values
                place, ids = entries.field("place").to_numpy(), entries.field("id").to_numpy()
                order = np.argsort(place)
                local = np.full(max(codes.max(initial=-1), place.max(initial=-1)) + 2, -1, np.int32)  # the last is for -1
                local[place[order]] = np.arange(len(order))
                codes = local[codes]
                known = np.concatenate([[False], codes >= 0, [False]])
                beside = known[1:-1] & (known[:-2] | known[2:])
                codes = np.where(beside, codes, -1)
                codes = codes[beside | np.concatenate([[False], beside[:-1]])]  # of several gaps one
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([_pack(codes, 4)], pa.binary()), pa.array([_pack(ids[order], 8)], pa.binary())], names=["block", "codes", "ids"])

    return blocks.select("block", "codes").join(found, "block").mapInArrow(run, "block long, codes binary, ids binary")


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for codes, ids in zip(batch.column(0), batch.column(1), strict=True):
            yield _unpack(codes.as_py(), 4), _unpack(ids.as_py(), 8)


def _columns(k: int) -> list[str]:
    return [f"w{j}" for j in range(1, k + 1)]


def _schema(k: int) -> str:
    return ", ".join(f"{c} long" for c in _columns(k)) + ", n long"


# --- sums --------------------------------------------------------------------------------------


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)  # of a task's or a share's bounded number
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(counts[order], first)


class _Sums:
    """A task's counts by key, which leave it merged and dealt out by a hash of the key into shares."""

    def __init__(self, shares: int):
        self.shares, self.keys, self.counts, self.size = shares, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, counts = _merged(self.keys, self.counts)
            self.keys, self.counts = [], []
            share = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(self.shares)
            order = np.argsort(share, kind="stable")
            cuts = np.searchsorted(share[order], np.arange(self.shares + 1))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([_pack(np.diff(keys[order[a:b]], prepend=0), 8)], pa.binary()), pa.array([_pack(counts[order[a:b]], 8)], pa.binary())], names=["share", "keys", "counts"])
        self.keys, self.counts, self.size = [], [], 0


def _summed(packed: DataFrame, least: int, spell, k: int) -> DataFrame:
    """w1, ..., wk, n of the keys whose counts sum to at least `least`; spell gives the columns of
    keys. A share holds SHARE places of the texts on average."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(x.as_py(), 8)) for x in table.column("keys")]
        keys, n = _merged(keys, [_unpack(x.as_py(), 8) for x in table.column("counts")])
        kept = n >= least
        columns = spell(keys[kept])
        return pa.table([*columns, pa.array(n[kept])], names=[*_columns(k), "n"])

    return packed.groupBy("share").applyInArrow(run, _schema(k))


# --- tries -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trie:
    """A double-array trie over phrases of k words, each word `digits` digits of its symbol, which
    is its place in `symbols`. From the slot of a state its base leads to the slot of a child, and
    the child's check leads back. number: the phrase that a slot accepts, -1 for none."""

    k: int
    digits: int
    symbols: np.ndarray  # sorted word ids
    base: np.ndarray
    check: np.ndarray
    number: np.ndarray
    phrases: np.ndarray  # a row of word ids a phrase

    def spell(self, symbol: np.ndarray) -> list[np.ndarray]:
        return [(symbol >> DIGIT * (self.digits - 1 - d)) & 63 for d in range(self.digits)]

    def advance(self, state: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next slot of each state, and whether it has one."""
        base = self.base[state]
        slot = (base & -64) | ((base + digit) & 63)
        return slot, self.check[slot] == state

    def follow(self, codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in codes where a phrase starts, and the phrase. All places are advanced together,
        digit by digit, those without a state dropped on the way."""
        padded = np.concatenate([codes, np.full(self.k, -1, np.int32)])
        symbol = np.searchsorted(self.symbols, ids)
        known = np.append(self.symbols[np.minimum(symbol, len(self.symbols) - 1)] == ids, False)  # the last is for gaps
        spelt = [np.append(d, 0).astype(np.int32) for d in self.spell(symbol)]
        # the state behind a first word depends on the word alone
        word = np.flatnonzero(known)
        state = np.full(len(word), len(self.base) - 1, np.int32)
        for digit in spelt:
            state, alive = self.advance(state, digit[word])
            word, state = word[alive], state[alive]
        first = np.full(len(ids) + 1, -1, np.int32)
        first[word] = state
        at = np.flatnonzero(first[codes] >= 0)
        state = first[codes[at]]
        for j in range(1, self.k):
            next_word = padded[at + j]
            alive = known[next_word]
            at, state, next_word = at[alive], state[alive], next_word[alive]
            for digit in spelt:
                state, alive = self.advance(state, digit[next_word])
                at, state, next_word = at[alive], state[alive], next_word[alive]
        return at, self.number[state]


def _turned(mask: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64)
    return mask << by | mask >> (np.uint64(64) - by & np.uint64(63))


def _place(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """A base (window of 64 slots, and a turn within it) for each set of digits, so that no two
    sets take one slot; and the number of windows. Large sets get windows of their own, others try
    windows and turns at random, by falling size, and single digits fill what is left."""
    rnd = np.random.default_rng(1)
    count = np.bitwise_count(mask)
    base = np.zeros(len(mask), np.int64)
    large = np.flatnonzero(count > 16)
    middle = np.flatnonzero((count > 1) & (count <= 16))
    single = np.flatnonzero(count == 1)
    base[large] = np.arange(len(large)) * 64
    room = len(large) + math.ceil((count[middle].sum() * 1.7 + len(single)) / 64) + 1
    taken = np.zeros(room, np.uint64)
    taken[: len(large)] = mask[large]
    for size in range(16, 1, -1):
        left = middle[count[middle] == size]
        for _ in range(48):
            if not len(left):
                break
            window, turn = rnd.integers(0, len(taken), len(left)), rnd.integers(0, 64, len(left))
            bits = _turned(mask[left], turn)
            fits = np.flatnonzero(taken[window] & bits == 0)
            fits = fits[np.unique(window[fits], return_index=True)[1]]
            taken[window[fits]] |= bits[fits]
            base[left[fits]] = window[fits] * 64 + turn[fits]
            left = np.delete(left, fits)
        base[left] = (len(taken) + np.arange(len(left))) * 64
        taken = np.concatenate([taken, mask[left]])
    free = np.flatnonzero(~np.unpackbits(taken.astype("<u8").view(np.uint8), bitorder="little").astype(bool))
    if len(free) < len(single):
        more = math.ceil((len(single) - len(free)) / 64)
        free = np.concatenate([free, len(taken) * 64 + np.arange(more * 64)])
        taken = np.concatenate([taken, np.zeros(more, np.uint64)])
    slot, digit = free[: len(single)], np.log2(mask[single].astype(np.float64)).astype(np.int64)
    base[single] = (slot & -64) | ((slot - digit) & 63)
    return base, len(taken)


def build_trie(phrases: np.ndarray) -> Trie:
    """phrases: distinct rows of word ids in ascending order."""
    n, k = phrases.shape
    symbols = np.unique(phrases)
    digits = max(1, math.ceil(math.log2(max(len(symbols), 2)) / DIGIT))
    symbol = np.searchsorted(symbols, phrases)
    spelt = np.stack([(symbol[:, j] >> DIGIT * (digits - 1 - d)) & 63 for j in range(k) for d in range(digits)])
    # nodes by depth: a row starts a node where its prefix differs from the row before
    parent, digit, node = [], [], np.zeros(n, np.int64)
    differs, made = np.zeros(n, bool), 1
    differs[0] = True
    for column in spelt:
        differs[1:] |= column[1:] != column[:-1]
        rows = np.flatnonzero(differs)
        parent.append(node[rows])
        digit.append(column[rows])
        node = made + np.cumsum(differs) - 1
        made += len(rows)
    parent, digit = np.concatenate(parent), np.concatenate(digit)  # of the nodes from 1 on
    mask = np.zeros(made, np.uint64)
    np.bitwise_or.at(mask, parent, np.uint64(1) << digit.astype(np.uint64))
    inner = np.flatnonzero(mask)
    base_of = np.zeros(made, np.int64)
    base_of[inner], windows = _place(mask[inner])
    root = windows * 64
    slot_of = np.empty(made, np.int64)
    slot_of[0] = root
    slot_of[1:] = (base_of[parent] & -64) | ((base_of[parent] + digit) & 63)
    base, check, number = np.zeros(root + 1, np.int32), np.full(root + 1, -2, np.int32), np.full(root + 1, -1, np.int32)
    base[slot_of] = base_of
    check[slot_of[1:]] = slot_of[parent]
    number[slot_of[node]] = np.arange(n)
    return Trie(k, digits, symbols, base, check, number, phrases)


def _tries(candidates: DataFrame, k: int) -> Iterator[Trie]:
    """Tries over all candidates, given one at a time: each of those in a range of first two words,
    built in one task."""
    arrays = ("symbols", "base", "check", "number", "phrases")
    n_tries = max(1, math.ceil(candidates.count() / PHRASES))
    place = F.lit(0)
    if n_tries > 1:
        key = F.shiftleft("w1", 32).bitwiseOR(F.col("w2"))
        ends = candidates.agg(F.percentile_approx(key, [j / n_tries for j in range(1, n_tries)], 100 * n_tries)).first()[0]
        place = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e < key))

    def run(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(c).to_numpy() for c in _columns(k)], axis=1)
        trie = build_trie(rows[np.lexsort(rows.T[::-1])])
        return pa.table([pa.array([trie.digits]), *(pa.array([getattr(trie, a).tobytes()], pa.binary()) for a in arrays)], names=["digits", *arrays])

    grouped = candidates.select(place.alias("trie"), *_columns(k)).groupBy("trie")
    built = materialise(grouped.applyInArrow(run, "digits long, " + ", ".join(f"{a} binary" for a in arrays)), "tries")
    for row in built.toLocalIterator():  # one row of a bounded trie each
        yield Trie(k, row.digits, np.frombuffer(row.symbols, np.int64), *(np.frombuffer(row[a], np.int32) for a in arrays[1:4]), np.frombuffer(row.phrases, np.int64).reshape(-1, k))


# --- levels ------------------------------------------------------------------------------------


def _pairs(encoded: DataFrame, least: int, shares: int) -> DataFrame:
    """w1, w2, n of pairs of frequent words that stand side by side and can be frequent: a block's
    count is sent up to `least`, which is all that it takes to know that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(shares)
        for codes, ids in _encoded(batches):
            left, right = codes[:-1], codes[1:]
            both = (left >= 0) & (right >= 0)
            key, n = np.unique(left[both].astype(np.int64) * len(ids) + right[both], return_counts=True)
            if len(key):
                yield from sums.add(ids[key // len(ids)] << 32 | ids[key % len(ids)], np.minimum(n, least))
        yield from sums.flush()

    packed = encoded.select("codes", "ids").mapInArrow(run, "share long, keys binary, counts binary")
    return _summed(packed, least, lambda key: [pa.array(key >> 32), pa.array(key & NONE)], 2)


def _level(encoded: DataFrame, trie: Trie, least: int, shares: int, further: bool) -> DataFrame:
    """Counts of the trie's phrases over all blocks, as w1, ..., wk, n; with further also a column
    for one word more, and the phrases with one that can be frequent, as in _pairs."""
    shared, k = encoded.sparkSession.sparkContext.broadcast(trie), trie.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, sums = shared.value, _Sums(shares)
        total = np.zeros(len(trie.phrases), np.int64)
        for codes, ids in _encoded(batches):
            at, phrase = trie.follow(codes, ids)
            total += np.bincount(phrase, minlength=len(total))
            if further:
                following = np.append(codes, np.full(k, -1, np.int32))[at + k]
                some = following >= 0
                key, n = np.unique(phrase[some].astype(np.int64) * len(ids) + following[some], return_counts=True)
                if len(key):
                    yield from sums.add(key // len(ids) << 32 | ids[key % len(ids)], np.minimum(n, least))
        met = np.flatnonzero(total)
        if len(met):
            yield from sums.add(met << 32 | NONE, total[met])
        yield from sums.flush()

    def spell(key: np.ndarray) -> list[pa.Array]:
        last = key & NONE
        words = [pa.array(c) for c in shared.value.phrases[key >> 32].T]
        return words + [pa.array(last, mask=last == NONE)] if further else words

    packed = encoded.select("codes", "ids").mapInArrow(run, "share long, keys binary, counts binary")
    out = materialise(_summed(packed, least, spell, k + further), f"phrases{k}")
    shared.destroy()
    return out


def _numbered_words(words: DataFrame) -> DataFrame:
    """words with an id: 0, 1, ... over all rows."""
    spark = words.sparkSession
    kept = materialise(words.withColumn("_at", F.monotonically_increasing_id()), "frequent_words")
    part = F.shiftright("_at", 33)
    sizes = kept.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # a row a partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r._part, total))
        total += r["count"]
    if total >= NONE:
        raise ValueError("more frequent words than ids of 32 bits")
    before = spark.createDataFrame(starts, "_part long, _before long")
    return kept.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("id", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def count_phrases(docs: DataFrame, longest: int, least: int, text_col: str = "text", lang_col: str = "lang", lang_default: str = "und") -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The words of each language (lang, n of all occurrences), its frequent words (id, lang, word,
    f) and for 2, ..., longest words the phrases w1, ..., wk of ids with at least `least`
    occurrences a. All counts are exact and over all texts."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(lang_default)).alias("lang"), text_bytes(text_col).alias("bytes"))
    with small_batches(docs.sparkSession):
        blocks = materialise(_cut_blocks(rows), "word_blocks")
        each = blocks.select(F.explode("words").alias("w")).select("w.*")
        totals = materialise(each.groupBy("lang").agg(F.sum("n").alias("n")), "words_of_languages")
        frequent = _numbered_words(each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
        encoded = materialise(_with_ids(blocks, frequent), "encoded_blocks")
        release(blocks)
        shares = max(1, math.ceil((totals.agg(F.sum("n")).first()[0] or 0) / SHARE))
        candidates = materialise(_pairs(encoded, least, shares), "candidates2")
        found = []
        for k in range(2, longest + 1):
            parts = [_level(encoded, trie, least, shares, k < longest) for trie in _tries(candidates, k)]
            if not parts:
                level = docs.sparkSession.createDataFrame([], _schema(k + (k < longest)))
            else:
                level = reduce(DataFrame.unionAll, parts)
            if k < longest:
                longer = F.col(f"w{k + 1}")
                candidates = level.where(longer.isNotNull())
                level = level.where(longer.isNull()).drop(f"w{k + 1}")
            found.append(level.withColumnRenamed("n", "a"))
        release(encoded)
    return totals, frequent, found


def _mark_held(by_length: dict[int, DataFrame], percent: int) -> dict[int, DataFrame]:
    """The phrases of each length with a column kept: no longer phrase with at least percent percent
    of their occurrences holds their words side by side."""
    longest, out = max(by_length), {}
    for k, phrases in by_length.items():
        inside = [
            by_length[longer].select(*(F.col(f"w{start + j}").alias(f"w{j + 1}") for j in range(k)), F.col("a").alias("held"))
            for longer in range(k + 1, longest + 1)
            for start in range(1, longer - k + 2)
        ]
        if inside:
            most = reduce(DataFrame.unionAll, inside).groupBy(*_columns(k)).agg(F.max("held").alias("held"))
            phrases = phrases.join(most, _columns(k), "left").withColumn("kept", F.coalesce(100 * F.col("held") < percent * F.col("a"), F.lit(True))).drop("held")
        else:
            phrases = phrases.withColumn("kept", F.lit(True))
        out[k] = phrases
    return out


def _with_counts(by_length: dict[int, DataFrame], frequent: DataFrame) -> DataFrame:
    """All phrases with their words' texts s1, ... and the counts f_i_j of their words i to j that a
    cut needs, absent ones null, and lang."""
    longest = max(by_length)
    out = None
    for k in range(longest, 1, -1):
        level = by_length[k]
        for length in range(2, k):
            for start in {1, k - length + 1}:
                part = by_length[length].select(*(F.col(f"w{j}").alias(f"w{start + j - 1}") for j in range(1, length + 1)), F.col("a").alias(f"f_{start}_{start + length - 1}"))
                level = level.join(part, [f"w{j}" for j in range(start, start + length)])
        level = level.where("kept").drop("kept").withColumn("k", F.lit(k))
        out = level if out is None else out.unionByName(level, allowMissingColumns=True)
        for j in range(k, 0 if k == 2 else k - 1, -1):  # all phrases that have a j-th word, at once
            mine = [F.col("id").alias(f"w{j}"), F.col("word").alias(f"s{j}"), F.col("f").alias(f"f_{j}_{j}")] + [F.col("lang")] * (j == 1)
            out = out.join(frequent.select(*mine), f"w{j}")
    return out


def _scored(phrases: DataFrame, longest: int) -> DataFrame:
    """Adds phrase and l, r and score of the cut with the lowest score, the first of equal ones."""
    exact = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  products reach 10**36
    squared = F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a")
    best = None
    for k in range(2, longest + 1):
        cuts = []
        for cut in range(1, k):
            left, right = f"f_1_{cut}", f"f_{cut + 1}_{k}"
            phrases = phrases.withColumn("_top", squared).withColumn("_low", exact(left) * exact(right)).withColumn(f"_score{k}_{cut}", F.expr("_top div _low"))
            cuts.append(F.struct(F.col(f"_score{k}_{cut}").alias("score"), F.lit(cut).alias("cut"), F.col(left).alias("l"), F.col(right).alias("r")))
        lowest = cuts[0] if k == 2 else F.least(*cuts)
        best = F.when(F.col("k") == k, lowest) if best is None else best.when(F.col("k") == k, lowest)
    phrase = F.concat_ws(" ", *(f"s{j}" for j in range(1, longest + 1)))
    return phrases.withColumn("_best", best).select("lang", phrase.alias("phrase"), "a", "_best.l", "_best.r", "_best.score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang", lang_default: str = "und") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of 2 to `longest` words of each
    language. Words are what spaces and tabs part within pieces, A-Z lower-cased; a phrase lies
    within a piece. a: its occurrences, overlapping ones too, `least` at least; l and r: those of
    the parts before and behind the cut with the lowest score floor(10**6 * a * a / (l * r)), the
    first of equal ones; n: all words of the language. A phrase goes if a longer one with at least
    `percent` percent of its occurrences holds its words side by side. The `top` first by score, a
    and phrase stay.

    A null text counts as empty, a null language as `lang_default`; repeated rows count each;
    other columns are ignored; without rows the result is empty. Texts are read whole; counts
    are 64-bit, and of up to 15 digits where they are multiplied.
    """
    spark = docs.sparkSession
    totals, frequent, found = count_phrases(docs, longest, least, text_col, lang_col, lang_default)
    by_length = dict(enumerate(found, 2))
    rows = _scored(_with_counts(_mark_held(by_length, percent), frequent), longest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: first the best of each of its shares, then of those
    share = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    first = rows.withColumn("_share", share).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_r") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
