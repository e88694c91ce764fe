"""Byte-level BPE over a tokenizer file: whole-token counts, and trie encoding with decoding.

Two operators share the vocabulary, the pre-token split and the merge rule:

* count_tokens: vocabulary strings that are proven to encode alone as one token count 1
  directly; only the other pre-tokens are merged.
* encode_decode: the distinct pre-tokens of a batch go into a trie. Every node is a prefix and
  holds its encoding's last token and the node before that token; a depth-first pass fills them
  in, so that the encoding of a shared prefix is computed once.

Why one last token a prefix is enough: no merge crosses a boundary of the final encoding, so a
prefix that ends at a token boundary is encoded by just those tokens, and a sequence of tokens
is an encoding if and only if each token encodes alone as itself and each adjacent pair encodes
as that pair. The last token t of a prefix is therefore the one suffix in the vocabulary that
forms such a pair with the last token of what remains before it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name


#: The pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Entries that a worker's memo of pre-tokens holds before it starts anew; it bounds memory only.
MEMO = 400_000
#: The same for pairs of tokens.
PAIRS = 600_000
NO_MERGE = sys.maxsize
#: Longer pre-tokens are merged with a heap, and encoded without being kept in a memo.
LONG = 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others take the code points from 256 on in turn."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class ByteBpe:
    """Vocabulary and merge table of a tokenizer file, by token id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        #: (left id, right id) -> rank; made: rank -> merged id
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[left], vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.longest = max(map(len, self.bytes_of.values()))
        self.split = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}  # memo of pair()

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one pre-token: the lowest-ranked adjacent pair is merged again and again."""
        ids = [self.byte_ids[b] for b in word]
        return self._merge_long(ids) if len(ids) > LONG else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(p, NO_MERGE) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != NO_MERGE:
            at = ranks.index(best)
            ids[at] = made[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), NO_MERGE)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: a heap of pairs over a doubly linked list."""
        n, heap = len(ids), []
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def push(at: int) -> None:
            if at >= 0 and after[at] >= 0:
                rank = self.ranks.get((ids[at], ids[after[at]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, at, ids[at], ids[after[at]]))

        for k in range(n - 1):
            push(k)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            if ids[k] != left or after[k] < 0 or ids[after[k]] != right:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = self.made[rank], -1, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            push(before[k])
            push(k)
        return [t for t in ids if t >= 0]

    @cache  # noqa: B019  one object a worker
    def whole(self) -> dict[bytes, int]:
        """Vocabulary strings that encode alone as one token, each proven by merging its bytes."""
        return {b: i for i, b in self.bytes_of.items() if i not in self.special.values() and self.merge(b) == [i]}

    def pair(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together encode as just these two."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        fits = self.pairs[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return fits

    def pieces(self, text: str) -> Iterator[str | int]:
        """Segments of a text between special tokens, and the ids of those."""
        if self.split_special is None or not any(s in text for s in self.special):
            yield text
            return
        for part in self.split_special.split(text):
            if part:
                yield self.special.get(part, part)

    def pretokens(self, text: str) -> list[str]:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in _library_split().pre_tokenize_str(text)]
        return self.split.findall(text)


@cache
def _library_split():
    """Splits texts with code points that Python's tables leave unassigned: newer tables, of which
    the regex module and the tokenizers library each have their own, may call them letters."""
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


class _Counts(dict):
    """Tokens in a pre-token. Starts with the whole tokens; other pre-tokens are merged."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe
        for b in bpe.whole():
            try:
                self[b.decode()] = 1
            except UnicodeDecodeError:  # part of a letter: never a pre-token of its own
                continue

    def __missing__(self, word: str) -> int:
        n = len(self.bpe.merge(word.encode()))
        if len(self) < MEMO and len(word) <= LONG:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(load(path))


def count_text(path: str, text: str) -> int:
    bpe, counts, n = load(path), _counts(path), 0
    for part in bpe.pieces(text):
        n += 1 if isinstance(part, int) else sum(map(counts.__getitem__, bpe.pretokens(part)))
    return n


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id_col, n_bytes long, n_tokens long, over_limit boolean (n_tokens > limit) of every row.

    path: a byte-level BPE tokenizer file that every executor has. A null text counts as empty
    (0 bytes, 0 tokens); null ids stay null; repeated rows are each counted; texts of any length
    are counted whole; an empty table gives an empty result; other columns are ignored, whatever
    their names. No shuffle: a row's result depends on that row alone.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text" if id_col != "text" else "body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.array([count_text(path, t) for t in texts], dtype=np.int64)
            size = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def trie_encode(bpe: ByteBpe, words: list[bytes]) -> list[bytes]:
    """Encodings of sorted distinct words, as little-endian 32-bit ids.

    Sorted words enter the trie depth first: a word keeps the nodes it shares with the word
    before it and adds its own. Flat arrays hold the nodes; path holds those of the current word.
    """
    whole, longest, known, pair = bpe.whole().get, bpe.longest, bpe.pairs, bpe.pair
    last, back = [-1], [-1]  # of each node: last token, node before that token
    path, previous, out = [0], b"", []
    for word in words:
        shared, most = 0, min(len(word), len(previous))
        while shared < most and word[shared] == previous[shared]:
            shared += 1
        del path[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            start = end - longest if end > longest else 0
            while True:
                token = whole(word[start:end])
                if token is not None:
                    if start == 0:
                        break
                    key = last[path[start]], token
                    if known[key] if key in known else pair(*key):
                        break
                start += 1
            path.append(len(last))
            last.append(token)
            back.append(path[start])
        ids, node = [], path[len(word)]
        while node > 0:
            ids.append(last[node])
            node = back[node]
        out.append(b"".join([t.to_bytes(4, "little") for t in reversed(ids)]))
        previous = word
    return out


class Encoder:
    """Encodes texts batch by batch; keeps encodings of pre-tokens for later batches of a task."""

    def __init__(self, path: str):
        self.bpe = load(path)
        self.known: dict[str, bytes] = {}
        self.token = [self.bpe.bytes_of.get(i, b"") for i in range(max(self.bpe.bytes_of) + 1)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        bpe = self.bpe
        if len(self.known) > MEMO:
            self.known.clear()
        #: Texts enter the trie in groups of about this many characters.
        group, size = [], 0
        for text in texts:
            group.append([p if isinstance(p, int) else bpe.pretokens(p) for p in bpe.pieces(text)])
            size += len(text)
            if size > 4_000_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, split: list[list[list[str] | int]]) -> Iterator[bytes]:
        known = self.known
        if len(known) > MEMO:
            known.clear()
        new = {w for parts in split for p in parts if not isinstance(p, int) for w in p} - known.keys()
        words = sorted((w.encode(), w) for w in new)
        known.update(zip((w for _, w in words), trie_encode(self.bpe, [b for b, _ in words]), strict=True))
        for parts in split:
            yield b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(known.__getitem__, p)) for p in parts)

    def rest(self) -> None:
        """Between tasks a worker that waits keeps the vocabulary alone."""
        self.known.clear()
        self.bpe.pairs.clear()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """The columns of docs named in carry and, of every row, n_tokens long, ids_sha256 string,
    decoded_sha256 string and, as named in keep, ids array<int> and decoded string. These replace
    carried columns of the same names.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the
    decoded text in UTF-8. A null text counts as empty (no ids, empty text); nulls in other
    columns stay; repeated rows are each encoded; texts of any length are encoded whole; an empty
    table gives an empty result. No shuffle.
    """
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | {c: t for c, t in (("ids", "array<int>"), ("decoded", "string")) if c in keep}
    carried = docs.select(*[c for c in carry if c not in made])
    source = free_name(carried, "source")
    rows = docs.select(*carried.columns, F.coalesce(F.col(text_col), F.lit("")).alias(source))
    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            found = {c: [] for c in made}
            for ids in coder.encode(batch.column(batch.num_columns - 1).to_pylist()):
                text = coder.decode(ids)
                found["n_tokens"].append(len(ids) // 4)
                found["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                found["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                if "ids" in keep:
                    found["ids"].append(np.frombuffer(ids, dtype="<u4").astype(np.int32))
                if "decoded" in keep:
                    found["decoded"].append(text)
            arrays = [*batch.columns[:-1], *(pa.array(v, types[c]) for c, v in found.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *found])
        coder.rest()

    schema = T.StructType([*carried.schema.fields, *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in made.items())).fields])
    return rows.mapInArrow(run, schema)
