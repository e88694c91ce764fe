"""Messages of many bytes as chunk documents whose encoded size stays within a limit.

How many parts a message has stands in every one of its documents, and its digits take room that
the parts' texts then lack: the number is a fix-point, found by packing again until it stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .publish import CHUNK_BYTES, encode_json

BLOCKS = "array<struct<kind:string,language:string,text:string>>"
CHUNKS = "array<struct<path:string,part:int,parts:int,body:string>>"


def chunk_document(context: dict[str, str], message_id: str, part: int, parts: int, blocks: list[dict]) -> dict:
    return {"schema_version": "1.0", "data_type": "message_chunk", **context, "message_id": message_id, "part": part, "parts": parts, "content": {"kind": "blocks", "blocks": blocks}}


def _size(document: dict) -> int:
    return len(encode_json(document).encode())


def json_sizes(text: str) -> np.ndarray:
    """Bytes that each character of a text takes within a JSON string."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.select([code < 0x80, code < 0x800, code < 0x10000], [1, 2, 3], 4)
    size[code < 0x20] = 6
    size[np.isin(code, [8, 9, 10, 12, 13, 34, 92])] = 2
    return size


def pack(context: dict[str, str], message_id: str, blocks: list[dict], parts: int, most: int) -> list[list[dict]]:
    """Blocks by part, if there were so many parts: a block goes as a whole into the current part
    where it fits, else into the next one, and one that fits in none is cut into pieces that fill
    a part each; what is left of it shares its part with what follows."""
    bare = {"kind": "text", "language": None, "text": ""}
    document = lambda part, held: chunk_document(context, message_id, part, parts, held)
    empty = _size(document(1, []))
    # what a second block adds besides its own bytes
    joint = _size(document(1, [bare, bare])) - 2 * _size(document(1, [bare])) + empty
    out: list[list[dict]] = []
    held: list[dict] = []
    used = 0

    def free() -> int:
        digits = len(str(len(out) + 1)) - 1
        return most - empty - digits - used

    def close() -> None:
        nonlocal held, used
        out.append(held)
        held, used = [], 0

    for block in blocks:
        upto = np.concatenate([[0], np.cumsum(json_sizes(block["text"]))])
        frame = _size(document(1, [block | {"text": ""}])) - empty
        at, end = 0, len(block["text"])
        while True:
            need = frame + (joint if held else 0)
            if need + upto[end] - upto[at] <= free():
                used += int(need + upto[end] - upto[at])
                held.append(block | {"text": block["text"][at:]})
                break
            if held:
                close()
                continue
            cut = int(np.searchsorted(upto, upto[at] + free() - frame, side="right")) - 1
            if cut <= at:
                raise ValueError(f"no character of {message_id} fits into {most} bytes")
            held = [block | {"text": block["text"][at:cut]}]
            close()
            at = cut
            if at == end:
                break
    if held:
        close()
    return out


def chunk_documents(context: dict[str, str], message_id: str, blocks: list[dict], most: int = CHUNK_BYTES) -> list[dict]:
    """The chunk documents of a message, each within `most` bytes as encoded."""
    parts = 1
    while True:
        packed = pack(context, message_id, blocks, parts, most)
        if len(packed) <= parts:  # more parts need no less room each, so this grows to its end
            return [chunk_document(context, message_id, k, len(packed), held) for k, held in enumerate(packed, 1)]
        parts = len(packed)


def chunked_messages(messages: DataFrame, message_id: str, blocks: str, context: dict[str, str], name: str, most: int = CHUNK_BYTES) -> DataFrame:
    """message_id, path, part, parts, body, bytes, sha256 of every chunk document of messages, whose
    blocks are of type BLOCKS and whose file names start with the column name. A null or empty list
    of blocks has no chunk, a null text counts as empty. A message is packed in one row."""
    @F.pandas_udf(CHUNKS)
    def cut(ids: pd.Series, lists: pd.Series, names: pd.Series) -> pd.Series:
        def one(ident, listed, stem):
            if listed is None or not len(listed):
                return []
            plain = [{"kind": b["kind"], "language": b["language"], "text": b["text"] or ""} for b in listed]
            made = chunk_documents(context, str(ident), plain, most)
            return [{"path": f"messages/chunks/{stem}-part-{d['part']:06d}.json", "part": d["part"], "parts": d["parts"], "body": encode_json(d)} for d in made]

        return pd.Series([one(*row) for row in zip(ids, lists, names, strict=True)], dtype=object)

    made = messages.select(message_id, F.explode(cut(F.col(message_id), F.col(blocks), F.col(name))).alias("_c")).select(message_id, "_c.*")
    return made.withColumn("bytes", F.octet_length("body")).withColumn("sha256", F.sha2("body", 256))
