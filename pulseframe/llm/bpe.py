"""Byte-level BPE encoding and raw-byte decoding with the tiktoken library.

The rank file is read on the driver and sent to the tasks (its size is that of a vocabulary).
Each match of the split pattern is encoded on its own, without special tokens. Long texts are cut
before encoding, only where a match must begin: in front of a single blank that stands between
two letters. Every alternative of the pattern ends before such a blank, and the next match starts
with it, so the pieces together give the ids of the whole.

A null text is empty: no ids, no bytes. Texts are never cut short. No rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from pulseframe.llm.tables import documents
from pulseframe.llm.words import slices

PIECE_CHARS = 20_000
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")

ENCODED = "doc_id long, ids array<int>"
CHECKED = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
    ("n_bytes", pa.int64()), ("round_trip", pa.bool_()),
])
_CODECS: dict[tuple, "Codec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Codec:
    """One vocabulary, as a task uses it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values(), default=-1) + 1
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self.width = np.array([len(x) for x in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.width)])
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        if not text:
            return np.zeros(0, np.uint32)
        parts = [self.encoding.encode_to_numpy(x, disallowed_special=()) for x in pieces(text)]
        return np.concatenate(parts).astype("<u4") if len(parts) > 1 else parts[0].astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of the ids, which need not be whole characters."""
        width = self.width[ids]
        at = np.repeat(self.start[ids] - np.cumsum(width) + width, width) + np.arange(width.sum())
        return self.bytes[at].tobytes()


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def codec(shared) -> Codec:
    """The codec of a broadcast vocabulary, made once a worker."""
    ranks, pattern = shared.value
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _share(docs: DataFrame, path: str, pattern: str):
    return docs.sparkSession.sparkContext.broadcast((read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and the ids of the whole text."""
    shared = _share(docs, path, pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared)
        for part in slices(batches):
            ids = [use.encode(t) for t in part.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists], schema=schema)

    return documents(docs).mapInArrow(run, ENCODED)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and the raw bytes of its ``ids``; missing ids are none."""
    shared = _share(tokens, path, pattern)
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared)
        for part in batches:
            out = [use.decode(np.array(x or [], np.int64)) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return the digests of both."""
    shared = _share(docs, path, pattern)
    out = CHECKED.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else CHECKED

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared)
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = use.encode(text)
                data = use.decode(ids)
                rows.append((
                    doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(data).hexdigest(),
                    len(data), data == (text or "").encode(), *([ids.astype(np.int32)] if with_ids else []),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return documents(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean"
        + ", ids array<int>" * with_ids
    )
