"""Documents dealt into blocks, packed for the way.

A block is read twice by the operators that use it, so its texts are shuffled once and the
exchange is used again. Each task packs the documents it has for a block into one row: ids, sizes
and the texts end to end, compressed. Equal blocks of several tasks meet at the reader.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from pulseframe.llm.tables import documents
from pulseframe.llm.words import U, narrow, slices, text_buffer, widen

#: text bytes that a task gathers before it packs them
HELD_BYTES = 16 << 20
_PACKED = pa.schema([
    ("block", pa.int32()), ("ids", pa.binary()), ("named", pa.binary()), ("sizes", pa.binary()), ("size", pa.int64()), ("data", pa.binary()),
])
_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def deal(docs: DataFrame, block: Column, blocks: int) -> DataFrame:
    """Packed documents, dealt by ``block`` (whole numbers below ``blocks``)."""
    rows = documents(docs).withColumn("block", block)
    packed = rows.mapInArrow(_pack, "block int, ids binary, named binary, sizes binary, size long, data binary")
    return packed.repartition(blocks, "block")


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches):
        held.append(part)
        size += part.nbytes
        if size > HELD_BYTES:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _rows(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    zstd = pa.Codec("zstd", compression_level=3)
    block = np.asarray(table.column("block"))
    table = table.take(pa.array(np.argsort(block, kind="stable"))).combine_chunks()
    block = np.sort(block, kind="stable")
    ids, text = table.column("doc_id").chunk(0).cast(pa.int64()), table.column("text").chunk(0)
    raw, at = text_buffer(text)
    value, named = np.array(ids.fill_null(0), np.int64).view(U), np.asarray(ids.is_valid())
    out = []
    first = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(first, [*first[1:], len(block)]):
        data = raw[at[a] : at[b]].tobytes()
        out.append((int(block[a]), narrow(value[a:b]), np.packbits(named[a:b]).tobytes(), narrow(np.diff(at[a : b + 1])), len(data), zstd.compress(data, asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PACKED)], schema=_PACKED)


def opened(rows: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` of packed rows, one batch a row."""
    zstd = pa.Codec("zstd")
    for ids, named, sizes, size, data in zip(*(rows.column(c).to_pylist() for c in ("ids", "named", "sizes", "size", "data"))):
        length = widen(sizes).astype(np.int64)
        value = widen(ids).view(np.int64)
        mask = ~np.unpackbits(np.frombuffer(named, np.uint8), count=len(value)).astype(bool)
        at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        data = zstd.decompress(data, size) if size else pa.py_buffer(b"")
        text = pa.StringArray.from_buffers(len(length), pa.py_buffer(at), data)
        yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64(), mask=mask), text], schema=_DOCS)


def whole(rows: pa.Table) -> pa.RecordBatch:
    """All documents of a block's rows."""
    table = pa.Table.from_batches(list(opened(rows)), schema=_DOCS).combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=_DOCS)
