"""Removal of word sequences that an earlier document has.

Every window of 13 consecutive words gets a Rabin-Karp hash. Documents are dealt into blocks by
ranges of doc_id, so "a smaller doc_id" means an earlier block or, within one block, a smaller id
that the block itself can see. Every block sends each hash once, whatever its number of copies;
hashes are brought together by ranges of their value, and a block hears back which of its hashes
an earlier block has. Windows found that way merge into maximal removal intervals.

So a passage that a third of all documents share costs one entry a block, no task gathers
documents, and the texts are dealt once (the exchange is used twice).

Hashes have 64 bits and 16 more are compared. Words are runs of anything but the six white-space
bytes, unchanged. Null texts have no words. Documents without doc_id are kept whole and are no
one's source; equal doc_ids are not smaller than each other. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.blocks import deal, opened, whole
from pulseframe.llm.tables import groups_for
from pulseframe.llm.words import U, Words, mix, narrow, pack, range_hash, slices, text_buffer, unpack, widen

WIDTH = 13
#: windows of one block held before they are sent on, which bounds a task's memory
HELD = 2_000_000
_CHECK = 0x9E3779B97F4A7C15 | 1

KEPT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def _keys(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows begin, their hashes, and 16 bits to compare."""
    at = np.arange(len(words))
    begin = at[at + width <= np.repeat(words.first[1:], np.diff(words.first))]
    end = begin + width
    again = mix(range_hash(words.hash, begin, end, _CHECK)) >> U(48)
    return begin, mix(range_hash(words.hash, begin, end, 0x2545F4914F6CDD1D)), again.astype(np.uint16)


def _grouped(hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that brings equal windows together, and the place in it where the group of
    each begins."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], check[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if (~new[1:] & (c[1:] != c[:-1])).any():  # different windows of one hash: compare both parts
        order = np.lexsort((check, hashes))
        h, c = hashes[order], check[order]
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return order, np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))


def _blocks(docs: DataFrame, groups: int) -> DataFrame:
    """Documents with a ``block`` that grows with doc_id, dealt by it; those without one are dealt
    over all blocks by their text."""
    bounds = []
    if groups > 1:
        found = docs.agg(F.percentile_approx("doc_id", [i / groups for i in range(1, groups)], 20 * groups)).first()[0]
        bounds = sorted(set(found or []))
    shared = docs.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))  # one number a block

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(), side="right").astype(np.int32))

    # rows without doc_id are no one's source, so any block will do
    unnamed = F.pmod(F.xxhash64("text"), F.lit(groups)).cast("int")
    return deal(docs, F.when(F.col("doc_id").isNull(), unnamed).otherwise(block_of(F.coalesce("doc_id", F.lit(0)))), groups)


def _sender(width: int, buckets: int) -> Callable:
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("hashes", pa.binary()), ("checks", pa.binary())])

    def send(block: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order, group = _grouped(h, c)
        once = order[group == np.arange(len(order))]
        h, c = h[once], c[once]
        cuts = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
        rows = [(i, block, pack(h[a:b]), narrow(c[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count: dict[int, int] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), opened(batch)):
                for some in slices([part.filter(pc.is_valid(part.column("doc_id")))]):
                    _, h, c = _keys(Words(*text_buffer(some.column("text"))), width)
                    if len(h):
                        held.setdefault(block, []).append((h, c))
                        count[block] = count.get(block, 0) + len(h)
            if sum(count.values()) > HELD:
                full = max(count, key=count.get)
                count.pop(full)
                yield send(full, held.pop(full))
        for block, parts in held.items():
            yield send(block, parts)

    return run


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The range of hash values that a hash falls into."""
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _answer(table: pa.Table) -> pa.Table:
    """Hashes of one range: to each block, those that an earlier block has."""
    block = np.asarray(table.column("block"))
    by_block = np.argsort(block, kind="stable")
    hashes = [unpack(x) for x in table.column("hashes").to_pylist()]
    checks = [widen(x).astype(np.uint16) for x in table.column("checks").to_pylist()]
    owner = np.repeat(block[by_block], [len(hashes[i]) for i in by_block])
    h = np.concatenate([hashes[i] for i in by_block])
    c = np.concatenate([checks[i] for i in by_block])
    order, group = _grouped(h, c)
    later = order[owner[order] > owner[order[group]]]
    later = later[np.argsort(owner[later], kind="stable")]  # by block, and by hash within it
    blocks, first = np.unique(owner[later], return_index=True)
    ends = [*first[1:], len(later)]
    return pa.table({
        "block": pa.array(blocks, pa.int32()),
        "hashes": pa.array([pack(h[later[a:b]]) for a, b in zip(first, ends)], pa.binary()),
        "checks": pa.array([narrow(c[later[a:b]]) for a, b in zip(first, ends)], pa.binary()),
    })


def _remover(width: int) -> Callable:
    def run(docs: pa.Table, heard: pa.Table) -> pa.Table:
        docs = pa.Table.from_batches([whole(docs)]).sort_by("doc_id").combine_chunks()
        known_h = np.concatenate([unpack(x) for x in heard.column("hashes").to_pylist()] or [np.zeros(0, U)])
        known_c = np.concatenate([widen(x) for x in heard.column("checks").to_pylist()] or [np.zeros(0, U)]).astype(np.uint16)
        order = np.lexsort((known_c, known_h))
        known_h, known_c = known_h[order], known_c[order]
        return _removed(docs, width, known_h, known_c)

    return run


def _removed(docs: pa.Table, width: int, known_h: np.ndarray, known_c: np.ndarray) -> pa.Table:
    """One block: its documents by doc_id, and the windows that earlier blocks have."""
    batch = docs.to_batches()[0] if docs.num_rows else pa.RecordBatch.from_pylist([], docs.schema)
    named = batch.column("doc_id").is_valid()
    ids = np.array(batch.column("doc_id").fill_null(0), np.int64)
    raw, offsets = text_buffer(batch.column("text"))
    words = Words(raw, offsets)
    begin, h, c = _keys(words, width)
    text = words.text
    own = text[begin]  # rows are ordered by doc_id, missing ones last
    rank = np.cumsum(np.diff(ids, prepend=ids[:1]) != 0)[own] if len(ids) else own
    valid = np.asarray(named, bool)[own] if len(ids) else np.zeros(0, bool)
    begin, h, c, rank = begin[valid], h[valid], c[valid], rank[valid]
    order, group = _grouped(h, c)
    gone = np.zeros(len(begin), bool)
    gone[order] = rank[order] > rank[order[group]]
    if len(known_h):
        at = np.searchsorted(known_h, h)
        inside = np.minimum(at, len(known_h) - 1)
        same = known_h[inside] == h
        hit = same & (known_c[inside] == c)
        for i in np.flatnonzero(same & ~hit):  # other windows of that hash may follow
            j = at[i]
            while j < len(known_h) and known_h[j] == h[i]:
                hit[i] |= known_c[j] == c[i]
                j += 1
        gone |= hit
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, begin[gone], 1)
    np.add.at(cover, begin[gone] + width, -1)
    out = np.cumsum(cover[:-1]) > 0
    n = np.diff(words.first)
    n_removed = np.bincount(text, out, minlength=len(ids)).astype(np.int64)
    kept, kept_at = _joined(words, ~out)
    return pa.table([
        batch.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(n_removed),
        pa.StringArray.from_buffers(len(ids), pa.py_buffer(kept_at.astype(np.int32)), pa.py_buffer(kept)), _intervals(words, out),
    ], names=["doc_id", "n_words", "n_removed", "kept_text", "removed"])


def _joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one blank: bytes and offsets."""
    raw, text = words.raw, words.text
    kept = np.flatnonzero(keep)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[words.start[kept]] += 1
    edge[words.end[kept]] -= 1
    chosen = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    follows = kept[:-1][text[kept[1:]] == text[kept[:-1]]] if len(kept) else kept
    # between two words of a text there is at least one byte of white space: it becomes the blank
    blank = words.end[follows]
    chosen[blank] = True
    data = raw.copy()
    data[blank] = 32
    size = np.concatenate([[0], np.cumsum(chosen)])
    return data[chosen], size[words.offsets]


def _intervals(words: Words, out: np.ndarray) -> pa.Array:
    """Maximal runs of removed words of each text, counted from its first word."""
    text = words.text
    starts = out.copy()
    ends = out.copy()
    same = text[1:] == text[:-1]
    starts[1:] &= ~(out[:-1] & same)
    ends[:-1] &= ~(out[1:] & same)
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    base = words.first[text[a]]
    pairs = pa.StructArray.from_arrays([pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[a], np.arange(len(words.offsets))), pa.int32()), pairs)


def drop_repeats(docs: DataFrame, width: int = WIDTH, groups: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, removed`` of every document."""
    buckets = groups or groups_for(docs)
    base = _blocks(docs, buckets)
    sent = base.mapInArrow(_sender(width, buckets), "bucket int, block int, hashes binary, checks binary")
    heard = sent.groupBy("bucket").applyInArrow(_answer, "block int, hashes binary, checks binary")
    return base.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(_remover(width), KEPT)
