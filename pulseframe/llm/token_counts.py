"""Token counts of sections, from one encoding of the whole document.

A document is encoded once. The lengths of its tokens give the character span of each, and the
spans are joined with the spans of the sections. A token that reaches over a boundary goes to one
section by a rule: ``largest``, the one that has most of its characters (the first of equals), or
``start``, the one that has its first character. A token that splits a character covers it.
Characters outside every section, and tokens with no character inside one, count for none.

Sections are a column of names and spans in code points, or by default the lines of the text,
each with its line break. Sections of a document must not overlap.

Null texts are empty. A document without sections, or an empty one, has one row with section 0
and no tokens. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.bpe import Codec, codec, read_ranks
from pulseframe.llm.tables import documents
from pulseframe.llm.words import slices

RULES = ("largest", "start")
COUNTED = "doc_id long, section int, name string, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
_OUT = pa.schema([
    ("doc_id", pa.int64()), ("section", pa.int32()), ("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
    ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64()),
])
SECTIONS = "array<struct<name:string,start:long,end:long>>"


def fields_as_sections(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``doc_id, text, sections``: the fields end to end, each a section of its own."""
    value = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    size = [F.length(v).cast("long") for v in value]
    begin = [sum(size[:i], F.lit(0).cast("long")) for i in range(len(fields) + 1)]
    parts = [F.struct(F.lit(f).alias("name"), begin[i].alias("start"), begin[i + 1].alias("end")) for i, f in enumerate(fields)]
    return rows.select(F.col(key).alias("doc_id"), F.concat(*value).alias("text"), F.array(*parts).alias("sections"))


def lines_of(raw: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines, with their line breaks; ``chars`` counts code points so far."""
    breaks = np.flatnonzero(raw == 10)
    ends = chars[breaks]
    total = chars[-1] if len(chars) else 0
    if not len(ends) or ends[-1] < total:
        ends = np.append(ends, total)
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)


def allocate(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them reach over a boundary. Tokens are character
    spans ``first`` to ``last`` (exclusive); sections are ascending."""
    n = len(start)
    counts, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not len(first):
        return counts, crossing
    a = np.searchsorted(start, first, side="right") - 1
    b = np.searchsorted(start, last - 1, side="right") - 1
    inside = (a == b) & (a >= 0)
    plain = inside & (last <= end[np.maximum(a, 0)])
    counts += np.bincount(a[plain], minlength=n)
    for i in np.flatnonzero(~plain & (b >= 0)):  # over a boundary
        near = np.arange(max(a[i], 0), b[i] + 1)
        shared = np.minimum(last[i], end[near]) - np.maximum(first[i], start[near])
        if shared.max() <= 0:
            continue
        if rule == "largest":
            to = near[shared.argmax()]
        elif a[i] >= 0 and first[i] < end[a[i]]:
            to = a[i]
        else:
            continue  # its first character is in no section
        counts[to] += 1
        crossing[to] += 1
    return counts, crossing


def _sections(row: list[dict] | None) -> tuple[list, np.ndarray, np.ndarray]:
    row = sorted((x for x in row or [] if x is not None), key=lambda x: (x["start"], x["end"]))
    start, end = np.array([x["start"] for x in row], np.int64), np.array([x["end"] for x in row], np.int64)
    full = end > start
    if (end[:-1] > start[1:])[full[:-1] & full[1:]].any():
        raise ValueError("sections of a document overlap")
    return [x["name"] for x in row], start, end


def _count(use: Codec, doc_id: int | None, text: str | None, sections, given: bool, rule: str) -> Iterator[tuple]:
    ids = use.encode(text)
    raw = np.frombuffer((text or "").encode(), np.uint8)
    chars = np.cumsum((raw & 0xC0) != 0x80)
    stop = np.cumsum(use.width[ids])
    first = chars[stop - use.width[ids]] - 1 if len(ids) else np.zeros(0, np.int64)
    last = chars[stop - 1] if len(ids) else np.zeros(0, np.int64)
    names, start, end = _sections(sections) if given else ([], *lines_of(raw, chars))
    if not len(start):
        yield doc_id, 0, None, 0, 0, 0, 0, len(ids)
        return
    # an empty section holds nothing and must not hide the one that starts with it
    full = np.flatnonzero(end > start)
    counts, crossing = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    counts[full], crossing[full] = allocate(first, last, start[full], end[full], rule)
    for i in range(len(start)):
        yield doc_id, i, names[i] if given else None, int(start[i]), int(end[i]), int(counts[i]), int(crossing[i]), len(ids)


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "largest") -> DataFrame:
    """One row a section: ``doc_id, section, name, start, end, n_tokens, n_crossing, doc_tokens``.

    ``docs`` may have a column ``sections``; lines are counted otherwise.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    given = "sections" in docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(path), pattern))
    rows = documents(docs, *(["sections"] if given else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(shared)
        for part in slices(batches):
            sections = part.column("sections").to_pylist() if given else [None] * part.num_rows
            out = [r for d, t, s in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), sections)
                   for r in _count(use, d, t, s, given, rule)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return rows.mapInArrow(run, COUNTED)
