"""Importance resampling towards a target by hashed n-gram features, over distinct lines.

Line feeds separate words, so a text is cut into lines and a run of words inside one line has the
same features wherever that line stands. Distinct lines are gathered over the whole corpus with
their numbers of occurrences; words, hashes and buckets are made once for each of them, counts are
multiplied by the occurrences, and the gain of a line is summed once and joined back to the
documents that hold it. Runs that cross lines belong to their document and are added separately.

A text is lower-cased in A-Z only; words are runs of digits, letters and non-ASCII characters.
Null is a text without words. A document without features has weight 0. Every row is a document
of its own, also where rows repeat; the random part of a score depends on the doc_id alone, that of
a missing one on an empty id, which is last in ties. An empty corpus gives no rows, an empty target
counts zero. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.llm.tables import stored
from pulseframe.llm.words import Words, lower, slices, text_buffer

BUCKETS, ORDER, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
_LINES = pa.schema([("line", pa.string()), ("n", pa.int64())])
_FEATURES = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.list_(pa.int32()))])
_USES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("times", pa.int64()), ("crossing", pa.list_(pa.int32()))])
_GAINS = pa.schema([("key", pa.binary()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("gain", pa.int64())])
_CROSSED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_features", pa.int64()), ("gain", pa.int64())])
#: longer byte runs are hashed one by one
_LONG = 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc32(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte ranges ``raw[start:end]``, all ranges one byte further in each step."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    by_size = np.argsort(size, kind="stable")
    begin, longest = start[by_size], int(size.max()) if len(size) else 0
    first = np.searchsorted(size[by_size], np.arange(min(longest, _LONG)), side="right")
    state = out[by_size]
    for k, a in enumerate(first):  # the ranges from ``a`` on have a byte ``k``
        state[a:] = _CRC[(state[a:] ^ raw[begin[a:] + k]) & 0xFF] ^ (state[a:] >> np.uint32(8))
    out[by_size] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(raw[start[i] : end[i]].tobytes())
    return out


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a slice with one blank after each, and where they begin and end there."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    move = np.repeat(words.start - start, size)
    at = np.ones(len(out), bool)
    at[end] = False
    place = np.flatnonzero(at)
    out[place] = words.raw[place + move]
    return out, start, end


def _runs(words: Words, order: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """First word and bucket of each run of up to ``order`` words inside one text of the slice."""
    if not len(words):
        return [(np.zeros(0, np.int64), np.zeros(0, np.uint32))] * order
    raw, start, end = _joined(words)
    last = np.repeat(words.first[1:], np.diff(words.first))
    out = []
    for n in range(1, order + 1):
        at = np.arange(len(words))
        at = at[at + n <= last]
        out.append((at, crc32(raw, start[at], end[at + n - 1]) % np.uint32(buckets)))
    return out


def _line_offsets(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.union1d(offsets, np.flatnonzero(raw == 10) + 1)


def _cut(part: pa.RecordBatch) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased lines that hold a word, the text each comes from; all bytes and text offsets."""
    raw, offsets = text_buffer(part.column("text"))
    raw = lower(raw)
    at = _line_offsets(raw, offsets)
    first = Words(raw, at, loose=True, hashed=False).first
    # line feeds stay at the ends of lines, so that the buffer can be used as it is
    lines = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
    full = np.flatnonzero(np.diff(first))
    return lines.take(pa.array(full)), np.searchsorted(offsets, at[full], side="right") - 1, raw, offsets


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct lines of a slice and how often each occurs there."""
    for part in slices(batches):
        lines, _, _, _ = _cut(part)
        if len(lines):
            found = lines.dictionary_encode()
            n = np.bincount(np.asarray(found.indices), minlength=len(found.dictionary))
            line = pc.utf8_rtrim(found.dictionary, "\n")
            yield pa.RecordBatch.from_arrays([line, pa.array(n, pa.int64())], schema=_LINES)


def _keys(lines: pa.StringArray) -> list[bytes]:
    return [hashlib.blake2b(x.as_buffer(), digest_size=16).digest() for x in lines.cast(pa.binary())]


def _lists(of: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    """The values of each of the rows ``of``, as lists."""
    at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values[np.argsort(of, kind="stable")], pa.int32()))


def _uses(order: int, buckets: int):
    """For each document row the keys of its lines, and one row with the runs that cross lines."""

    def crossing(part: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
        words = Words(raw, offsets, loose=True, hashed=False)
        line = np.searchsorted(_line_offsets(raw, offsets), words.start, side="right")
        of, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for n, (at, bucket) in enumerate(_runs(words, order, buckets), 1):
            crosses = line[at] != line[at + n - 1]
            of.append(words.text[at[crosses]])
            found.append(bucket[crosses])
        return _lists(np.concatenate(of), np.concatenate(found), part.num_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines, text, raw, offsets = _cut(part)
            row, doc = part.column("row").to_pylist(), part.column("doc_id").cast(pa.int64()).to_pylist()
            found = lines.dictionary_encode()
            keys = _keys(pc.utf8_rtrim(found.dictionary, "\n"))
            pair, times = np.unique(text * max(1, len(keys)) + np.asarray(found.indices), return_counts=True) if len(lines) else (np.zeros(0, np.int64),) * 2
            of, which = pair // max(1, len(keys)), pair % max(1, len(keys))
            crossed = crossing(part, raw, offsets) if order > 1 else pa.nulls(len(row), pa.list_(pa.int32()))
            rows = [*(row[i] for i in of), *row], [*(doc[i] for i in of), *doc], [*(keys[i] for i in which), *[None] * len(row)]
            crossed = pa.concat_arrays([pa.nulls(len(of), pa.list_(pa.int32())), crossed])
            flat = [pa.array(c, f.type) for c, f in zip((*rows, [*times, *[0] * len(row)]), _USES)]
            yield pa.RecordBatch.from_arrays([*flat, crossed], schema=_USES)

    return run


def _featured(order: int, buckets: int):
    """Buckets of all runs inside each distinct line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(b.rename_columns(["text", "n"]) for b in batches):
            raw, at = text_buffer(part.column("text"))
            words = Words(raw, at, loose=True, hashed=False)
            line_of, bucket = (np.concatenate(x) for x in zip(*((words.text[a], b) for a, b in _runs(words, order, buckets))))
            yield pa.RecordBatch.from_arrays([
                pa.array(_keys(part.column("text"))), part.column("n"), pa.array(np.diff(words.first), pa.int64()),
                _lists(line_of, bucket, part.num_rows),
            ], schema=_FEATURES)

    return run


def _summed(column: str, weight: str | None, buckets: int):
    """Occurrences of every bucket among the rows of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            lists = batch.column(column)
            size = np.asarray(pc.list_value_length(lists).fill_null(0))
            times = np.asarray(batch.column(weight)) if weight else np.ones(len(lists), np.int64)
            value, n = np.asarray(lists.flatten()), np.repeat(times, size)
            np.add.at(total, value, n)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["bucket", "n"])

    return run


class Corpus:
    """A table of texts as distinct lines with features, and what its documents use of them."""

    def __init__(self, docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, name: str = "corpus"):
        self.order, self.buckets = order, buckets
        rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
        lines = rows.select("text").mapInArrow(_lines, "line string, n long").groupBy("line").agg(F.sum("n").alias("n"))
        self.lines = stored(lines.mapInArrow(_featured(order, buckets), "key binary, n long, n_words long, buckets array<int>"), f"{name}-lines")
        self.uses = stored(rows.mapInArrow(_uses(order, buckets), "row long, doc_id long, key binary, times long, crossing array<int>"), f"{name}-uses")

    @property
    def whole(self) -> DataFrame:
        """One row a document row, with the runs that cross its lines."""
        return self.uses.filter("key IS NULL").select("row", "doc_id", "crossing")

    def counts(self) -> np.ndarray:
        """Occurrences of every bucket; a vector of fixed length."""
        found = self.lines.select("n", "buckets").mapInArrow(_summed("buckets", "n", self.buckets), "bucket int, n long")
        if self.order > 1:
            found = found.union(self.whole.select("crossing").mapInArrow(_summed("crossing", None, self.buckets), "bucket int, n long"))
        out = np.zeros(self.buckets, np.int64)
        for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
            out[bucket] = n
        return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of a bucket's smoothed shares, rounded down."""
    k, big_s, big_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (big_s + k) / ((s + 1) * (big_t + k)))) for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def _gained(gain: np.ndarray, column: str, keep: tuple[str, ...], schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            size = np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(gain[np.asarray(lists.flatten())])])
            end = np.cumsum(size)
            sums = [pa.array(size), pa.array(total[end] - total[end - size])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *sums], schema=schema)

    return run


def weigh(corpus: Corpus, gain: np.ndarray) -> DataFrame:
    """``row, doc_id, n_words, n_features, weight`` of every document row."""
    lines = corpus.lines.mapInArrow(_gained(gain, "buckets", ("key", "n_words"), _GAINS), "key binary, n_words long, n_features long, gain long")
    used = corpus.uses.filter("key IS NOT NULL").select("row", "doc_id", "key", "times").join(lines, "key")
    inner = used.select("row", "doc_id", *((F.col(c) * F.col("times")).alias(c) for c in ("n_words", "n_features", "gain")))
    if corpus.order > 1:
        cross = corpus.whole.mapInArrow(_gained(gain, "crossing", ("row", "doc_id"), _CROSSED), "row long, doc_id long, n_features long, gain long")
    else:
        cross = corpus.whole.select("row", "doc_id", *(F.lit(0).cast("long").alias(c) for c in ("n_features", "gain")))
    both = inner.unionByName(cross.withColumn("n_words", F.lit(0).cast("long")))
    sums = both.groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    mean = F.expr("(gain - pmod(gain, nullif(n_features, 0))) div nullif(n_features, 0)")
    return sums.select("row", "doc_id", "n_words", "n_features", F.coalesce(mean, F.lit(0)).cast("long").alias("weight"))


def noise(doc_id: Column | str = "doc_id", seed: str = SEED) -> Column:
    """A thousand times a Gumbel number that the doc_id decides, rounded down."""
    number = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(number.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """``rank`` of the highest scores among the eligible, ties to the smaller doc_id; null for the rest.

    Scores are whole numbers of a bounded range (logarithms of 64-bit counts times a thousand), so
    a histogram of them finds the score below which nothing is drawn. What is left is sorted over
    all tasks; places in its sorted files and the sizes of those files give the ranks.
    """
    scored = scored.withColumn("_in", eligible)
    histogram = scored.filter("_in").groupBy("score").count().collect()
    wanted, least = sum(n for _, n in histogram) * percent // 100, None
    seen = 0
    for score, n in sorted(histogram, reverse=True):
        if seen >= wanted:
            break
        seen, least = seen + n, score
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.drop("_in").select("*", none)
    near = F.col("_in") & (F.col("score") >= least)
    ordered = scored.filter(near).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")).withColumn("_at", F.monotonically_increasing_id())
    ordered = stored(ordered, "drawn")
    file, before, offsets = F.shiftright("_at", 33), 0, []
    for number, n in sorted(ordered.groupBy(file.alias("f")).count().collect()):  # one row a file
        offsets.append((number, before))
        before += n
    starts = scored.sparkSession.createDataFrame(offsets, "_file long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ordered.withColumn("_file", file).join(starts, "_file").withColumn("rank", F.when(place <= wanted, place))
    names = [c for c in scored.columns if c != "_in"]
    return scored.filter(~near).select(*names, none).unionByName(ranked.select(*names, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
    percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document row: ``percent`` of
    those with ``min_words`` words are drawn without replacement, by weights towards ``target``."""
    corpus = Corpus(docs.select("doc_id", "text"), order, buckets)
    aim = Corpus(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), order, buckets, "target")
    weighed = weigh(corpus, gains(corpus.counts(), aim.counts()))
    scored = stored(weighed.drop("row").withColumn("score", F.col("weight") + noise("doc_id", seed)), "scored")
    return draw(scored, F.col("n_words") >= min_words, percent)
