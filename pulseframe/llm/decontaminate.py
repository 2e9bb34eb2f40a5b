"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and marks in lower case, so punctuation and case do not matter;
in scripts written without blanks every character is a word. A seed is a sequence of three words of a test item that is rare by the words' shares
of the corpus: their product is at most ``RARE``, a property of the words alone, so a passage
that very many documents hold keeps its seeds and the rule is the same at every size. An item
with fewer than ``LEAST_SEEDS`` rare sequences takes all of its own, and any other takes all that
have a word outside its rare ones, so that edits of the rare words hide no copy. Seeds meet the documents
where they are read; each place where seeds of an item fall together is aligned with the whole
item, and the score is the share of the best score the item could have. Substituted, inserted
and dropped words lower it, and a passage of half an item or more that is copied well is found.

The test items are read in blocks of a fixed greatest size, each sent to all tasks; more items
take more blocks, never a larger one. No document is shuffled.

An item too short for a seed is its whole sequence, if ``least_words`` admits items of so few words
(:func:`drop_contaminated` takes all, :func:`find_leaks` by default those that have a seed): where that is as rare as a seed, every document
that holds it matches, and where it is not (a single common word, say), the documents that have
no other words.

Null texts have no words, and items without words match nothing. Items without ``item_id`` cannot be
named: :func:`find_leaks` leaves them out, :func:`drop_contaminated` drops their copies like others. Equal items match alike; equal scores of one pair: the first
place. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.tables import documents
from pulseframe.llm.words import U, Words, slices, text_buffer, windows

SEED_WORDS = 3
RARE, LEAST_SEEDS = 1e-9, 4
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: text of the test items that is sent to the tasks at once
BLOCK_BYTES = 16 << 20
_BITS = 22
#: characters of scripts written without blanks, which are words by themselves; and what separates
_UNSPACED = "".join(rf"\p{{{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
_APART = rf"([{_UNSPACED}]\p{{M}}*)|[^\p{{L}}\p{{N}}\p{{M}}\x00-\x7F]"

HITS = "doc_id long, item_id long, score double, start_word int, end_word int"
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32())])


class Lookup:
    """Places of hashes in an ascending list; a bit table turns most of the others away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(keys & U((1 << _BITS) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the list, and where there."""
        maybe = np.flatnonzero(self.bits[(hashes & U((1 << _BITS) - 1)).astype(np.int64)])
        if not len(self.keys) or not len(maybe):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        same = self.keys[at] == hashes[maybe]
        return maybe[same], at[same]


@dataclass
class Items:
    """Test items of a block: ids, word hashes end to end, seeds and where items have them. ``short``
    has for each width below a seed's: hashes of items of so many words in order, the items, and whether they are rare."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    seed_first: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray
    short: dict


def _words(part: pa.RecordBatch | pa.Table) -> Words:
    column = part.column("text")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw, offsets = text_buffer(_spaced(column))
    return Words(raw, offsets, loose=True)


def _spaced(column: pa.Array) -> pa.Array:
    """Blanks around characters that are words and in place of what is none. Arrow's expressions
    read bytes by an automaton; Spark's took four times the processor time of all else."""
    return pc.replace_substring_regex(column, _APART, r" \1 ")


def _lowered(docs: DataFrame, *more: str) -> DataFrame:
    return documents(docs, *more).withColumn("text", F.lower("text"))


def item_blocks(benchmark: DataFrame, most_bytes: int = BLOCK_BYTES) -> int:
    """Blocks into which the items are dealt."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-2 * size // most_bytes)) if size > most_bytes else 1


def _word_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of the words occurs in all documents, and how many words there are."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lookup(shared.value)
        counts, total = np.zeros(len(known.keys), np.int64), 0
        for part in slices(batches):
            words = _words(part)
            total += len(words)
            counts += np.bincount(known.find(words.hash)[1], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], total))], names=["word", "n"])

    sums = _lowered(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(len(vocabulary), np.int64), 0  # as many rows as the block has words
    for word, n in sums:
        if word < 0:
            total = n
        else:
            counts[word] = n
    return counts, total


def prepare(docs: DataFrame, items: pa.Table, least_words: int = SEED_WORDS) -> Items:
    """Seeds of a block of items, rare by the words' shares of the documents; of items too short
    for one, those of ``least_words`` at least are sought whole."""
    words = _words(items)
    begin, hashes = windows(words.hash, words.first, SEED_WORDS)
    vocabulary, word = np.unique(words.hash, return_inverse=True)
    counts, total = _word_counts(docs, vocabulary) if len(words) else (np.zeros(len(vocabulary)), 0)
    share = np.maximum(counts, 1) / max(total, 1)
    rarity_of = lambda begin, width: np.prod([share[word[begin + i]] for i in range(width)], axis=0) if len(begin) else np.zeros(0)
    rarity = rarity_of(begin, SEED_WORDS)
    item = words.text[begin]
    rare = rarity <= RARE
    enough = np.bincount(item, rare, minlength=items.num_rows) >= LEAST_SEEDS
    # where rare sequences leave words of an item uncovered, all sequences with such a word are seeds
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, begin[rare], 1)
    np.add.at(step, begin[rare] + SEED_WORDS, -1)
    bare = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) == 0)])
    chosen = np.flatnonzero(rare | ~enough[item] | (bare[begin + SEED_WORDS] > bare[begin]))
    chosen = chosen[np.argsort(hashes[chosen], kind="stable")]
    seeds, seed_first = np.unique(hashes[chosen], return_index=True)
    short = {}
    for width in range(max(1, least_words), SEED_WORDS):
        at = np.flatnonzero(np.diff(words.first) == width)
        if len(at):
            place, hashed = windows(words.hash, words.first, width)
            keys = hashed[np.searchsorted(place, words.first[at])]
            order = np.argsort(keys, kind="stable")
            short[width] = keys[order], at[order], (rarity_of(words.first[at], width) <= RARE)[order]
    return Items(
        items.column("item_id").to_pylist(), words.hash, words.first, seeds,
        np.append(seed_first, len(chosen)), item[chosen], begin[chosen] - words.first[item[chosen]],
        short,
    )


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over word hashes: the share of the best score, and the aligned words of the
    passage. One row of the table at a time; gaps along the row come from a running maximum."""
    n = len(passage)
    ramp = np.arange(n) * -GAP
    best, best_end, best_start = 0, 0, 0
    row = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)  # where the alignment that ends here begins
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        down = row[1:] + GAP
        cell = np.maximum(np.maximum(diagonal, down), 0)
        came = np.where(cell == diagonal, origin[:-1], np.where(cell == down, origin[1:], np.arange(1, n + 1)))
        came = np.where(cell == 0, np.arange(1, n + 1), came)
        lifted = cell + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n), 0))
        across = top - ramp
        now = np.maximum(across, 0)
        came = np.where(now == cell, came, came[source])
        row = np.concatenate([[0], now])
        origin = np.concatenate([[0], came])
        end = int(now.argmax())
        if now[end] > best:
            best, best_end, best_start = int(now[end]), end + 1, int(came[end])
    return best / (MATCH * len(item)), best_start, best_end


def _places(places: np.ndarray, length: int, words: int) -> list[tuple[int, int]]:
    """Stretches of a document that hold alignments through the seeds, from where items begin."""
    slack = length // 2 + 2
    a = np.maximum(places - slack, 0)
    b = np.minimum(places + length + slack, words)
    order = np.argsort(a, kind="stable")
    out: list[list[int]] = []
    for i, j in zip(a[order], b[order]):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(j))
        else:
            out.append([int(i), int(j)])
    return [tuple(x) for x in out]


def matches(words: Words, items: Items, known: Lookup, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """``text, item, score, start, end`` of every text that holds enough of an item."""
    yield from _aligned(words, items, known, threshold)
    for width, short in items.short.items():
        yield from _whole(words, width, *short)


def _whole(words: Words, width: int, keys: np.ndarray, item: np.ndarray, rare: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """Texts that hold the whole of an item of ``width`` words, at the first place."""
    begin, hashes = windows(words.hash, words.first, width)
    low, high = (np.searchsorted(keys, hashes, side=side) for side in ("left", "right"))
    hit = np.flatnonzero(high > low)
    text = words.text[begin[hit]]
    alone = np.diff(words.first)[text] == width
    seen = set()
    for h, t, only in zip(hit, text, alone):
        for i in range(low[h], high[h]):
            if (rare[i] or only) and (t, i) not in seen:
                seen.add((t, i))
                start = int(begin[h] - words.first[t])
                yield int(t), int(item[i]), 1.0, start, start + width


def _aligned(words: Words, items: Items, known: Lookup, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    begin, hashes = windows(words.hash, words.first, SEED_WORDS)
    hit, seed = known.find(hashes)
    if not len(hit):
        return
    count = items.seed_first[seed + 1] - items.seed_first[seed]
    rows = np.repeat(np.arange(len(hit)), count)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    entry = items.seed_first[seed[rows]] + nth
    text = words.text[begin[hit]][rows]
    place = begin[hit][rows] - words.first[text] - items.seed_at[entry]  # where the item would begin
    item = items.seed_item[entry]
    order = np.lexsort((place, item, text))
    text, item, place = text[order], item[order], place[order]
    new = np.flatnonzero(np.diff(text, prepend=-1).astype(bool) | np.diff(item, prepend=-1).astype(bool))
    for a, b in zip(new, [*new[1:], len(text)]):
        t, i = text[a], item[a]
        want = items.words[items.first[i] : items.first[i + 1]]
        have = words.hash[words.first[t] : words.first[t + 1]]
        best = (0.0, 0, 0)
        for x, y in _places(np.unique(place[a:b]), len(want), len(have)):
            # no more of the item can align than its words that the stretch has at all
            if np.isin(want, have[x:y]).sum() / max(len(want), 1) < threshold:
                continue
            score, start, end = align(want, have[x:y])
            if score > best[0]:
                best = (score, start + x, end + x)
        if best[0] >= threshold:
            yield int(t), int(i), *best


def _blocks(docs: DataFrame, benchmark: DataFrame, least_words: int) -> Iterator[Items]:
    """The items, prepared block by block."""
    n = item_blocks(benchmark)
    rows = benchmark.select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    for i in range(n):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).orderBy("item_id", "text")
        yield prepare(docs, block.toArrow(), least_words)  # one block of the bounded size


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = SEED_WORDS) -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word`` of each document that holds an item."""
    spark, out = docs.sparkSession, None
    for items in _blocks(docs, benchmark.filter(F.col("item_id").isNotNull()), least_words):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            known = Lookup(items.seeds)
            for part in slices(batches):
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[t], items.ids[i], s, a, b) for t, i, s, a, b in matches(_words(part), items, known, threshold)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

        hits = _lowered(docs).mapInArrow(run, HITS)
        out = hits if out is None else out.unionByName(hits)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = 1) -> DataFrame:
    """The documents that hold no item, all columns as they are; nothing is shuffled."""
    columns = docs.columns
    out = docs
    for items in _blocks(docs, benchmark, least_words):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        whole = out.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.lower("text").alias("text"))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            known = Lookup(items.seeds)
            for part in slices(batches):
                keep = np.ones(part.num_rows, bool)
                keep[[t for t, *_ in matches(_words(part), items, known, threshold)]] = False
                yield pa.RecordBatch.from_arrays([part.column("row")], names=["row"]).filter(pa.array(keep))

        kept = whole.mapInArrow(run, whole.select("row").schema)
        out = kept.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))
    return out
