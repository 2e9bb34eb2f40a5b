"""Language identification by prediction by partial matching.

For every language a context tree over bytes is counted on a bounded sample and then frozen. A
node predicts a byte that it has seen with ``count / (total + distinct)`` and escapes with
``distinct / (total + distinct)`` to the node of the next shorter context, in which the bytes it
has seen itself are excluded; below the empty context all 256 bytes and the text's end are alike.
So the probabilities of every node sum to one and the code length of a text is exact. The
language with the shortest code for the whole text wins.

The trees are laid out for look-ups: a walk from the latest byte backwards finds the longest
context that any language has, and the row of that context holds the cost of the next byte in all
languages, escapes worked out.

Null texts and texts without a letter get ``und`` with score 0. Without any training row every
text gets ``und``. Equal code lengths: the smaller name. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulseframe.llm.tables import documents
from pulseframe.llm.words import slices, text_buffer

ORDER = 3
#: the sample: documents of each language, and bytes of an excerpt of each (from any place in it)
SAMPLE_DOCS, SAMPLE_BYTES = 300, 3000
#: languages of one model; more are dealt over several, which are sent apart
BLOCK = 32
UNDECIDED = "und"
_RAW_BITS = 8.0


@dataclass
class Model:
    """``letter[byte]`` numbers the bytes seen, the last number is for all others;
    ``steps[d][state * letters + letter]`` walks back; ``cost[state * letters + letter]`` has bits
    by language."""

    languages: list[str]
    letter: np.ndarray
    letters: int
    steps: list[np.ndarray]
    cost: np.ndarray
    rest: tuple[Model, ...] = ()  # of the languages that follow, if there are many


def sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """``lang, text``: the same bounded number of excerpts of each language, picked by a hash.

    The window keeps the first rows of a language in every task before anything is shuffled.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    pick = F.xxhash64("doc_id", F.lit("sample"))
    top = rows.select("lang", "doc_id", pick.alias("pick"))
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("pick", "doc_id"))).filter(F.col("n") <= docs_each)
    spare = F.greatest(F.length("text") - most_bytes, F.lit(0))
    start = F.pmod(F.xxhash64("doc_id", F.lit("place")), spare + 1).cast("int") + 1
    picked = rows.join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi")  # at most docs_each a language
    texts = picked.select("lang", "doc_id", F.substring(F.col("text"), start, F.lit(most_bytes)).alias("text"))
    texts = texts.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "text"))).filter(F.col("n") <= docs_each)
    return texts.orderBy("lang", "doc_id", "text").select("lang", "text").toPandas()


def train(examples: pd.DataFrame, order: int = ORDER, block: int = BLOCK) -> Model:
    """The model of all languages. A code length does not depend on the other languages of a model,
    so they are dealt over models of ``block`` languages, whose size then grows with their number only."""
    languages = sorted(examples["lang"].unique())
    parts = [languages[i : i + block] for i in range(0, len(languages), block)] or [[]]
    first, *rest = (_train(examples[examples["lang"].isin(part)], order) for part in parts)
    return replace(first, rest=tuple(rest))


def _train(examples: pd.DataFrame, order: int) -> Model:
    """Count the context trees of some languages and work the costs out."""
    languages = sorted(examples["lang"].unique())
    texts = [t.encode() for t in examples["text"]]
    seen = np.unique(np.frombuffer(b"".join(texts), np.uint8)) if texts else np.zeros(0, np.uint8)
    letter = np.full(256, len(seen), np.int64)
    letter[seen] = np.arange(len(seen))
    # one number more for the place before a text, and one for all bytes never seen
    letters, pad = len(seen) + 2, len(seen) + 1
    number = {lang: i for i, lang in enumerate(languages)}
    streams = [[] for _ in languages]
    for lang, text in zip(examples["lang"], texts):
        streams[number[lang]] += [np.full(order, pad), letter[np.frombuffer(text, np.uint8)]]
    grams = []  # of each language and order: (context, letter, count), context = latest byte first
    for stream in streams:
        s = np.concatenate(stream).astype(np.int64) if stream else np.zeros(0, np.int64)
        at = np.flatnonzero(s != pad)
        per = []
        for d in range(order + 1):
            key = np.zeros(len(at), np.int64)
            for back in range(1, d + 1):
                key = key * letters + s[at - back]
            both, count = np.unique(key * letters + s[at], return_counts=True)
            per.append((both // letters, both % letters, count))
        grams.append(per)
    # contexts that any language has, by depth
    contexts = [np.unique(np.concatenate([g[d][0] for g in grams] or [np.zeros(1, np.int64)])) for d in range(order + 1)]
    size = [len(c) for c in contexts]
    steps, total = [], 0
    # states at depth d: those of shorter contexts that ended there, then the contexts of depth d
    offset = [0]
    for d in range(order):
        ended = offset[d]
        table = np.empty((ended + size[d], letters), np.int64)
        table[:ended] = np.arange(ended)[:, None]
        here = contexts[d][:, None] * letters + np.arange(letters)
        place = np.searchsorted(contexts[d + 1], here)
        found = contexts[d + 1][np.minimum(place, size[d + 1] - 1)] == here
        table[ended:] = np.where(found, ended + size[d] + place, ended + np.arange(size[d])[:, None])
        steps.append(table.astype(np.int32).ravel())
        offset.append(ended + size[d])
    states = offset[order] + size[order]
    cost = np.empty((states, letters, len(languages)), np.float32)
    for i, per in enumerate(grams):
        # the empty context escapes to 256 bytes alike; the class of unseen bytes costs one of them
        prob = np.full((1, letters), 1 / 256)
        levels = []
        for d in range(order + 1):
            ctx, sym, count = per[d]
            shorter = np.zeros(size[d], np.int64)
            if d:
                parent = contexts[d] // letters
                shorter = np.searchsorted(contexts[d - 1], parent)
            base = prob[shorter]
            at = np.searchsorted(contexts[d], ctx)
            n = np.zeros((size[d], letters))
            n[at, sym] = count
            total, distinct = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            weight = np.ones((1, letters))
            if not d:
                weight[0, -2] = 256 - len(seen)  # so many bytes share that class
                weight[0, -1] = 0
            taken = np.where(n > 0, base * (weight if not d else _members(letters, len(seen))), 0).sum(1, keepdims=True)
            left = np.maximum(1 - taken, 1e-12)
            escaped = np.where(total > 0, distinct / np.maximum(total + distinct, 1) / left, 1.0)
            prob = np.where(n > 0, n / np.maximum(total + distinct, 1), escaped * base)
            levels.append(prob)
        for d, p in enumerate(levels):
            cost[offset[d] : offset[d] + size[d], :, i] = -np.log2(np.maximum(p, 1e-300))
    return Model(languages, letter.astype(np.uint8), letters, steps, cost.reshape(states * letters, len(languages)))


def _members(letters: int, seen: int) -> np.ndarray:
    """Bytes that each letter stands for."""
    out = np.ones((1, letters))
    out[0, -2], out[0, -1] = 256 - seen, 0
    return out


def code_lengths(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each whole text in each language of one model."""
    order, n = len(model.steps), len(offsets) - 1
    length = np.diff(offsets)
    out = np.zeros((n, len(model.languages)))
    if not len(raw):
        return out
    padded = np.full(len(raw) + order * n, model.letters - 1, np.int32)
    at = np.arange(len(raw)) + np.repeat(order * (np.arange(n) + 1), length)
    padded[at] = model.letter[raw]
    step = 1 << 19  # a few MB at a time stay in the cache
    sums = np.zeros((n, len(model.languages)))
    doc = np.repeat(np.arange(n), length)
    for a in range(0, len(at), step):
        here = at[a : a + step]
        state = np.zeros(len(here), np.int32)
        for d in range(order):
            state = model.steps[d][state * model.letters + padded[here - d - 1]]
        bits = model.cost[state * model.letters + padded[here]]
        owner = doc[a : a + step]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        sums[owner[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
    return sums


PREDICTED = "doc_id long, lang_pred string, score double, bits_per_byte double"
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def _send(docs: DataFrame, model: Model) -> list:
    """Broadcasts of the models of all languages, each its own."""
    return [docs.sparkSession.sparkContext.broadcast(m) for m in (replace(model, rest=()), *model.rest)]


def _predict(models: list[Model], part: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, share of belief and bits a byte of each text of a slice."""
    raw, offsets = text_buffer(part.column("text"))
    n = len(offsets) - 1
    languages = [lang for m in models for lang in m.languages]
    if not languages:
        return [UNDECIDED] * n, np.zeros(n), np.zeros(n)
    bits = np.concatenate([code_lengths(m, raw, offsets) for m in models], axis=1)
    best = bits.argmin(1)
    least = bits[np.arange(n), best]
    belief = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    lettered = np.asarray(part.column("lettered"), bool)
    lang = [languages[b] if ok else UNDECIDED for b, ok in zip(best, lettered)]
    return lang, np.where(lettered, belief, 0.0), least / np.maximum(np.diff(offsets), 1)


def _with_letters(docs: DataFrame) -> DataFrame:
    return docs.withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` of every whole text."""
    shared = _send(docs, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lang, score, rate = _predict([m.value for m in shared], part)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(lang), pa.array(score), pa.array(rate)], schema=_OUT
            )

    return _with_letters(documents(docs)).mapInArrow(run, PREDICTED)


def keep_readable(docs: DataFrame, model: Model, most_bits: float = _RAW_BITS) -> DataFrame:
    """The documents with a language, all columns as they are: not ``und``, and described by some
    language in fewer bits than their plain bytes take. Rows pass through, nothing is shuffled."""
    shared = _send(docs, model)
    columns = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lang, _, rate = _predict([m.value for m in shared], part)
            keep = np.array([x != UNDECIDED for x in lang], bool) & (rate < most_bits)
            yield pa.RecordBatch.from_arrays([part.column("row")], names=["row"]).filter(pa.array(keep))

    kept = _with_letters(whole).mapInArrow(run, whole.select("row").schema)
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))
