"""Language-model scores by Katz backoff over words.

Counting: training texts are counted in the tasks that read them, and what each counted is merged
by ranges of a hash; the counts and the counts of counts are written as one table partitioned by
kind, the bigrams of a range packed into one row. Good-Turing discounts follow from the counts of
counts. Every bigram seen keeps its discounted share of its history; what a history has left goes
to the words not seen after it, in proportion to their unigram probabilities, with a backoff
weight that makes the sum over all words exactly one: a range of bigrams asks for each of its
distinct words once and sums up its histories. Unigrams are discounted the same way, and what they
leave belongs to the one class of unknown words.

Scoring: a token's probability is its bigram's, else the history's weight times the unigram's,
else that of an unknown word. The sum over a text is taken as unigrams and weights of all tokens,
plus for each seen bigram what it gains over backing off. Documents are dealt into blocks once;
a block asks for each distinct n-gram once, whatever its number of copies, and hears the counts.
Questions and answers take more disk than the texts, so documents are scored in rounds, and those
of a round are dropped when its scores are written.

Tokens are words (runs of anything but white space, A-Z in lower case) and one end a document;
its first history is a beginning that is no token. A null text is empty and has its end alone.
Without training rows every probability is 1 and every score 0. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.llm.blocks import deal, opened, whole
from pulseframe.llm.tables import documents, groups_for, release, stored
from pulseframe.llm.words import U, Words, lower, mix, narrow, pack, slices, text_buffer, unpack, widen

#: discounts apply to counts up to K; bigrams of LEAST occurrences at least are seen, which is all of them
K, LEAST = 5, 1
#: rounds in which documents are scored, if they make as many blocks
ROUNDS = 4
#: tokens that a task counts before it sends the counts on
HELD = 2_000_000
UNIGRAM, BIGRAM, COUNTS = 1, 2, 0
END, BEGIN = U(0x7A3C_55E1_0D94_B62F), U(0x1F83_D9AB_FB41_BD6B)
_PAIR = U(0xD6E8FEB86659FD93)
#: bits of a bigram's key that its history gives
_LEAD = 16


def _tokens(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, the history of each, and its text's number."""
    column = part.column("text")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw, offsets = text_buffer(column)
    words = Words(lower(raw), offsets)
    n = len(offsets) - 1
    size = np.diff(words.first) + 1
    last = np.cumsum(size) - 1
    token = np.empty(len(words) + n, U)
    place = np.ones(len(token), bool)
    place[last] = False
    token[place], token[last] = words.hash, END
    history = np.empty(len(token), U)
    history[1:] = token[:-1]
    history[last - size + 1] = BEGIN
    return token, history, np.repeat(np.arange(n), size)


def pair_key(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The first bits bring the bigrams of a history together; a frequent one is dealt over
    sixteen places by its successor."""
    lead = mix(history + (token >> U(60)) * _PAIR) >> U(64 - _LEAD)
    return (lead << U(64 - _LEAD)) | (mix(history * _PAIR + token) >> U(_LEAD))


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in ascending keys, and the end."""
    return np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _ascending(x: np.ndarray) -> np.ndarray:
    """The distinct values. ``np.unique`` alone hashes whole numbers before it sorts them, which takes
    many times longer than to sort them all."""
    x = np.sort(x)
    return x[_firsts(x)] if len(x) else x


def _packed(h: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Bigrams and their counts: each history once, how many follow, and the words."""
    order = np.argsort(h)
    h = h[order]
    first = _firsts(h)
    return pack(h[first]), narrow(np.diff(np.append(first, len(h)))), w[order].tobytes(), narrow(n[order])


def _unpacked(a: bytes, runs: bytes, b: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(unpack(a), widen(runs).astype(np.int64)), np.frombuffer(b, U), widen(n).astype(np.int64)


# ---- counting

_SENT = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("a", pa.binary()), ("runs", pa.binary()), ("b", pa.binary()), ("n", pa.binary()),
])


def _counter(ranges: int) -> Callable:
    def send(token: np.ndarray, history: np.ndarray) -> Iterator[tuple]:
        word, n = np.unique(token, return_counts=True)
        cut = _cuts(word, ranges)
        for i in np.flatnonzero(np.diff(cut)):
            a, b = cut[i], cut[i + 1]
            yield UNIGRAM, i, pack(word[a:b]), b"", b"", narrow(n[a:b])
        key = pair_key(history, token)
        order = np.argsort(key)
        key = key[order]
        new = _firsts(key)
        n = np.diff(np.append(new, len(key)))
        h, w, key = history[order[new]], token[order[new]], key[new]
        cut = _cuts(key, ranges)
        for i in np.flatnonzero(np.diff(cut)):
            a, b = cut[i], cut[i + 1]
            yield BIGRAM, i, *_packed(h[a:b], w[a:b], n[a:b])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            rows = list(send(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)

        for part in slices(batches):
            held.append(_tokens(part)[:2])
            if sum(len(x[0]) for x in held) > HELD:
                yield flush()
        if held:
            yield flush()

    return run


_MERGED = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("w", pa.int64()), ("n", pa.int64()),
    ("a", pa.binary()), ("runs", pa.binary()), ("b", pa.binary()), ("m", pa.binary()),
])
_COUNTED = "kind int, part int, w long, n long, a binary, runs binary, b binary, m binary"


def _merged(table: pa.Table) -> pa.Table:
    """Counts of one range summed: a row for every unigram, one row for all bigrams, and the counts
    of counts, with ``part`` for the kind and ``w`` for the count."""
    kind, part = (table.column(c)[0].as_py() for c in ("kind", "part"))
    rows = zip(*(table.column(c).to_pylist() for c in ("a", "runs", "b", "n")))
    hs, ws, ns = [], [], []
    for a, runs, b, n in rows:
        h, w, n = _unpacked(a, runs, b, n) if kind == BIGRAM else (U([]), unpack(a), widen(n).astype(np.int64))
        hs.append(h), ws.append(w), ns.append(n)
    h, w, n = np.concatenate(hs), np.concatenate(ws), np.concatenate(ns)
    del hs, ws, ns
    key = w if kind == UNIGRAM else pair_key(h, w)
    order = np.argsort(key)
    new = _firsts(key[order])
    del key
    n = np.add.reduceat(n[order], new)
    order = order[new]
    of_counts = np.bincount(np.minimum(n, K + 2), minlength=K + 3)[: K + 2]
    of_counts[0] = len(n)
    w = w[order]
    single = len(w) if kind == UNIGRAM else 0
    packed = [] if kind == UNIGRAM else [_packed(h[order], w, n)]
    more = K + 3
    rest = more + len(packed)
    none = [None] * (single + more)
    signed = lambda x: x.view(np.int64)
    return pa.table([pa.array(c, f.type) for c, f in zip((
        np.concatenate([np.full(single, kind), np.full(more, COUNTS), np.full(len(packed), kind)]),
        np.concatenate([np.full(single, part), np.full(more, kind), np.full(len(packed), part)]),
        np.concatenate([signed(w[:single]), np.arange(more), np.zeros(len(packed), np.int64)]),
        np.concatenate([n[:single], of_counts, [n.sum()], np.zeros(rest - more, np.int64)]),
        *([*none, *(p[i] for p in packed)] for i in range(4)),
    ), _MERGED)], schema=_MERGED)


# ---- the model


def discounts(of_counts: list[int]) -> list[float]:
    """Good-Turing factors for counts 1 to K; ``of_counts[r]`` types occur r times. Where the
    counts of counts give no factor in (0, 1], the count stays as it is."""
    n = of_counts
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 1.0
        out.append(d if 0 < d <= 1 else 1.0)
    return out


@dataclass
class Shared:
    """What all tokens share. The beginning is no token, so its values as a history are here."""

    ranges: int
    tokens: int
    words: int
    unknown: float
    scale: float
    uni: list
    bi: list
    begin: tuple = (0, 0.0, 0.0)

    def p_word(self, n: np.ndarray) -> np.ndarray:
        """Probabilities of words by count; 0 is unknown."""
        return np.where(n > 0, _discounted(n, self.uni) * self.scale / max(self.tokens, 1), self.unknown)


@dataclass
class Model:
    """``counts`` (kind, part, w, n of a word; a, runs, b, m: the packed bigrams of a range) and
    ``weights`` (h, n_history, log_alpha, log_scale: of each history). Logarithms are decimal."""

    counts: DataFrame
    weights: DataFrame
    shared: Shared

    @property
    def tokens(self) -> int:
        return self.shared.tokens


def train(docs: DataFrame, ranges: int | None = None) -> Model:
    """The model of whole texts of all rows."""
    spark = docs.sparkSession
    ranges = ranges or groups_for(docs)
    sent = documents(docs).mapInArrow(_counter(ranges), "kind int, part int, a binary, runs binary, b binary, n binary")
    counts = stored(sent.groupBy("kind", "part").applyInArrow(_merged, _COUNTED), "ngram-counts", "kind")
    del sent
    sums = {(r["part"], r["w"]): r["n"] for r in counts.filter(F.col("kind") == COUNTS).groupBy("part", "w").agg(F.sum("n").alias("n")).collect()}
    release(spark)  # after another job: Spark holds on to the shuffles of its last one
    of = {kind: [sums.get((kind, r), 0) for r in range(K + 3)] for kind in (UNIGRAM, BIGRAM)}
    tokens, words = of[UNIGRAM][K + 2], of[UNIGRAM][0]
    uni, bi = discounts(of[UNIGRAM]), discounts(of[BIGRAM])
    left = sum((1 - d) * (r + 1) * of[UNIGRAM][r + 1] for r, d in enumerate(uni)) / max(tokens, 1)
    scale = 1.0 if left > 0 else tokens / (tokens + 1)  # nothing discounted: one token is set aside
    unknown = (left if left > 0 else 1 / (tokens + 1)) if tokens else 1.0
    shared = Shared(ranges, tokens, words, unknown, scale, uni, bi)
    weights = stored(_weights(counts, shared), "backoff")
    begin = weights.filter(F.col("h") == int(BEGIN.astype(np.int64))).select("n_history", "log_alpha", "log_scale").first()
    release(spark)
    shared.begin = tuple(begin) if begin else shared.begin
    return Model(counts, weights, shared)


def _discounted(n: np.ndarray, factors: list[float]) -> np.ndarray:
    """The discounted count."""
    return n * np.array([1.0, *factors, 1.0])[np.minimum(n, K + 1)]


def _weights(counts: DataFrame, shared: Shared) -> DataFrame:
    """What each history keeps for the words seen after it, and the weight of the others."""
    pairs = counts.filter(F.col("kind") == BIGRAM)
    words = counts.filter(F.col("kind") == UNIGRAM).select("part", "w", "n")
    asked = pairs.select("part", "b").mapInArrow(_word_asker(shared.ranges), "part int, place int, keys binary")
    told = asked.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(_tell_words, "place int, part int, n binary")
    sums = pairs.select("part", "a", "runs", "b", "m").groupBy("part").cogroup(told.groupBy("place")).applyInArrow(
        _summer(shared), "h long, n long, kept double, covered double")
    sums = sums.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", "kept", "covered")))
    kept = F.col("kept") / F.col("n")
    # where discounting took nothing from a history, one more occurrence leaves room to back off
    scale = F.when(kept > 1 - 1e-9, F.col("n") / (F.col("n") + 1) / kept).otherwise(F.lit(1.0))
    log_alpha = F.log10((1 - kept * scale) / (1 - F.col("covered")))
    return sums.select("h", F.col("n").alias("n_history"), log_alpha.cast("float").alias("log_alpha"), F.log10(scale).cast("float").alias("log_scale"))


def _word_asker(ranges: int) -> Callable:
    schema = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("keys", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, b in zip(batch.column("part").to_pylist(), batch.column("b")):
                words = _ascending(np.frombuffer(b.as_py(), U))
                cut = _cuts(words, ranges)
                rows = [(i, place, pack(words[cut[i] : cut[i + 1]])) for i in np.flatnonzero(np.diff(cut))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _tell_words(asked: pa.Table, words: pa.Table) -> pa.Table:
    """The counts of the words of one range, for each asking place in the order of its keys."""
    key = np.asarray(words.column("w")).view(U)
    order = np.argsort(key)
    key, n = key[order], np.asarray(words.column("n"))[order]
    rows = [(place, part, narrow(n[np.searchsorted(key, unpack(keys))]))
            for part, place, keys in zip(*(asked.column(c).to_pylist() for c in ("part", "place", "keys")))]
    columns = zip(*rows) if rows else [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["place", "part", "n"])


def _summer(shared: Shared) -> Callable:
    def run(pairs: pa.Table, told: pa.Table) -> pa.Table:
        hs, sums = [], []
        for row in zip(*(pairs.column(c).to_pylist() for c in ("a", "runs", "b", "m"))):  # one row
            h, w, m = _unpacked(*row)
            answers = sorted(zip(*(told.column(c).to_pylist() for c in ("part", "n"))))
            n = np.concatenate([widen(x) for _, x in answers]).astype(np.int64)  # of all distinct words, ascending
            p = shared.p_word(n)[np.unique(w, return_inverse=True)[1]]
            first = _firsts(h)
            hs.append(h[first])
            sums.append([np.add.reduceat(x, first) for x in (m, _discounted(m, shared.bi), p)])
        n, kept, covered = (np.concatenate([s[i] for s in sums] or [[]]) for i in range(3))
        h = np.concatenate(hs).view(np.int64) if hs else []
        return pa.table([pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.float64()), pa.array(covered, pa.float64())],
                        names=["h", "n", "kept", "covered"])

    return run


# ---- scoring


def _blocks(docs: DataFrame, blocks: int) -> DataFrame:
    return deal(docs, F.pmod(_dealt(), F.lit(blocks)).cast("int"), blocks)


def _dealt() -> Column:
    """What a document is dealt by."""
    return F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))


def _distinct(part: pa.RecordBatch) -> tuple:
    """Tokens of a block, and its distinct words and bigrams, ascending, with the place of each
    token's word and bigram among them, and for each bigram the places of its history (-1 is the
    beginning) and its word."""
    parts = [_tokens(x) for x in slices([part])]
    token, history = (np.concatenate([p[i] for p in parts]) for i in range(2))
    text = np.repeat(np.arange(part.num_rows), np.concatenate([np.bincount(p[2]) for p in parts]))
    del parts
    word, word_at = np.unique(token, return_inverse=True)
    pair, at, pair_at = np.unique(pair_key(history, token), return_index=True, return_inverse=True)
    before = np.where(history[at] == BEGIN, -1, word_at[at - 1])
    return text, word, word_at, pair, pair_at, before, word_at[at]


def _asker(ranges: int) -> Callable:
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), opened(batch)):
                for some in slices([part]):
                    token, history, _ = _tokens(some)
                    held.setdefault(block, []).append((_ascending(token), _ascending(pair_key(history, token))))
        for block, parts in held.items():
            for kind, nth in ((UNIGRAM, 0), (BIGRAM, 1)):
                keys = _ascending(np.concatenate([p[nth] for p in parts]))
                cut = _cuts(keys, ranges)
                rows = [(kind, i, block, pack(keys[cut[i] : cut[i + 1]])) for i in np.flatnonzero(np.diff(cut))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _tell(asked: pa.Table, model: pa.Table) -> pa.Table:
    """What the model has on the keys of one range, for each block in the order of its keys."""
    packed = [_unpacked(*row) for row in zip(*(model.column(c).to_pylist() for c in ("a", "runs", "b", "m"))) if row[0] is not None]
    if packed:  # one row of bigrams
        h, w, n = packed[0]
        key, values = pair_key(h, w), [n]
    else:
        key = np.asarray(model.column("w")).view(U)
        values = [np.asarray(model.column(c)) for c in ("n", "log_alpha", "log_scale")]
    order = np.argsort(key)
    key = key[order]
    n, *floats = (v[order] for v in values)
    rows = []
    for kind, part, block, keys in zip(*(asked.column(c).to_pylist() for c in ("kind", "part", "block", "keys"))):
        keys = unpack(keys)
        at = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
        has = key[at] == keys if len(key) else np.zeros(len(keys), bool)
        at = at[has]
        x = np.concatenate([v[at].astype(np.float32) for v in floats]).tobytes() if floats else b""
        rows.append((block, kind, part, np.packbits(has).tobytes(), narrow(n[at]), x))
    columns = zip(*rows) if rows else [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 3))],
                    names=["block", "kind", "part", "has", "n", "x"])


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scorer(model: Shared) -> Callable:
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        docs = whole(docs)
        ids = docs.column("doc_id")
        if not docs.num_rows:
            return pa.table([ids, *[pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]],
                            names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        text, word, word_at, pair, pair_at, before, after = _distinct(docs)
        # the last place of the words is the beginning
        count, alpha, log_scale = np.zeros(len(word) + 1, np.int64), np.zeros(len(word) + 1), np.zeros(len(word) + 1)
        seen = np.zeros(len(pair), np.int64)
        cuts = {UNIGRAM: _cuts(word, model.ranges), BIGRAM: _cuts(pair, model.ranges)}
        for kind, part, has, n, x in zip(*(told.column(c).to_pylist() for c in ("kind", "part", "has", "n", "x"))):
            a, b = cuts[kind][part], cuts[kind][part + 1]
            at = a + np.flatnonzero(np.unpackbits(np.frombuffer(has, np.uint8), count=b - a))
            if kind == BIGRAM:
                seen[at] = widen(n)
            else:
                count[at] = widen(n)
                alpha[at], log_scale[at] = np.frombuffer(x, np.float32).reshape(2, -1)
        count[-1], alpha[-1], log_scale[-1] = model.begin
        log_p = np.log10(model.p_word(count[:-1]))
        base = np.log10((count[:-1] + 1) / (model.tokens + model.words + 1))
        of_word = log_p + np.where(word == END, 0.0, alpha[:-1])  # as a token, and as the next one's history
        # what a seen bigram gains over backing off
        gain = np.zeros(len(pair))
        at = np.flatnonzero(seen)
        h = before[at]
        gain[at] = np.log10(_discounted(seen[at], model.bi) / count[h]) + log_scale[h] - alpha[h] - log_p[after[at]]
        rows = docs.num_rows
        total = lambda v: np.bincount(text, v, minlength=rows)
        return pa.table([
            ids, pa.array(np.bincount(text, minlength=rows)), pa.array(total((count > 0)[word_at]).astype(np.int64)),
            pa.array(total(base[word_at])), pa.array(total(of_word[word_at] + gain[pair_at]) + model.begin[1]),
        ], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, groups: int | None = None, rounds: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every whole text."""
    groups = groups or groups_for(docs)
    rounds = rounds or min(ROUNDS, groups)
    if rounds == 1:
        return _scored(docs, model, groups)
    # by other bits than those that choose the block
    turn = F.pmod(F.shiftright(_dealt(), 32), F.lit(rounds))
    out = None
    for i in range(rounds):
        part = stored(_scored(docs.filter(turn == i), model, -(-groups // rounds)), "scores")
        part.agg(F.count("*")).first()
        release(docs.sparkSession)  # after another job, as above
        out = part if out is None else out.unionAll(part)
    return out


def _scored(docs: DataFrame, model: Model, groups: int) -> DataFrame:
    ranges = model.shared.ranges
    base = _blocks(docs, groups)
    asked = base.mapInArrow(_asker(ranges), "kind int, part int, block int, keys binary")
    # words that are no history have no weight
    words = model.counts.filter(F.col("kind") == UNIGRAM).select("part", "w", "n").join(model.weights.withColumnRenamed("h", "w"), "w", "left")
    values = (F.coalesce(c, F.lit(0.0)).cast("float").alias(c) for c in ("log_alpha", "log_scale"))
    words = words.select(F.lit(UNIGRAM).alias("kind"), "part", "w", "n", *values)
    pairs = model.counts.filter(F.col("kind") == BIGRAM).select("kind", "part", "a", "runs", "b", "m")
    table = words.unionByName(pairs, allowMissingColumns=True)
    told = asked.groupBy("kind", "part").cogroup(table.groupBy("kind", "part")).applyInArrow(
        _tell, "block int, kind int, part int, has binary, n binary, x binary")
    return base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scorer(model.shared), SCORED)
