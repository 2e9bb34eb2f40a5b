"""Toxicity by a classifier chain.

The labelled categories are predicted one after the other by linear models over words and word
beginnings; each later model also sees the probabilities of the earlier categories. While
training, these come from models that did not see the row (out-of-fold), so a later model learns
from probabilities like those it will get.

Training takes a bounded sample of labelled documents, picked by a hash of doc_id, and for each
category the words that tell most about it. A feature counts once however often it occurs, and
words without a say have no weight, so long texts are judged like short ones.

Null texts have no words and get the probabilities of an empty text. Labels that are null or have
no document teach nothing; of repeated labels of a document the larger counts. A category that is
constant in the sample is predicted as that constant; without any label it is 0. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.decontaminate import Lookup
from pulseframe.llm.tables import documents
from pulseframe.llm.words import U, Words, lower, mix, pack, range_hash, slices, text_buffer, unpack, _BYTE

#: the sample of labelled documents, the features of a category, and bytes of a word's beginnings
SAMPLE, FEATURES, STEMS = 6000, 400, (4, 6)
FOLDS, STEPS, RIDGE = 3, 300, 1.0
LEAST_DOCS = 5


def _features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of words and word beginnings, and the text of each."""
    raw, offsets = text_buffer(part.column("text"))
    words = Words(lower(raw), offsets, loose=True)
    stems = [range_hash(words.raw, words.start, np.minimum(words.start + n, words.end), 0x2545F4914F6CDD1D, of=_BYTE) ^ U(n) for n in STEMS]
    return np.concatenate([words.hash, *(mix(x) for x in stems)]), np.tile(words.text, 1 + len(STEMS))


@dataclass
class Link:
    """The model of one category: weights of features, of earlier categories, and the constant."""

    category: str
    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def logit(self, sums: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return sums + earlier @ self.earlier + self.constant


@dataclass
class Chain:
    keys: np.ndarray
    links: list[Link] = field(default_factory=list)

    def predict(self, n: int, text: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Probabilities of ``n`` texts by category, from the features that occur in each."""
        out = np.zeros((n, 0))
        for link in self.links:
            sums = np.bincount(text, link.weights[feature], minlength=n)
            out = np.column_stack([out, sigmoid(link.logit(sums, out))])
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by accelerated gradient steps; the last weight is the
    constant and has no penalty."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    v = np.ones(x.shape[1])
    for _ in range(20):  # the largest curvature sets the step
        v = x.T @ (x @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1 / (0.25 * np.linalg.norm(x @ v) ** 2 + RIDGE)
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 0
    w = ahead = np.zeros(x.shape[1])
    for t in range(STEPS):
        gradient = x.T @ (sigmoid(x @ ahead) - y) + ridge * ahead
        new = ahead - step * gradient
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


def telling(present: list[np.ndarray], y: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """The features whose presence says most about ``y`` (by the likelihood ratio)."""
    keys, owner = np.concatenate(present), np.repeat(y, [len(p) for p in present])
    key, at = np.unique(keys, return_inverse=True)
    n = np.bincount(at, minlength=len(key)).astype(float)
    k = np.bincount(at, owner, minlength=len(key))
    total, hits = len(y), y.sum()
    if not len(key) or hits in (0, total):
        return key[:0]
    a, b, c, d = k, n - k, hits - k, total - hits - (n - k)
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0)
    ratio = part(a, n * hits / total) + part(b, n * (total - hits) / total) + part(c, (total - n) * hits / total) + part(d, (total - n) * (total - hits) / total)
    ratio[n < LEAST_DOCS] = 0
    best = np.lexsort((key, -ratio))[:most]
    return np.sort(key[best[ratio[best] > 5]])


def train_chain(present: list[np.ndarray], labels: np.ndarray, categories: Sequence[str], fold: np.ndarray) -> Chain:
    """``present``: distinct feature hashes of each sampled document; ``labels`` by category."""
    n = len(present)
    if not n:
        return Chain(np.zeros(0, U), [Link(c, np.zeros(0), np.zeros(j), -40.0) for j, c in enumerate(categories)])
    chosen = [telling(present, labels[:, j]) for j in range(len(categories))]
    keys = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, U)
    known = Lookup(keys)
    x = np.zeros((n, len(keys)))
    for i, p in enumerate(present):
        x[i, known.find(p)[1]] = 1
    chain, earlier = Chain(keys), np.zeros((n, 0))
    for j, category in enumerate(categories):
        y, own = labels[:, j].astype(float), np.isin(keys, chosen[j])
        rows = np.column_stack([x[:, own], earlier])
        w = fit(rows, y) if 0 < y.sum() < n else np.append(np.zeros(rows.shape[1]), 40.0 if y.sum() else -40.0)
        weights = np.zeros(len(keys))
        weights[own] = w[: own.sum()]
        chain.links.append(Link(category, weights, w[own.sum() : -1], float(w[-1])))
        outside = np.empty(n)
        for f in range(FOLDS):
            out = fold == f
            ok = (~out).any() and 0 < y[~out].sum() < (~out).sum()
            part = fit(rows[~out], y[~out]) if ok else w
            outside[out] = sigmoid(rows[out] @ part[:-1] + part[-1])
        earlier = np.column_stack([earlier, outside])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most ``sample`` labelled documents."""
    named = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(c).cast("int").alias(f"label_{i}") for i, c in enumerate(categories)))
    named = named.dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = documents(docs).join(F.broadcast(named), "doc_id")  # at most ``sample`` rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            feature, text = _features(part)
            order = np.argsort(text, kind="stable")
            cut = np.searchsorted(text[order], np.arange(part.num_rows + 1))
            feature = feature[order]
            packed = [pack(np.unique(feature[a:b])) for a, b in zip(cut, cut[1:])]
            marks = [part.column(f"label_{i}") for i in range(len(categories))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(packed, pa.binary()), *marks],
                                             names=["doc_id", "features", *(f"label_{i}" for i in range(len(categories)))])

    schema = "doc_id long, features binary" + "".join(f", label_{i} int" for i in range(len(categories)))
    rows = chosen.mapInArrow(run, schema).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    present = [unpack(x) for x in rows.column("features").to_pylist()]
    y = np.column_stack([np.asarray(rows.column(f"label_{i}")) for i in range(len(categories))]) if len(present) else np.zeros((0, len(categories)))
    fold = (mix(np.asarray(rows.column("doc_id")).view(U)) % U(FOLDS)).astype(int) if len(present) else np.zeros(0, int)
    return train_chain(present, y, categories, fold)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id`` and ``p_<category>`` of every whole text, in the order of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *(f"p_{link.category}" for link in chain.links)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        known = Lookup(chain.keys)
        for part in slices(batches):
            feature, text = _features(part)
            hit, at = known.find(feature)
            pairs = np.unique(text[hit] * max(len(chain.keys), 1) + at)
            p = chain.predict(part.num_rows, pairs // max(len(chain.keys), 1), pairs % max(len(chain.keys), 1))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in p.T)], names=names)

    return documents(docs).mapInArrow(run, "doc_id long" + "".join(f", {n} double" for n in names[1:]))
