"""The divergence of sources against brute force, and the perfect hashes it counts with."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import divergence as D, perfect_hash as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, top, alpha=D.ALPHA, scale=D.SCALE):
    df, counts, groups = collections.Counter(), collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        ts = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        df.update((lang, t) for t in set(ts))
        counts[lang, source].update(ts)
        groups.add((lang, source))
    kept = collections.defaultdict(list)
    for (lang, t), n in df.items():
        if n >= min_docs:
            kept[lang].append(t)

    def shares(lang, c):
        n, v = sum(c[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + scale * (c[t] + alpha) // (n + alpha * v) for t in kept[lang]}

    p = {g: shares(g[0], counts[g]) for g in groups}
    out = []
    for lang, source in groups:
        whole = shares(lang, sum((counts[g] for g in groups if g[0] == lang), collections.Counter()))
        mine = p[lang, source]
        pairs = [(sum(abs(mine[t] - p[lang, o][t]) for t in kept[lang]), o) for la, o in groups if la == lang and o != source]
        terms = [(mine[t] - whole[t], t) for t in kept[lang] if counts[lang, source][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            best = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    words = [f"{'aBé𝔘'[i % 4]}{'xyz'[i % 3] * (i % 5)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    out = [(" 1 ".join(rng.choice(words, 30)), ["en", "fr", None][i % 3], f"s{i % 7}" if i % 11 else None) for i in range(200)]
    out += [(None, "en", "null text"), ("", "en", "no text"), ("12 34", "xx", "no terms"), ("rare", "xx", "too rare"), ("a", "one", "alone")]
    return out + [("same text", "en", "s0")] * 40 + [("word " * 60_000 + "x" * 70_000, "en", "long")]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, la, s, 1) for i, (t, la, s) in enumerate(rows)], SCHEMA).repartition(5)
    for name in ("shard", "term", "n", "slots", "place", "kind", "v"):
        docs = docs.withColumn(name, F.lit("x"))
    return sorted(tuple(r) for r in D.audit(docs, **options).collect())


def test_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows, 30, 50)


def test_many_shards_rounds_blocks_and_flushes(spark, rows, monkeypatch):
    """Small bounds: a few terms a shard, one shard a round, two groups a block, sums sent often."""
    monkeypatch.setattr(D, "BLOCK", 2)
    monkeypatch.setattr(D, "HELD_SLOTS", 40)
    monkeypatch.setattr(D, "SLICE", 500)
    assert run(spark, rows, min_docs=3, top=4, shard_terms=25, sent_bytes=3_000) == brute(rows, 3, 4)


def test_empty_and_no_frequent_terms(spark, rows):
    assert run(spark, []) == []
    assert run(spark, rows, min_docs=10_000) == brute(rows, 10_000, 50)


def test_large_counts():
    counts = np.array([0, 7, 10**11, 4 * 10**17])
    n = int(counts.sum())
    assert [int(x) for x in D._share(counts, n, 4, 5, 10**9)] == [1 + 10**9 * (int(c) + 5) // (n + 20) for c in counts]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 5_000])
def test_perfect_hash(n):
    keys = pa.array([f"k{i}é" for i in range(n)])
    salt, displacement, ordered = P.build(keys)
    assert sorted(ordered.to_pylist()) == sorted(keys.to_pylist())
    assert P.find(ordered, P.hashes(ordered, salt), displacement, ordered).tolist() == list(range(n))
    others = pa.array([f"x{i}" for i in range(1_000)] + [""])
    assert (P.find(others, P.hashes(others, salt), displacement, ordered) == -1).all()
