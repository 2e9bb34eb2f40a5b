"""Importance resampling against brute force, with runs of one and of several words."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import importance as I

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, order):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return ws, [" ".join(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1)]


def brute(rows, target, order, buckets, min_words, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in features(t, order)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x, order)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for doc, text in rows:
        ws, fs = features(text, order)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    near = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(near[: len(near) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=ORDER)


ORDER = lambda r: tuple((x is not None, x) for x in r)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    lines = [" ".join(f"{'Wé'[k % 2]}{rng.integers(40)}" for k in range(rng.integers(0, 9))) for _ in range(60)]
    out = [(i, "\n".join(rng.choice(lines, rng.integers(1, 9)))) for i in range(150)]
    out += [(200, None), (201, ""), (202, "\n\n \n"), (203, "#?! \n..."), (None, "a b\nc d"), (204, "long" * 40_000 + " x"), (205, "Same LINE\n" * 4_000)]
    return out + [(206, "one two\nthree")] * 3 + [(207, "tail without end\nof line"), (208, "of line\ntail without end\n")]


TARGET = ["w1 w2 é3 w4\nw5", None, "", "é7 w1\nw2"]


@pytest.mark.parametrize("order, buckets, least, percent", [(1, 10_000, 20, 10), (3, 500, 1, 40), (2, 7, 5, 100)])
def test_brute_force(spark, rows, order, buckets, least, percent):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA).repartition(3)
    for name in ("row", "key", "line", "n", "times", "score", "rank", "bucket"):
        docs = docs.withColumn(name, F.lit("x"))
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = I.resample(docs, target, order, buckets, least, percent)
    assert sorted((tuple(r) for r in got.collect()), key=ORDER) == brute(rows, TARGET, order, buckets, least, percent)


def test_empty(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert I.resample(empty, empty).count() == 0
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    got = I.resample(docs, empty, 1, 100, 1, 10)
    assert sorted((tuple(r) for r in got.collect()), key=ORDER) == brute(rows, [], 1, 100, 1, 10)


def test_crc32():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 5_000).astype(np.uint8)
    start = rng.integers(0, 4_000, 300)
    end = start + np.concatenate([rng.integers(0, 60, 290), rng.integers(60, 900, 10)])
    assert I.crc32(raw, start, end).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(start, end)]
