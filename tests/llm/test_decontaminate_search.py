"""The search for test items against all pairs, and items that have no seed in the usual way."""

import re

import numpy as np
import pytest

from pulseframe.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
TEXT, ITEM = "doc_id long, text string", "item_id long, text string"


def _hits(spark, docs, items, nameless=()):
    """What is found; dropped are the documents of these and those that hold items without id."""
    docs = spark.createDataFrame(docs, TEXT) if isinstance(docs, list) else docs
    bench = spark.createDataFrame(items, ITEM) if isinstance(items, list) else items
    kept = {r.doc_id for r in D.drop_contaminated(docs, bench).collect()}
    hits = D.find_leaks(docs, bench, least_words=1).collect()
    assert kept == {r.doc_id for r in docs.collect()} - {r.doc_id for r in hits} - set(nameless)
    return hits


def test_search_is_that_of_all_pairs(spark):
    """Every document aligned with every item, but where too few of the item's words are there at all.
    Beside the copies that the table holds there are some with a fifth of the words changed."""
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    rng = np.random.default_rng(3)
    filler = docs.filter("lang = 'en'").orderBy("doc_id").first().text.split()[:60]
    planted = []
    for r in bench.orderBy("item_id").limit(30).collect():
        words = [w if rng.random() > 0.2 else f"x{rng.integers(99)}" for w in r.text.split()]
        planted.append((10_000 + r.item_id, " ".join([*filler, *words, *filler])))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(planted, TEXT))
    number: dict = {}

    def coded(text):
        return np.array([number.setdefault(w, len(number)) for w in re.findall(r"[^\W_]+", (text or "").lower())], np.uint64)

    texts = [(r.doc_id, coded(r.text)) for r in docs.collect()]
    want = {}
    for item in bench.collect():
        words = coded(item.text)
        for doc_id, have in texts:
            if np.isin(words, have).sum() >= 0.5 * len(words) > 0:
                score = D.align(words, have)[0]
                if score >= 0.5:
                    want[doc_id, item.item_id] = pytest.approx(score)
    assert len(want) >= 20
    assert {(r.doc_id, r.item_id): r.score for r in _hits(spark, docs, bench)} == want


def test_texts_without_blanks(spark):
    rng = np.random.default_rng(1)
    signs = [chr(c) for c in range(0x4E00, 0x5E00)]
    make = lambda n: "".join(rng.choice(signs, n))
    item, thai = make(60), "".join(rng.choice([chr(c) for c in range(0x0E01, 0x0E2F)], 60))
    changed = "".join(c if i % 7 else "\u4e00" for i, c in enumerate(item))
    docs = [
        (1, f"before {item} after"), (2, item + "."), (3, make(200) + item + make(200)), (4, f"{item[:30]}\u3002{item[30:]}"),
        (5, make(300) + changed), (6, make(500)), (7, "plain words only"), (8, None), (9, f"x{thai}y"), (10, item[:20] + make(100)),
    ]
    got = {(r.doc_id, r.item_id) for r in _hits(spark, docs, [(1, item), (2, thai)])}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (9, 2)}


def test_short_items_and_items_without_id(spark):
    long = "seven words make up this whole item"
    docs = [
        (1, "One, two!"), (2, "one two three"), (3, "zebra"), (4, "a zebra crossing"), (5, long), (6, f"so {long} here"),
        (7, None), (8, ""), (9, "..."), (10, "one"), (11, "two one"),
    ]
    hits = _hits(spark, docs, [(3, "one two"), (4, "one two"), (5, "Zebra"), (None, long), (6, ""), (7, None), (8, "\u2014 ...")], nameless=[5, 6])
    got = sorted((r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in hits)
    assert got == [(1, 3, 1.0, 0, 2), (1, 4, 1.0, 0, 2), (3, 5, 1.0, 0, 1)]


def test_a_rare_short_item_is_found_inside(spark):
    filler = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(2000))) for i in range(20)]
    docs = [*filler, (100, filler[0][1] + " quokka wombat " + filler[1][1])]
    got = [(r.doc_id, r.item_id, r.start_word) for r in _hits(spark, docs, [(1, "quokka wombat"), (2, "w1 w2")])]
    assert got == [(100, 1, 2000)]
