"""The training-text operators against SQL, brute force, round trips and held-out labels."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import Row, functions as F

import corpus_pipeline
import public_tokenizers
from pulseframe.llm import (
    bpe, components, decontaminate, exact_dedup, katz, language_id, near_dedup, queries, secrets, substrings,
    token_counts, toxicity,
)
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").translate(LOWER)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    base = " ".join(f"w{i % 97}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (4, "One", None, "s", 3),
        (5, "one", "en", None, 3), (6, base, "en", "s", len(base)), (7, base + " tail", "en", "s", 1), (7, base + " tail", "en", "s", 1),
        (8, "é" * 50_000, "fr", "s", 1), (9, "one two", "de", "s", 1), (None, "one two", "de", "s", 1), (10, "ONE", "en", "s", 1),
        (11, "12 34 ?!", "en", "s", 1),
    ]
    out = spark.createDataFrame(rows, SCHEMA)
    for name in ("block", "page", "bit0", "row", "_row", "hashes", "text_sha256", "component", "node", "lettered", "sections2"):
        out = out.withColumn(name, F.lit("x"))
    return out


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF) == ""


# ---- 1


@pytest.mark.parametrize("pages", [1, 16384])
def test_exact_dedup(odd, pages):
    got = [tuple(r) for r in exact_dedup.mark_copies(odd, pages).collect()]
    groups = collections.defaultdict(list)
    rows = [(r.doc_id, low(r.text)) for r in odd.collect()]
    for d, t in rows:
        groups[t].append(d)
    want = []
    for d, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = exact_dedup.drop_copies(odd, pages)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({max(x for x in g if x is not None) for g in groups.values()})


def test_one_group_holds_all(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("Same").alias("text"))
    assert [tuple(r)[:3] for r in exact_dedup.mark_copies(rows).distinct().filter("kept").collect()] == [(499, 499, 500)]
    near = near_dedup.near_duplicates(rows).collect()
    assert {r.component_id for r in near} == {0} and sum(r.kept for r in near) == 1


# ---- 2


def test_language_model_is_normalised(docs):
    model = language_id.train(language_id.sample(docs, 20, 500))
    p = np.exp2(-model.cost.reshape(-1, model.letters, len(model.languages)).astype(float))
    assert np.allclose((p * language_id._members(model.letters, model.letters - 2)[0][None, :, None]).sum(1), 1, atol=1e-4)


def test_code_length_by_hand(spark):
    model = language_id.train(spark.createDataFrame([("x", "abab")], "lang string, text string").toPandas(), order=1)
    raw = np.frombuffer(b"aba", np.uint8)
    # start: a with 1/2; after a: b 2/3; after b: a 1/2
    assert language_id.code_lengths(model, raw, np.array([0, 3]))[0, 0] == pytest.approx(-math.log2(1 / 2 * 2 / 3 * 1 / 2))


def test_language_held_out(spark, docs):
    got = queries.QUERIES["op2_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got and np.mean([r.lang_pred == r.lang for r in got]) > 0.9


def test_language_odd(odd, empty, docs):
    model = language_id.train(language_id.sample(docs, 20, 500))
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 11)] == ["und"] * 4 and got[6].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language_id.train(language_id.sample(empty))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0
    kept = language_id.keep_readable(docs, model)
    assert kept.columns == docs.columns and kept.count() > 0.95 * docs.count()


def test_every_language_is_learned(spark, docs):
    """Also the 401st and later ones, each of which writes one letter of its own."""
    letters = [chr(0x4E00 + i) for i in range(403)]
    rows = [(i, letters[i // 2] * 9, f"l{i // 2:03}") for i in range(2 * 403 - 1)]  # the last language has one document
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(language_id.sample(table), order=2)
    assert [r.lang_pred for r in language_id.predict(table, model).orderBy("doc_id").collect()] == [r[2] for r in rows]
    # how languages are dealt over models changes no code length
    some = language_id.sample(docs, 20, 500)
    one, dealt = language_id.train(some), language_id.train(some, block=1)
    assert len(dealt.rest) == len(one.languages) - 1
    a, b = ({r.doc_id: r for r in language_id.predict(docs, m).collect()} for m in (one, dealt))
    assert all(a[i].lang_pred == b[i].lang_pred and a[i].bits_per_byte == pytest.approx(b[i].bits_per_byte, rel=1e-5) for i in a)


# ---- 3


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    learn, judge = labels.filter("doc_id % 3 != 0"), labels.filter("doc_id % 3 = 0")
    chain = toxicity.train(docs, learn, ("low_quality", "toxic"))
    assert len(chain.links[1].earlier) == 1
    rows = toxicity.score(docs, chain).join(judge, "doc_id").collect()
    hit = [r.p_toxic >= 0.5 for r in rows if r.toxic == 1]
    false = [r.p_toxic >= 0.5 for r in rows if r.toxic == 0]
    assert np.mean(hit) > 0.6 and np.mean(false) < 0.02


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (99, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, labels, ("toxic",))).count() == odd.count()
    none = toxicity.score(odd, toxicity.train(odd, labels.limit(0), ("toxic",))).collect()
    assert all(r.p_toxic < 1e-6 for r in none)
    assert toxicity.score(empty, toxicity.train(empty, labels, ("toxic",))).count() == 0


# ---- 4


def brute_katz(texts, train):
    tok = [words(low(t)) + [None] for t in texts]
    uni, bi = collections.Counter(), collections.Counter()
    for t, use in zip(tok, train):
        if use:
            uni.update(t)
            bi.update(zip([0] + t[:-1], t))
    total = sum(uni.values())

    def factors(counts):
        n = collections.Counter(counts.values())
        return katz.discounts([0] + [n[r] for r in range(1, katz.K + 2)])

    fu, fb = factors(uni), factors(bi)
    cut = lambda n, f: n * f[n - 1] if n <= katz.K else n
    left = 1 - sum(cut(n, fu) for n in uni.values()) / total
    scale = 1.0 if left > 1e-12 else total / (total + 1)
    left = left if left > 1e-12 else 1 / (total + 1)
    p1 = {w: cut(n, fu) / total * scale for w, n in uni.items()}
    of, after = collections.Counter(), collections.defaultdict(dict)
    for (h, w), n in bi.items():
        of[h] += n
        if n >= katz.LEAST:
            after[h][w] = n

    def p2(h, w):
        kept = sum(cut(n, fb) for n in after[h].values()) / of[h] if after.get(h) else 0
        s = of[h] / (of[h] + 1) / kept if kept > 1 - 1e-9 else 1.0
        if w in after.get(h, {}):
            return cut(after[h][w], fb) / of[h] * s
        alpha = (1 - kept * s) / (1 - sum(p1[x] for x in after[h])) if after.get(h) else 1.0
        return alpha * p1.get(w, left)

    vocabulary = [*p1, "never seen"]
    return [sum(math.log10(p2(h, w)) for h, w in zip([0] + t[:-1], t)) for t in tok], p2, vocabulary


def test_katz(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    use = [zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in rows]
    want, p2, vocabulary = brute_katz([r.text for r in rows], use)
    for h in (0, "the", "of"):  # probabilities of all words sum to one
        assert sum(p2(h, w) for w in vocabulary) == pytest.approx(1)
    got = {r.doc_id: r for r in queries.QUERIES["op4_katz"](spark, SF).collect()}
    assert all(got[r.doc_id].score == pytest.approx(s, rel=1e-6) for r, s in zip(rows, want))
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


@pytest.mark.parametrize("ranges", [1, 5])
def test_katz_odd(odd, empty, ranges):
    rows = odd.select("doc_id", "text").collect()
    want, _, _ = brute_katz([r.text for r in rows], [True] * len(rows))
    got = katz.score(odd, katz.train(odd, ranges), ranges).collect()
    assert sorted(round(r.score, 2) for r in got) == pytest.approx(sorted(round(s, 2) for s in want), abs=0.02, rel=1e-6)
    assert katz.score(empty, katz.train(odd)).count() == 0
    assert {r.score for r in katz.score(odd, katz.train(empty)).collect()} == {0.0}


def test_katz_keeps_bigrams_seen_once(spark):
    """With no repeated bigram each is worth more than backing off to the same word, and the
    probabilities after a history still sum to one."""
    texts = ["a b c d", "b a d c", "a a e e f g", "h h b b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = [t.split() + [None] for t in texts]
    uni = collections.Counter(w for t in tok for w in t)
    bi = collections.Counter(x for t in tok for x in zip([0] + t[:-1], t))
    of = collections.Counter(h for t in tok for h in [0] + t[:-1])
    assert 1 in bi.values()

    def factors(counts):
        n = collections.Counter(counts.values())
        return [1.0, *katz.discounts([0] + [n[r] for r in range(1, katz.K + 2)]), 1.0]

    fu, fb = factors(uni), factors(bi)
    cut = lambda n, f: n * f[min(n, katz.K + 1)]
    total = sum(uni.values())
    left = 1 - sum(cut(n, fu) for n in uni.values()) / total
    scale, left = (1.0, left) if left > 1e-12 else (total / (total + 1), 1 / (total + 1))
    p1 = {w: cut(n, fu) / total * scale for w, n in uni.items()}

    def p2(h, w):
        after = {x: n for (g, x), n in bi.items() if g == h}
        kept = sum(cut(n, fb) for n in after.values()) / of[h] if after else 0.0
        s = of[h] / (of[h] + 1) / kept if kept > 1 - 1e-9 else 1.0
        if w in after:
            return cut(after[w], fb) / of[h] * s
        return (1 - kept * s) / (1 - sum(p1[x] for x in after)) * p1.get(w, left)

    asked = [*texts, "c a", "x y", "g", ""]
    got = katz.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), katz.train(docs, 3), 2).collect()
    got = {r.doc_id: r.score for r in got}
    for i, text in enumerate(asked):
        t = [w if w in p1 else "?" for w in text.split()] + [None]
        assert got[i] == pytest.approx(sum(math.log10(p2(h, w)) for h, w in zip([0] + t[:-1], t)), rel=1e-5)


# ---- 5


def test_token_spans_agree_with_the_other_library(docs):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    got = collections.defaultdict(dict)
    for r in token_counts.count_tokens(docs, RANKS, PATTERN, "start").collect():
        got[r.doc_id][r.section] = r
    for r in docs.limit(60).collect():
        spans = other.encode(r.text, add_special_tokens=False).offsets
        assert len(spans) == got[r.doc_id][0].doc_tokens
        if r.text.isascii():
            ends = [x.end for _, x in sorted(got[r.doc_id].items())]
            want = collections.Counter(int(np.searchsorted(ends, a, side="right")) for a, _ in spans)
            assert {i: x.n_tokens for i, x in got[r.doc_id].items()} == {i: want[i] for i in range(len(ends))}


def test_boundary_rules():
    first, last = np.array([0, 3, 7]), np.array([3, 7, 8])
    a, b = np.array([0, 4, 9]), np.array([4, 8, 9])
    assert token_counts.allocate(first, last, a[:2], b[:2], "largest")[0].tolist() == [1, 2]
    assert token_counts.allocate(first, last, a[:2], b[:2], "start")[0].tolist() == [2, 1]
    assert token_counts.allocate(first, last, a[:2], b[:2], "start")[1].tolist() == [1, 0]
    tie = token_counts.allocate(np.array([2]), np.array([6]), a[:2], b[:2], "largest")
    assert tie[0].tolist() == [1, 0]
    gap = token_counts.allocate(np.array([4, 6]), np.array([5, 9]), np.array([0, 7]), np.array([4, 9]), "start")
    assert gap[0].tolist() == [0, 0]


def test_token_fields_and_odd(spark, odd, empty):
    rows = spark.createDataFrame([(1, "head", None, "body text"), (2, "", "b", "é")], "k long, a string, b string, c string")
    got = token_counts.count_tokens(token_counts.fields_as_sections(rows, "k", ["a", "b", "c"]), RANKS, PATTERN).collect()
    by = {(r.doc_id, r.name): (r.start, r.end, r.n_tokens) for r in got}
    assert by[1, "b"] == (4, 4, 0) and by[2, "c"][:2] == (1, 2)
    for k in (1, 2):
        assert sum(v[2] for (d, _), v in by.items() if d == k) == next(r.doc_tokens for r in got if r.doc_id == k)
    out = token_counts.count_tokens(odd, RANKS, PATTERN).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in out}[1] == 0 and len(out) == 12
    assert token_counts.count_tokens(empty, RANKS, PATTERN).count() == 0


# ---- 6


def brute_substrings(rows, width):
    source = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            if d is not None:
                k = tuple(w[i : i + width])
                source[k] = min(source.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and source[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("groups", [1, 6])
@pytest.mark.parametrize("width", [2, 13])
def test_substrings(docs, odd, empty, groups, width):
    for table in (odd, docs.limit(80)):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.drop_repeats(table, width, groups).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_substrings(rows, width)))
    assert substrings.drop_repeats(empty).count() == 0


def test_rows_without_id_go_to_all_blocks(spark):
    rows = [(None if i % 3 else i, f"t{i} u{i} v{i}") for i in range(600)]
    dealt = substrings._blocks(spark.createDataFrame(rows, "doc_id long, text string"), 6)
    unnamed = collections.Counter()
    for row in dealt.collect():
        unnamed[row.block] += sum(not (row.named[i // 8] >> (7 - i % 8)) & 1 for i in range(_packed_rows(row)))
    assert sum(unnamed.values()) == 400 and len(unnamed) == 6 and max(unnamed.values()) < 120


def _packed_rows(row):
    return len(substrings.widen(bytes(row.sizes)))


def test_removal_intervals_are_maximal(spark):
    text = " ".join(f"a{i}" for i in range(20))
    rows = spark.createDataFrame([(1, text), (2, "x y " + text + " z")], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.drop_repeats(rows).collect()}
    assert got[1].removed == [] and got[2].removed == [Row(start=2, end=22)] and got[2].kept_text == "x y z"


# ---- 7


SECRETS = [
    'password = "abcdef"', "PassWd:abc", "token=token=abcdef", "api_key: 'x.y/z+w='", "apikey   =   1234567", "AKIA" + "A" * 16,
    "AKIA" + "B" * 15, "xAKIAAKIA" + "C" * 14, "f" * 24, "0" * 23, "secret:" + "0123456789abcdef" * 3, "token:secret:abcdef",
    "é password=ünot secret=abc,def", "ghp_" + "a1B2" * 9, "xoxb-123456789012-abc", "-----BEGIN RSA PRIVATE KEY-----", "token\n= abcdef",
]


def test_secrets(spark, docs, odd, empty):
    texts = SECRETS + ["\n".join(SECRETS), " ".join(SECRETS), "a" * 5000 + SECRETS[0], ("x, " * 700).join(SECRETS)]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra)
    kinds = {"assign": (secrets._ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
    got = collections.defaultdict(list)
    for r in secrets.find_secrets(table).collect():
        got[r.doc_id].append(r)
    found = 0
    for r in table.collect():
        spans = [
            (m.start(), i, f"{k}:{m.start()}:{m.end()}")
            for i, (k, (find, group, least)) in enumerate(kinds.items()) for m in re.finditer(find, r.text or "")
            if len(m.group(group)) >= least
        ]
        base = ",".join(x[2] for x in sorted(spans))
        found += len(spans)
        mine = got[r.doc_id][0]
        assert mine.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(mine.spans.split(","))
        assert mine.n_hex == sum(x[1] == 2 for x in spans)
    assert found > 20 and any("pem" in r[0].spans for r in got.values()) and any("forge" in r[0].spans for r in got.values())
    assert secrets.find_secrets(empty).count() == 0


# ---- 8


def shingles(text, width):
    w = words(low(text))
    return frozenset(zip(*(w[i:] for i in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_near(rows, width):
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 0.8 <= len(x) / len(y) <= 1.25 and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, odd, empty, width):
    for table in (docs, odd.filter("doc_id is not null")):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table, width).collect()}
        assert got == brute_near(rows, width)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(odd.filter("doc_id is null")).collect()[0].kept


def test_a_large_group_of_edited_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for d in range(300):  # each is an edit of the one before, so most pairs are not linked
        base = list(base)
        base[rng.integers(len(base))] = f"new{d}"
        rows.append((d, " ".join(base)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table, 2).collect()}
    assert got == brute_near(rows, 2)


@pytest.mark.parametrize("share", [0.6, 0.75])
def test_documents_that_share_a_common_line(spark, monkeypatch, share):
    """Many short documents are nearly alike through one line; a few of them are linked."""
    rng = np.random.default_rng(8)
    line, rows = " ".join(f"line{i}" for i in range(int(40 * share))), []
    for d in range(1000):
        rest = [f"own{d}x{i}" for i in range(40 - int(40 * share))]
        if d % 50 == 7:  # an edited copy of the document before
            rest = rows[-1][1].split()[int(40 * share):]
            rest[rng.integers(len(rest))] = "edited"
        rows.append((d, f"{line} {' '.join(rest)}"))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    made, write = {}, near_dedup.stored

    def counted(df, name, *args, **kwargs):
        out = write(df, name, *args, **kwargs)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table, 2).collect()}
    assert got == brute_near(rows, 2) and sum(not kept for _, _, kept in got.values()) == 20
    assert made["heavy"] > 0 and made["candidates"] < 16 * 1000


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_linked_sets_share_a_rare_shingle(spark, percent):
    rng = np.random.default_rng(9)
    sets = [set(rng.choice(40, rng.integers(1, 20), replace=False).tolist()) for _ in range(60)]
    sets += [s | {99} for s in sets[:20]] + [{7}, {7}, {1000}]
    rows = [(i, len(s), np.array(sorted(s), np.uint64)) for i, s in enumerate(sets)]
    packed = spark.createDataFrame([(i, bytearray(near_dedup.pack(x))) for i, _, x in rows], "doc_id long, shingles binary")
    sizes = spark.createDataFrame([(i, n) for i, n, _ in rows], "node long, n_shingles long")
    keys = {r.node: r["keys"] for r in near_dedup.rare_shingles(packed, sizes, percent).collect()}
    often = {x: sum(x in s for s in sets) for x in range(1001)}
    for i, s in enumerate(sets):
        order = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        if any(often[x] > 1 for x in order):
            assert keys[i] == [x for x in order if often[x] > 1]
        else:
            assert i not in keys
        for j in range(i):
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                assert set(keys[i]) & set(keys[j])


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 900, dtype=np.uint64)
    for size in (1, 3, 40, 600):
        a, b = np.unique(x[:size]), np.unique(x[size // 5 : size + size // 5])
        s = near_dedup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (s != near_dedup._EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 120)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 120: 120, 150: 120, 200: 120}


# ---- 9


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x, y = (rng.integers(0, 6, rng.integers(2, n)).astype(np.uint64) for n in (15, 30))
        table = np.zeros((len(x) + 1, len(y) + 1))
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                same = 2 if x[i - 1] == y[j - 1] else -1
                table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] - 1, table[i, j - 1] - 1)
        assert decontaminate.align(x, y)[0] == pytest.approx(table.max() / (2 * len(x)))


def test_decontamination(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = bench.collect()
    filler = docs.filter("lang = 'en'").first().text.split()[:80]
    planted = []
    for i, item in enumerate(items[:20]):
        w = item.text.split()
        edited = [x for j, x in enumerate(w) if j % 9 != 4]
        edited[::6] = ["changed"] * len(edited[::6])
        planted += [(90_000 + 2 * i, " ".join([*filler, *w, *filler]).upper()), (90_001 + 2 * i, " ".join([*filler, *edited, *filler]))]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string")).union(odd.select("doc_id", "text"))
    hits = decontaminate.find_leaks(table, bench).collect()
    found = {r.doc_id for r in hits}
    assert {d for d, _ in planted} <= found
    loose = lambda t: " ".join(re.findall(r"[^\W_]+", low(t)))
    texts = [loose(i.text) for i in items]
    exact = {r.doc_id for r in docs.collect() if any(t in loose(r.text) for t in texts)}
    assert exact <= found and len(found - exact - {d for d, _ in planted}) <= 2
    kept = decontaminate.drop_contaminated(table, bench)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in table.collect()} - found
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    odd_items = spark.createDataFrame([(1, None), (None, "a b c"), (2, ""), (3, "one two")], "item_id long, text string")
    assert decontaminate.find_leaks(odd, odd_items).count() == 0


def test_copies_with_edits_in_the_rare_words_are_found(spark):
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(50)]
    plain = list(rng.choice(common, 14))
    item = " ".join([f"rare{i}" for i in range(6)] + plain)
    rows = [(i, " ".join(rng.choice(common, 1000))) for i in range(100)]
    rows.append((100, " ".join(["other"] * 6 + plain)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(docs, bench).collect()] == [(100, 7, pytest.approx(0.7))]


# ---- 10


def test_bpe(docs, odd, empty):
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        want = []
        for r in rows:
            ids = np.array(encoding.encode_ordinary(r.text or ""), "<u4")
            want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = [tuple(r)[:4] for r in bpe.digests(table, RANKS, PATTERN).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    texts = {(r.doc_id, (r.text or "").encode()) for r in odd.collect()}
    assert {(r.doc_id, bytes(r.bytes)) for r in bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN).collect()} == texts
    assert bpe.digests(empty, RANKS, PATTERN).count() == 0


def test_bpe_cuts_change_nothing(docs):
    codec = bpe.Codec(bpe.read_ranks(RANKS), PATTERN)
    for r in docs.limit(40).collect():
        for text in (r.text, r.text.replace(" ", "  "), r.text.replace("e", "'s ")):
            parts = [codec.encoding.encode_ordinary(p) for p in bpe.pieces(text, 30)]
            assert sum(parts, []) == codec.encoding.encode_ordinary(text)


# ---- pipeline


def test_pipeline_stages(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = {r.doc_id: r.text for r in now.collect()}
        after = stage(spark, now, SF)
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.collect()}
        assert kept <= rows.keys() and len(kept) == after.count()
        if name == "exact_dedup":
            last = {low(t): d for d, t in sorted(rows.items())}
            assert kept == set(last.values())
        if name == "near_dedup":
            assert kept == {d for d, (_, c, _) in brute_near(sorted(rows.items()), 5).items() if c == d}
        now = spark.createDataFrame(after.collect(), docs.schema)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in now.collect()} and all(r.round_trip for r in out)
    assert all(len(r.ids) == r.n_tokens for r in out)
