"""Quality rules against SQL and brute force."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from pulseframe.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"


def brute(rows, max_docs=Q.MAX_DOCS, min_share=Q.MIN_SHARE):
    """Signals and verdict of (doc_id, text, source) rows."""
    docs_of = collections.defaultdict(set)
    norm = lambda line: line.strip(SPACES).lower()
    lines = [[x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for _, text, _ in rows]
    for n, ((doc, _, host), ls) in enumerate(zip(rows, lines)):
        for line in ls:
            docs_of[host or "", norm(line)].add(doc if doc is not None else ("row", n))
    out = []
    for (doc, text, host), ls in zip(rows, lines):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = collections.Counter(zip(ws, ws[1:], ws[2:]))
        hit = {i + k for i, w in enumerate(zip(ws, ws[1:], ws[2:])) if seen[w] > 1 for k in range(3)}
        chars = sum(len(norm(x)) for x in ls)
        gone = [x for x in ls if len(docs_of[host or "", norm(x)]) > max_docs]
        failed = len(ws) < 50 or 100 * len(hit) > 50 * len(ws)
        kept = not failed and chars - sum(len(norm(x)) for x in gone) >= min_share * chars
        out.append((doc, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)),
                    len(hit), failed, kept, len(gone)))
    return out


ORDER = lambda r: tuple((x is not None, x) for x in r)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=ORDER)


def prose(n, of="w"):
    return " ".join(f"{of}{i}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(None, None, None), (1, "", "s"), (2, " \t\n \x0b\n", "s"), (3, "a b c a b c a b c", "s"), (4, "a a a", "s"), (5, "a a a a", "s")]
    out += [(6, prose(60), "s"), (6, prose(60), "s"), (7, prose(30) + "\n" + prose(30), "s"), (8, "é#ü * $\n\né#ü * $\nx", None)]
    out += [(9, prose(30_000, "v") + " tail", "s"), (10, prose(7, "p") + " " + prose(7, "p") + " " + prose(80, "q"), "t")]
    # a footer on 12 documents of one host and on 10 of another; one short text of nothing else
    out += [(100 + i, prose(60, f"d{i}x") + "\n  Common FOOTER of the host\r", "hot") for i in range(12)]
    out += [(200 + i, prose(60, f"e{i}x") + "\n" + "Common footer of the host", "cold") for i in range(10)]
    out += [(300 + i, prose(55, "same") + "\n" + prose(5, f"own{i}x"), "hot") for i in range(15)]
    out += [(None, prose(55, "unnamed"), "none") for _ in range(11)] + [(400, prose(55, "one"), "one") for _ in range(30)]
    return out


def test_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], SCHEMA).repartition(3)
    for name in ("row", "host", "lines", "hash", "_row"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(Q.apply_rules(docs)) == sorted(brute(rows), key=ORDER)
    assert found(Q.apply_rules(docs, 2, 0.9)) == sorted(brute(rows, 2, 0.9), key=ORDER)


def test_without_sending_common_lines(spark, rows, monkeypatch):
    monkeypatch.setattr(Q, "MAX_SENT", -1)
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], SCHEMA)
    assert found(Q.apply_rules(docs)) == sorted(brute(rows), key=ORDER)


def test_lines_go(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], SCHEMA).withColumn("row", F.lit("x"))
    out = Q.remove_lines(docs)
    assert out.columns == docs.columns
    text = collections.defaultdict(list)
    for r in out.collect():
        text[r.doc_id].append(r.text)
    kept = collections.Counter(r[0] for r in brute(rows) if r[7])
    assert {k: len(v) for k, v in text.items()} == kept
    assert text[100] == [prose(60, "d0x")] and text[200] == [prose(60, "e0x") + "\nCommon footer of the host"]
    assert 300 not in text and text[6] == [prose(60)] * 2


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.apply_rules(empty).count() == 0 and Q.remove_lines(empty).count() == 0


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = Q._signals(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
