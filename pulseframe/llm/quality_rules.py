"""Quality rules: signals of one text, and lines that a host repeats over its documents.

Everything is DataFrame and SQL functions. A host is the ``source``; documents without one are a
host of their own. A line is what stands between line feeds; normalised, it has white
space at neither end and is in lower case; lines without a word do not count. A
line in more than ``max_docs`` distinct documents of a host is common there and is removed (all
its occurrences, the first too). A document is kept if it passes the base rules and if at least
``min_share`` of the characters of its normalised lines stays.

Lines and three-word windows are compared by 64-bit hashes. Null text is an empty one and fails
the base rules. Rows with one doc_id are one document when documents are counted, and one row each
in the result; rows without doc_id are a document each. No rows give no rows; extra columns are
ignored by :func:`apply_rules` and kept by :func:`remove_lines`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.llm.tables import stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: a line in more distinct documents of a host is common there
MAX_DOCS = 10
#: share of the line characters that must stay
MIN_SHARE = 0.5
#: common lines that are sent to all tasks (8 bytes of hash and a host name each); more are joined by shuffle
MAX_SENT = 500_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: an optimiser may copy a plain column
    expression into every place, and so into every step of a lambda, that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    for space in "\t\n\x0b\f\r":  # splitting at one plain character needs no regular expression
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def repeated_words(ws: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that occur at least twice. Where hashes repeat, windows
    are sorted by hash, so that equal ones meet, and the places of those that met are sorted again."""
    windows = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, width)))),
                      1, F.greatest(F.size(ws) - (width - 1), F.lit(0)))

    def places(s: Column) -> Column:
        met = lambda x, j: (x["h"] == F.get(s, j + 1)["h"]) | (x["h"] == F.get(s, j - 1)["h"])
        return F.sort_array(F.transform(F.filter(s, met), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
        each = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"))
        return F.aggregate(at, step, each, lambda a: a["n"])

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, _let(ordered, lambda s: _let(places(s), lambda at: covered(at)))).otherwise(0)

    return _let(windows, lambda hashes: count(hashes)).cast("long")


def normalised_line(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\x0b\f\r")))


def _lines(text: Column) -> Column:
    """Hash and size of each line with a word, in order."""
    each = F.transform(F.split(text, "\n"), lambda line: _let(normalised_line(line), lambda n: F.struct(
        F.xxhash64(n).alias("hash"), F.length(n).alias("size"))))
    return F.filter(each, lambda x: x["size"] > 0)


def _signals(docs: DataFrame) -> DataFrame:
    """One row a document row: its number, base signals, and hashes of its lines."""
    text = F.coalesce("text", F.lit(""))
    bare = docs.select("row", "doc_id", F.coalesce("source", F.lit("")).alias("host"), text.alias("text"))
    all_lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(words(F.col("text")), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        repeated_words(ws).alias("n_repeat_words")))
    return bare.select(
        "row", "doc_id", "host", counted.alias("w"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _let(all_lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _lines(F.col("text")).alias("lines"),
    ).select("row", "doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "lines")


def common_lines(signals: DataFrame, max_docs: int) -> DataFrame:
    """Hosts and hashes of the lines in more than ``max_docs`` of the host's documents.

    Rows are counted first, a line once a row, with map-side sums; only lines that pass are
    looked at again, to count their distinct documents.
    """
    once = signals.select("host", "row", "doc_id", F.explode(F.array_distinct("lines.hash")).alias("hash"))
    often = _small(stored(once.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs).drop("n"), "often"))
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row"))
    docs = once.join(often, ["host", "hash"]).groupBy("host", "hash").agg(F.countDistinct(document).alias("n_docs"))
    return stored(docs.filter(F.col("n_docs") > max_docs), "common-lines")


def _small(lines: DataFrame) -> DataFrame:
    """A written table of lines, sent to all tasks only while it is known to be small."""
    return F.broadcast(lines) if lines.count() <= MAX_SENT else lines


def _judged(signals: DataFrame, max_docs: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    common = common_lines(signals, max_docs)
    lines = signals.select("host", "row", F.explode("lines").alias("line")).select("host", "row", "line.hash", "line.size")
    gone = lines.join(_small(common), ["host", "hash"]).groupBy("row").agg(
        F.sum("size").alias("gone_chars"), F.count("*").alias("n_common_lines"))
    size = F.aggregate("lines.size", F.lit(0).cast("long"), lambda a, x: a + x)
    found = signals.withColumn("line_chars", size).drop("lines").join(gone, "row", "left").fillna(0, ["gone_chars", "n_common_lines"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("line_chars") - F.col("gone_chars")) < F.lit(min_share) * F.col("line_chars")
    return common, found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def apply_rules(docs: DataFrame, max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_common_lines`` of every row."""
    signals = stored(_signals(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")), "line-signals")
    _, judged = _judged(signals, max_docs, min_share)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_lines",
    )


def remove_lines(docs: DataFrame, max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents that are kept, with all their columns and without their common lines."""
    columns = docs.columns
    whole = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    rows = stored(whole, "rows")
    numbered = stored(_signals(rows), "line-signals")
    common, judged = _judged(numbered, max_docs, min_share)
    lines = numbered.select("row", "host", F.explode(F.array_distinct("lines.hash")).alias("hash"))
    gone = lines.join(_small(common), ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("gone"))
    kept = rows.select("row", "_row").join(judged.filter("kept").select("row"), "row").join(gone, "row", "left")
    stays = F.filter(F.split("_row.text", "\n"), lambda line: ~F.coalesce(F.array_contains("gone", F.xxhash64(normalised_line(line))), F.lit(False)))
    text = F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(F.array_join(stays, "\n"))
    return kept.select(*(text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in columns))

