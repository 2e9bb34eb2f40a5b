"""How the sources of a language differ: shares of its frequent terms, recounted by perfect hashes.

The first pass counts for every term the documents of its language that hold it and keeps those in
enough documents, exactly. Kept terms are dealt into shards by hash, and each shard gets a minimal
perfect hash with its keys stored. The shards are sent to all tasks, and the second pass adds up the
terms of each (lang, source) group in dense slots. Shards beyond the bound of what is sent go in
further rounds of the second pass, each over all documents.

Terms are runs of letters and non-ASCII characters, lower-cased in A-Z only. Null text, lang and
source are empty strings. Every row is a document. Groups without terms are groups, and a language
without kept terms has pairs of value 0. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseframe.llm import perfect_hash as P
from pulseframe.llm.tables import stored
from pulseframe.llm.words import Words, lower, narrow, pack, slices, text_buffer, unpack, widen

MIN_DOCS, ALPHA, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: terms of a shard, bytes of shards sent to the tasks at once, slots that a task holds
SHARD_TERMS, SENT_BYTES, HELD_SLOTS = 32_768, 48 << 20, 4 << 20
#: text bytes worked on at once
SLICE = 16 << 20
#: groups of a language that are compared in one task, partial sums of one group merged first
BLOCK, SALTS = 64, 16
_IS_BREAK = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_COUNTED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])
_SHARDED = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("terms", pa.list_(pa.string()))])
_SHARD = "lang string, shard int, shards int, n_terms int, salt int, displacement binary, terms array<string>, size long"
_SUMS = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()),
])
_SUMS_SQL = "lang string, source string, shard int, slots binary, counts binary, total long"
_KEY = ("lang", "source", "shard")


def _terms(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text of each term of a slice, its number among the distinct terms, and these."""
    raw, offsets = text_buffer(part.column("text"))
    raw = lower(raw)
    words = Words(raw, offsets, hashed=False, breaks=_IS_BREAK)
    at = np.concatenate([[0], np.cumsum(words.end - words.start)])
    letters = raw[~_IS_BREAK[raw]]
    found = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(at), pa.py_buffer(letters)).dictionary_encode()
    return words.text, np.asarray(found.indices), found.dictionary.cast(pa.string())


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    found = column.dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), found.dictionary.to_pylist()


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a slice that hold a term, by language."""
    for part in slices(batches, SLICE):
        text, term, names = _terms(part)
        if not len(names):
            continue
        lang, langs = _codes(part.column("lang"))
        once = np.unique(text * len(names) + term)
        key, n = np.unique(lang[once // len(names)] * len(names) + once % len(names), return_counts=True)
        lang_of = pa.array(langs).take(pa.array(key // len(names)))
        yield pa.RecordBatch.from_arrays([lang_of, names.take(pa.array(key % len(names))), pa.array(n, pa.int64())], schema=_COUNTED)


def frequent_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term`` of the terms in at least ``min_docs`` documents of the language."""
    counts = docs.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, n long")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).drop("n")


def _dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard = P.hashes(batch.column("term")) % np.asarray(batch.column("shards")).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32))], names=[*batch.schema.names, "shard"])


def _built(table: pa.Table) -> pa.Table:
    salt, displacement, terms = P.build(table.column("term").combine_chunks())
    size = 4 * len(displacement) + terms.nbytes
    row = {"lang": table["lang"][0].as_py(), "shard": table["shard"][0].as_py(), "shards": table["shards"][0].as_py(), "n_terms": len(terms),
           "salt": salt, "displacement": displacement.tobytes(), "terms": terms.to_pylist(), "size": size}
    return pa.Table.from_pylist([row], schema=_SHARD_ARROW)


_SHARD_ARROW = pa.schema([
    ("lang", pa.string()), ("shard", pa.int32()), ("shards", pa.int32()), ("n_terms", pa.int32()), ("salt", pa.int32()),
    ("displacement", pa.binary()), ("terms", pa.list_(pa.string())), ("size", pa.int64()),
])


def shards_of(kept: DataFrame, terms: int = SHARD_TERMS) -> DataFrame:
    """One row a shard of a language: its perfect hash, and its terms in the order of their slots."""
    many = kept.groupBy("lang").agg(F.ceil(F.count("*") / terms).cast("int").alias("shards"))
    dealt = kept.join(many, "lang").mapInArrow(_dealt, "lang string, term string, shards int, shard int")
    return dealt.groupBy("lang", "shard").applyInArrow(_built, _SHARD)


def _rounds(shards: DataFrame, most: int) -> list[list[tuple[str, int]]]:
    """Shards that are sent together, by their sizes (one small row a shard)."""
    out, size = [], most + 1
    for lang, shard, n in sorted(shards.select("lang", "shard", "size").collect()):
        if size + n > most:
            out.append([])
            size = 0
        out[-1].append((lang, shard))
        size += n
    return out


class _Sent:
    """Perfect hashes of some shards, as a task uses them."""

    def __init__(self, data: bytes):
        self.shards: dict[str, tuple[int, dict]] = {}
        for row in pa.ipc.open_stream(data).read_all().to_pylist():
            _, mine = self.shards.setdefault(row["lang"], (row["shards"], {}))
            mine[row["shard"]] = (row["salt"], np.frombuffer(row["displacement"], np.int32), pa.array(row["terms"], pa.string()))

    def find(self, lang: str, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of each term, -1 where it is not kept."""
        shard, slot = np.full(len(terms), -1), np.full(len(terms), -1)
        if lang not in self.shards or not len(terms):
            return shard, slot
        many, mine = self.shards[lang]
        h = P.hashes(terms)
        of = (h % np.uint64(many)).astype(np.int64)
        for number, (salt, displacement, keys) in mine.items():
            at = np.flatnonzero(of == number)
            if len(at):
                some = terms.take(pa.array(at))
                shard[at], slot[at] = number, P.find(some, P.hashes(some, salt) if salt else h[at], displacement, keys)
        return shard, slot


def _recount(sent):
    """Terms of each group, added up in dense slots of the group and shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, dense, held = _Sent(sent.value), {}, 0
        for part in slices(batches, SLICE):
            text, term, names = _terms(part)
            lang, langs = _codes(part.column("lang"))
            source, sources = _codes(part.column("source"))
            for k, name in enumerate(langs):
                mine = lang[text] == k
                used = np.unique(term[mine])
                shard, slot = known.find(name, names.take(pa.array(used)))
                at = np.searchsorted(used, term[mine])
                ok = slot[at] >= 0
                width = int(slot.max(initial=0)) + 1
                key = (source[text[mine][ok]] * (int(shard.max(initial=0)) + 1) + shard[at][ok]) * width + slot[at][ok]
                key, n = np.unique(key, return_counts=True)
                first = np.flatnonzero(np.diff(key // width, prepend=-1))
                for a, b in zip(first, [*first[1:], len(key)]):
                    src, sh = divmod(int(key[a]) // width, int(shard.max(initial=0)) + 1)
                    group = (name, sources[src], sh)
                    if group not in dense:
                        dense[group] = np.zeros(len(known.shards[name][1][sh][2]), np.int64)
                        held += len(dense[group])
                    dense[group][key[a:b] % width] += n[a:b]
                if held > HELD_SLOTS:
                    yield _sums(dense)
                    dense, held = {}, 0
        if dense:
            yield _sums(dense)

    return run


def _sums(dense: dict) -> pa.RecordBatch:
    rows = []
    for (lang, source, shard), counts in dense.items():
        hit = np.flatnonzero(counts)
        rows.append((lang, source, shard, pack(hit), narrow(counts[hit]), int(counts.sum())))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMS)], schema=_SUMS)


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of a group and shard, which follow each other; one is held at a time."""
    key, dense = None, np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            if key is not None and key != tuple(row[c] for c in _KEY):
                yield _sums({key: dense})
                dense = np.zeros(0, np.int64)
            key = tuple(row[c] for c in _KEY)
            slots = unpack(row["slots"]).astype(np.int64)
            if len(slots) and slots[-1] >= len(dense):
                dense = np.pad(dense, (0, int(slots[-1]) + 1 - len(dense)))
            dense[slots] += widen(row["counts"]).astype(np.int64)
    if key is not None:
        yield _sums({key: dense})


def _merge(sums: DataFrame) -> DataFrame:
    """One row a group and shard; what many tasks have of one group is added up in two steps."""
    salted = sums.withColumn("salt", F.spark_partition_id() % SALTS).repartition("salt", *_KEY).sortWithinPartitions("salt", *_KEY)
    once = salted.drop("salt").mapInArrow(_merged, _SUMS_SQL)
    return once.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_merged, _SUMS_SQL)


def recount(docs: DataFrame, shards: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """Counts of the kept terms of every group, packed by shard; groups without any have no row."""
    spark, out = docs.sparkSession, None
    for group in _rounds(shards, most):
        names = spark.createDataFrame(group, "lang string, shard int")
        table = shards.select("lang", "shard", "shards", "salt", "displacement", "terms").join(F.broadcast(names), ["lang", "shard"]).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        part = stored(_merge(docs.select("lang", "source", "text").mapInArrow(_recount(sent), _SUMS_SQL)), "recount")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _SUMS_SQL) if out is None else out


def _share(counts: np.ndarray, n: int, v: int, alpha: int, scale: int) -> np.ndarray:
    """Smoothed shares in whole numbers; in Python's numbers where 64 bits do not hold them."""
    wide = len(counts) and int(counts.max()) > (1 << 62) // scale - alpha
    return 1 + scale * ((counts.astype(object) if wide else counts) + alpha) // (n + alpha * v)


def _dense(row: dict, n_terms: int) -> np.ndarray:
    out = np.zeros(n_terms, np.int64)
    if row["slots"] is not None:
        out[unpack(row["slots"]).astype(np.int64)] = widen(row["counts"]).astype(np.int64)
    return out


def _distances(alpha: int, scale: int):
    """Sums over a shard of the differences of each two groups of one or two blocks."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["place"] // BLOCK, r["place"]))
        first, second = rows[0]["low"], rows[0]["high"]
        p = [_share(_dense(r, r["n_terms"]), r["n"], r["v"], alpha, scale) for r in rows]
        left = [i for i, r in enumerate(rows) if r["place"] // BLOCK == first]
        out = {"lang": [], "a": [], "b": [], "value": []}
        for i in left:
            for j in range(i + 1, len(rows)) if first == second else range(len(left), len(rows)):
                for c, x in zip(out, (rows[i]["lang"], rows[i]["source"], rows[j]["source"], int(np.abs(p[i] - p[j]).sum()))):
                    out[c].append(x)
        return pa.table(out, schema=pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())]))

    return run


def _pairs(groups: DataFrame, shards: DataFrame, counts: DataFrame, alpha: int, scale: int) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language."""
    # an empty shard of every language, so that pairs without terms are there
    every = groups.select("lang", F.lit(-1).alias("shard"), F.lit(0).alias("n_terms")).distinct()
    vectors = groups.join(every.unionByName(shards.select("lang", "shard", "n_terms")), "lang").join(counts.drop("total"), list(_KEY), "left")
    blocks = vectors.withColumn("other", F.explode(F.sequence(F.lit(0), F.expr(f"(n_groups - 1) div {BLOCK}").cast("int"))))
    mine = F.expr(f"place div {BLOCK}").cast("int")
    met = blocks.withColumn("low", F.least(mine, "other")).withColumn("high", F.greatest(mine, "other"))
    parts = met.groupBy("lang", "shard", "low", "high").applyInArrow(_distances(alpha, scale), "lang string, a string, b string, value long")
    once = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return once.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")


def _typical(alpha: int, scale: int, top: int):
    """The terms that a group has more often than its language, the most of each shard.

    Rows of a shard follow each other: first its terms, then the counts of the language, then
    those of the groups; one is held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = whole = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    terms = np.array([t.encode() for t in row["terms"]], object)
                    continue
                share = _share(_dense(row, len(terms)), row["n"], row["v"], alpha, scale)
                if row["kind"] == 1:
                    whole = share
                    continue
                slots = unpack(row["slots"]).astype(np.int64)
                more = (share - whole)[slots]
                slots, more = slots[more > 0], more[more > 0]
                if len(more) > top:  # all that tie with the last stay for the sort by name
                    least = np.sort(more)[-top]
                    slots, more = slots[more >= least], more[more >= least]
                best = sorted(zip((-more).tolist(), terms[slots]))[:top]
                yield pa.RecordBatch.from_pylist(
                    [{"lang": row["lang"], "source": row["source"], "item": t.decode(), "value": -x} for x, t in best], schema=_FOUND)

    return run


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _typical_terms(groups: DataFrame, shards: DataFrame, counts: DataFrame, alpha: int, scale: int, top: int) -> DataFrame:
    languages = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.first("v").alias("v"))
    whole = _merge(counts.withColumn("source", F.lit(""))).join(languages, "lang")
    mine = counts.join(groups.select("lang", "source", "n", "v"), ["lang", "source"])
    columns = ("lang", "shard", "kind", "source", "slots", "counts", "n", "v", "terms")
    none = F.lit(None).cast("array<string>").alias("terms")
    rows = [df.withColumn("kind", F.lit(kind)).select(*columns[:-1], none) for kind, df in ((1, whole), (2, mine))]
    empty = {c: F.lit(None).cast(t) for c, t in (("source", "string"), ("slots", "binary"), ("counts", "binary"), ("n", "long"), ("v", "long"))}
    keys = shards.withColumns({"kind": F.lit(0), **empty}).select(*columns)
    ordered = keys.unionByName(rows[0]).unionByName(rows[1]).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "kind")
    return ordered.mapInArrow(_typical(alpha, scale, top), "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, alpha: int = ALPHA, scale: int = SCALE, top: int = TOP,
          shard_terms: int = SHARD_TERMS, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every group the other sources of its language
    by the summed difference of their shares (``pair``), and the ``top`` terms whose share is above
    the language's (``term``)."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    docs = docs.select(empty("lang"), empty("source"), empty("text"))
    shards = stored(shards_of(frequent_terms(docs, min_docs), shard_terms), "shards")
    counts = recount(docs, shards, sent_bytes)
    sizes = shards.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("n"))
    found = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v"])
    by_lang = Window.partitionBy("lang")
    placed = found.withColumn("place", F.row_number().over(by_lang.orderBy("source")) - 1).withColumn("n_groups", F.count("*").over(by_lang))
    groups = stored(placed, "groups")  # one row a source of a language
    pairs = _pairs(groups, shards, counts, alpha, scale).withColumn("part", F.lit("pair"))
    terms = _typical_terms(groups, shards, counts, alpha, scale, top).withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, terms)]
    both = ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
    return both.select("lang", "source", "part", "item", "value", "rank")
