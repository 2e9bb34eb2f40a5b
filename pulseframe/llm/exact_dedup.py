"""Exact deduplication with a two-pass Bloom filter.

Pass one notes for every position of a blocked filter whether it was hit at least twice. Pass two
looks every row up: a row of which some position was hit once is alone and passes straight
through; only the others are shuffled by digest. False hits cost a little shuffle and change no
result, so the filter has a fixed greatest size and the answer is exact at any size.

Texts are equal when identical after lower-casing A-Z. Null counts as empty. Of equal texts the
row with the largest doc_id stays; rows that repeat that doc_id are one document. A group whose
doc_ids are all missing keeps the missing one. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulseframe.llm.tables import documents, stored
from pulseframe.llm.words import lower, slices, text_buffer

#: bits of a page: what one bitmap of Spark's bitmap functions holds
PAGE_BITS = 32768
#: 16 bits for a row, up to this many pages (4 KB each, 64 MB in all); beyond, more rows shuffle
BITS_PER_ROW, MAX_PAGES = 16, 16384
PROBES = 2


def mark_copies(docs: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    digests = stored(_digested(documents(docs)).select("doc_id", "text_sha256"), "digests")
    looked = _looked_up(digests, _hit_twice(digests, max_pages))
    alone = looked.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    joined = _with_group(looked, looked).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
    return alone.unionByName(joined)


def drop_copies(docs: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """One row of each group, with all its columns; texts that are alone are not shuffled."""
    columns = docs.columns
    whole = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"))
    digests = stored(_digested(documents(docs)).select("doc_id", "text_sha256"), "digests")
    twice = _hit_twice(digests, max_pages)
    looked = _looked_up(_digested(whole), twice)
    alone = looked.filter(~F.col("maybe")).select("_row.*")
    joined = _with_group(looked, _looked_up(digests, twice))
    once = joined.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["text_sha256"])
    return alone.unionByName(once.select("_row.*"))


def _digested(docs: DataFrame) -> DataFrame:
    """All columns but the text, and the digest of the normalised text."""
    others = docs.drop("text").schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, at = text_buffer(part.column("text"))
            data = memoryview(lower(raw))
            found = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:])]
            kept = [part.column(c) for c in others.fieldNames()]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names=[*others.fieldNames(), "text_sha256"])

    return docs.mapInArrow(run, T.StructType([*others.fields, T.StructField("text_sha256", T.StringType())]))


def _probed(digests: DataFrame, pages: int) -> DataFrame:
    number = lambda at, digits: F.conv(F.substring("text_sha256", at, digits), 16, 10)
    # all probes of a row fall on one page, so that one look-up answers it
    return digests.select(
        "*", F.pmod(number(1, 15).cast("long"), F.lit(pages)).cast("int").alias("page"),
        *((number(17 + 4 * i, 4).cast("int") % PAGE_BITS).alias(f"bit{i}") for i in range(PROBES)),
    )


def _hit_twice(digests: DataFrame, max_pages: int) -> tuple[int, DataFrame]:
    """Pages, and for each the bits that at least two rows hit: at most ``max_pages`` bitmaps of
    4 KB, which is the bound of what is broadcast."""
    pages = min(max_pages, max(1, -(-digests.count() * BITS_PER_ROW // PAGE_BITS)))
    probes = F.explode(F.array_distinct(F.array(*(F.col(f"bit{i}") for i in range(PROBES)))))
    hits = _probed(digests, pages).select("page", probes.alias("bit")).groupBy("page", "bit").agg(F.count("*").alias("n"))
    twice = hits.filter("n > 1").groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    return pages, stored(twice, "bloom")


def _looked_up(digests: DataFrame, filter_: tuple[int, DataFrame]) -> DataFrame:
    """Every row and whether its text may occur again."""
    pages, twice = filter_
    looked = _probed(digests, pages).join(F.broadcast(twice), "page", "left")
    maybe = F.col("bitmap").isNotNull()
    for i in range(PROBES):
        byte = F.conv(F.hex(F.substring("bitmap", F.expr(f"bit{i} div 8 + 1"), F.lit(1))), 16, 10).cast("int")
        maybe = maybe & (F.getbit(byte, F.col(f"bit{i}") % 8) == 1)
    return looked.select(*digests.columns, maybe.alias("maybe"))


def _with_group(looked: DataFrame, digests: DataFrame) -> DataFrame:
    """Possibly repeated rows with the largest doc_id and the size of their group.

    For the sums one row a digest and task is shuffled; a digest of very many rows is split by
    the adaptive join, since the sums hold one row a digest.
    """
    sums = digests.filter("maybe").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return looked.filter("maybe").drop("maybe").join(sums, "text_sha256")
