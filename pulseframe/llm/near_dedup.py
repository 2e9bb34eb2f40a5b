"""Near-duplicate documents by fast similarity sketching.

A sketch has ``BINS`` places. In each round every shingle of a document is hashed to a bin and a
value, and a bin keeps its least value of the earliest round; after ``BINS`` rounds each further
round serves one bin only, so every bin is filled whatever the size of the set. Equal places of
two sketches are as frequent as the sets are similar, and concentrate around it. Bands of places
give the candidates; a pair of similarity 0.8 shares no band with a probability of 3 in a million.

Links are confirmed on the full sets. Documents of equal sets are one node. In a band all members
are compared with the least of them first, which also tells how far each is from it. What this
leaves in different components is compared with ever larger shares of the band, until the band is
one component or every pair of different components was compared or ruled out: by their sizes, by
the triangle inequality of the Jaccard distance, or by sketches that agree far too seldom. Where
the pairs of a band would outgrow its rows, its members meet by their rarest shingles instead, once
and for all: with any one order of shingles, the first that two linked sets share is among the first
``n - ceil(0.8 n) + 1`` of both, and in the order of frequency a common line comes last. What comes
before it is not shared, so its place bounds the size of the other set: a member with many shingles
of its own meets none through those that all have, and an edited copy that is too far from all others
is no pair with each of them.
So the work on a large group of copies follows its size, no pair within
a component is made for nothing, and no candidate is dropped.

A document of fewer words than a shingle has its whole sequence as its one shingle. Null or
wordless texts have no shingles and link with nothing. Rows of one doc_id are one document; rows
without doc_id link with nothing and are kept. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.components import components, files_for
from pulseframe.llm.tables import documents, release, stored
from pulseframe.llm.words import U, Words, lower, mix, pack, range_hash, slices, text_buffer, unpack

#: long bands keep documents apart that only share a passage, and so many of them miss no link
BAND_ROWS, BANDS = 7, 54
BINS = BAND_ROWS * BANDS
#: a link needs 100 * shared >= PERCENT * joint shingles
PERCENT = 80
#: pairs that a band may make for each of its rows before rare shingles choose among them
PAIRS_A_ROW = 16
#: places of which one bit is sent along with rare shingles
SIGNS = 256
#: sizes of sets that meet at a rare shingle, larger by this factor from class to class
SIZE_STEP = 1.1
_EMPTY = U(2**64 - 1)


def shingle_sets(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end; and where each set begins."""
    raw, offsets = text_buffer(part.column("text"))
    words = Words(lower(raw), offsets)
    n = np.diff(words.first)
    at = np.arange(len(words))
    last = np.repeat(words.first[1:], n)
    begin = at[at + width <= last]
    short = words.first[:-1][(n > 0) & (n < width)]
    begin = np.sort(np.concatenate([begin, short]))
    end = np.minimum(begin + width, last[begin])
    hashes = mix(range_hash(words.hash, begin, end, 0x2545F4914F6CDD1D) + (end - begin).astype(U))
    cut = np.searchsorted(begin, words.first)
    sets = [np.unique(hashes[a:b]) for a, b in zip(cut, cut[1:])]
    return np.concatenate(sets) if sets else hashes, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sketches(x: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches of sets, one row a set; an empty set keeps empty places."""
    n, size = len(first) - 1, np.diff(first)
    out = np.full(n * bins, _EMPTY, U)
    owner = np.repeat(np.arange(n), size)
    todo = size > 0
    for turn in range(2 * bins):
        if not todo.any():
            break
        if not todo.all():
            keep = todo[owner]
            x, owner = x[keep], owner[keep]
        h = mix(x ^ U((turn * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)))
        value = (U(turn) << U(40)) | (h >> U(24))
        if turn < bins:
            np.minimum.at(out, owner * bins + ((h & U(0xFFFFFF)) % U(bins)).astype(np.int64), value)
        else:
            np.minimum.at(out, owner * bins + (turn - bins), value)
        left = (out.reshape(n, bins) == _EMPTY).any(axis=1)
        todo = todo & left
    return out.reshape(n, bins)


def bands_of(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One hash a band."""
    places = sketch.reshape(len(sketch), -1, rows)
    out = np.broadcast_to(np.arange(places.shape[1], dtype=U) + U(1), places.shape[:2]).copy()
    for i in range(rows):
        out = mix(out * U(0x9E3779B97F4A7C15) ^ places[:, :, i])
    return out


SKETCHED = "doc_id long, n_shingles long, set1 long, set2 long, places binary, bands array<long>"


def _sketcher(width: int) -> Callable:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("places", pa.binary()),
        ("bands", pa.list_(pa.int64())),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x, first = shingle_sets(part, width)
            size = np.diff(first)
            sketch = sketches(x, first)
            bands = bands_of(sketch).view(np.int64).ravel()
            places = (sketch & U(0xFF)).astype(np.uint8)  # a byte of each place tells most of them apart
            sums = []
            for salt in (0x51ED2701A3C5, 0x7F4A7C159E37):
                total = np.zeros(len(x) + 1, U)
                np.cumsum(mix(x ^ U(salt)), out=total[1:])
                sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            ends = pa.array(np.arange(len(size) + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(sums[0]), pa.array(sums[1]),
                pa.array([row.tobytes() for row in places], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(bands)),
            ], schema=schema)

    return run


def _set_maker(width: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x, first = shingle_sets(part, width)
            packed = [pack(x[a:b]) for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(packed, pa.binary())], schema=schema)

    return run


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of a set, a set at a time."""
    for batch in batches:
        for node, packed in zip(batch.column("doc_id").to_pylist(), batch.column("shingles").to_pylist()):
            x = unpack(packed)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node, np.int64)), pa.array(x.view(np.int64))], names=["node", "shingle"])


def rare_shingles(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``node, keys, own``: those of the rarest shingles of each set, rarest first, that others have
    too, and how many it has alone.

    Frequencies are those among the given sets. The first shingle in this order that two sets
    share is a key of both if 100 * shared >= percent * joint: of ``n`` shingles at least
    ``ceil(percent n / 100)`` are shared, so it is not further back than the rest and one more. Shingles
    of one set only come before all others, and are no keys.
    """
    rows = sets.mapInArrow(_unpacked, "node long, shingle long")
    often = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    common = rows.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("ordered"))
    own = F.col("n_shingles") - F.size("ordered")
    length = F.col("n_shingles") - F.ceil(F.lit(percent) * F.col("n_shingles") / 100) + 1 - own
    keys = F.slice("ordered", 1, F.greatest(length, F.lit(0)).cast("int")).getField("shingle")
    return common.join(sizes, "node").select("node", keys.alias("keys"), own.alias("own")).filter("size(keys) > 0")


def _signs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit of each of the first places: those of unequal places agree half the time."""
    for batch in batches:
        places = np.frombuffer(b"".join(batch.column("places").to_pylist()), np.uint8).reshape(-1, BINS)
        bits = np.packbits(places[:, :SIGNS] & 1, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(np.ascontiguousarray(x)) for x in bits.T)],
                                         names=["node", *(f"sign{i}" for i in range(SIGNS // 64))])


def signs_apart(percent: int) -> int:
    """So many signs of linked sets differ at most, but for one in ten millions."""
    p, total = (1 - percent / 100) / 2, 0.0
    for k in range(SIGNS, 0, -1):
        total += math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
        if total > 1e-7:
            return k
    return 0


def rare_pairs(keyed: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of different components that share a rare shingle and may be linked, one of them
    ``minor``; of ``node, n_shingles, component, minor, keys, own`` and signs, one row a set.

    What is shared from a key on is no more than what either set has left, if it is the first that
    they share. So a key far back in a set leads to smaller sets only, and to none at last: rows are
    sent to the classes of sizes that are possible, and a hot key is met by few.
    """
    signs = [f"sign{i}" for i in range(SIGNS // 64)]
    rows = keyed.select("node", "n_shingles", "component", "minor", "own", *signs, F.posexplode("keys").alias("i", "key"))
    rows = rows.withColumn("left", F.col("n_shingles") - F.col("own") - F.col("i")).drop("own", "i")
    n = F.col("n_shingles")
    least = F.ceil(F.lit(percent) * n / 100)
    most = F.floor(F.least(F.lit(100) * n / percent, F.lit(100 + percent) * F.col("left") / percent - n))
    size_class = lambda x: F.floor(F.log(x) / math.log(SIZE_STEP)).cast("int")
    rows = rows.withColumn("least", least).withColumn("most", most).filter("least <= most")
    carried = ("node", "n_shingles", "component", "minor", "left", *signs)
    side = lambda rows, at, name: rows.select("key", at.alias("class"), *(F.col(c).alias(f"{c}_{name}") for c in carried))
    left = side(rows.filter("minor"), F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))), "a")
    right = side(rows, size_class(n), "b")
    sizes = F.col("n_shingles_a") + F.col("n_shingles_b")
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in signs), F.lit(0))
    possible = (
        (F.col("component_a") != F.col("component_b")) & (~F.col("minor_b") | (F.col("node_a") < F.col("node_b")))
        & (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
        & ((100 + percent) * F.least("left_a", "left_b") >= percent * sizes) & (apart <= signs_apart(percent))
    )
    pairs = left.join(right, ["key", "class"]).filter(possible)
    return pairs.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))


def _alike(percent: int) -> Callable:
    """Pairs whose sketches agree nearly as often as linked sets do: five deviations below, which a
    linked pair misses once in millions. It spares the full sets of the others a shuffle."""
    share = percent / 100
    least = BINS * share - 5 * np.sqrt(BINS * share * (1 - share))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("places_a", "places_b")]
            keep = (places[0] == places[1]).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    return run


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity of the full sets of each pair, as shared and joint shingles."""
    for batch in batches:
        shared, joint = [], []
        for left, right in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
            both = np.concatenate([unpack(left), unpack(right)])
            both.sort()
            shared.append(int((both[1:] == both[:-1]).sum()))
            joint.append(len(both) - shared[-1])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(joint, pa.int64())],
                                         names=["a", "b", "shared", "joint"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    docs = documents(docs)
    sketched = stored(docs.mapInArrow(_sketcher(width), SKETCHED), "sketches")
    linkable = sketched.filter("n_shingles > 0 and doc_id is not null")
    same = ["set1", "set2", "n_shingles"]
    classes = stored(linkable.groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    labels = _linked(docs, linkable, classes, width, percent)
    # one row a set: the only skewed side is that of the documents, which the adaptive join splits
    named = classes.join(labels, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    joined = linkable.select("doc_id", *same).join(named, same).select("doc_id", "n_shingles", "component_id")
    alone = sketched.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(docs: DataFrame, linkable: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, component`` of all nodes that have a link."""
    spark, most = docs.sparkSession, 1 - percent / 100 + 1e-9
    nodes = linkable.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    nodes = nodes.select(F.col("doc_id").alias("node"), "n_shingles", "places", "bands")
    rows = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    crowded = stored(rows.join(shared, "band"), "bands")
    files = 2 * files_for(crowded.count())  # for all that is made of these rows
    wanted = crowded.select("node").distinct()
    nodes = stored(nodes.join(wanted, "node", "left_semi"), "nodes", files=files)
    sets = docs.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = stored(sets.mapInArrow(_set_maker(width), "doc_id long, shingles binary"), "sets")
    release(spark)

    def compared(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
        return stored(both.mapInArrow(_compared, "a long, b long, shared long, joint long"), "compared", files=3 * files)

    def alike(pairs: DataFrame) -> DataFrame:
        a = nodes.select(F.col("node").alias("a"), F.col("places").alias("places_a"))
        b = nodes.select(F.col("node").alias("b"), F.col("places").alias("places_b"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "places_a", "places_b")
        return stored(both.mapInArrow(_alike(percent), "a long, b long"), "candidates", files=files)

    linked = F.expr(f"100 * shared >= {percent} * joint")
    smaller = lambda x, y: F.least(x, y) / F.greatest(x, y)
    size = crowded.filter("node = pivot").select("band", F.col("n_shingles").alias("pivot_size"))
    sized = stored(crowded.join(size, "band"), "sized", files=files)
    near_size = 100 * F.least("n_shingles", "pivot_size") >= percent * F.greatest("n_shingles", "pivot_size")
    star = compared(sized.filter("node != pivot").filter(near_size).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    labels = stored(components(star.filter(linked).select("a", "b")), "labels", files=files)
    release(spark)
    # how far each member is from the pivot of its band, or between which bounds
    far = star.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("shared") / F.col("joint")).alias("distance"))
    exact = F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("distance"))
    members = sized.filter("members > 2").join(far, ["node", "pivot"], "left").select(
        "band", "node", "n_shingles", "members",
        F.coalesce(exact, 1 - smaller(F.col("n_shingles"), F.col("pivot_size"))).alias("least"), F.coalesce(exact, F.lit(1.0)).alias("most"),
    )
    members = stored(members, "members", files=files)
    share, before = 4, 2
    while True:
        rest = members.filter(F.col("members") > before).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        some = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / share)) == 0
        counts = rest.groupBy("band", "component").agg(F.count("*").alias("n"), F.count_if(some).alias("m"))
        # the largest component of a band needs no member of its own: the others come to it
        mixed = counts.groupBy("band").agg(
            F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("largest"),
            (F.sum("n") - F.max("n")).alias("n"), F.sum("m").alias("m"))
        crowd = F.col("n") * F.col("m") > PAIRS_A_ROW * (F.col("n") + F.col("m"))
        mixed = stored(mixed.filter("parts > 1").select("band", "largest", crowd.alias("crowd")), "mixed", files=files)
        if mixed.isEmpty():
            return labels
        placed = rest.join(mixed, "band").withColumn("minor", F.col("component") != F.col("largest"))
        columns = ("node", "n_shingles", "component", "least", "most", "bands")
        found = placed.filter(~F.col("crowd") & (F.col("minor") | some)).select("band", *columns[:-1], "minor", some.alias("some"))
        found = stored(found.join(nodes.select("node", "bands"), "node"), "open", files=files)

        # by the triangle inequality linked documents are about as far from the pivot; and a pair
        # is made in the first band that both have, in no other
        possible = (
            (F.col("component_a") != F.col("component_b")) & (100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
            & (F.col("least_a") - F.col("most_b") <= most) & (F.col("least_b") - F.col("most_a") <= most)
            & (F.element_at(F.array_intersect("bands_a", "bands_b"), 1) == F.col("band"))
        )
        left, right = (found.filter(flag).select("band", *(F.col(c).alias(f"{c}_{side}") for c in columns)) for flag, side in (("minor", "a"), ("some", "b")))
        pairs = left.join(right, "band").filter(possible).select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))
        heavy = stored(mixed.filter("crowd").select("band"), "heavy", files=1)
        if not heavy.isEmpty():
            among = placed.filter("crowd").groupBy("node", "n_shingles", "component").agg(F.max("minor").alias("minor"))
            among = stored(among, "many", files=files)
            keys = rare_shingles(sets.join(among.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), among.select("node", "n_shingles"), percent)
            signs = nodes.select("node", "places").mapInArrow(_signs, "node long, " + ", ".join(f"sign{i} long" for i in range(SIGNS // 64)))
            keyed = stored(keys.join(among, "node").join(signs, "node"), "keys", files=files)
            pairs = pairs.unionAll(rare_pairs(keyed, percent))
            members = members.join(heavy, "band", "left_anti")
        near = alike(pairs.distinct())
        if not near.isEmpty():
            fresh = compared(near).filter(linked)
            if not fresh.isEmpty():
                known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
                labels = stored(components(fresh.select("a", "b").unionByName(known)), "labels", files=files)
        release(spark)
        share, before = share * 64, share


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """Of each component the document with the least doc_id, all columns as they are."""
    gone = near_duplicates(docs, width, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
