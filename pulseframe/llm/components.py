"""Connected components by alternating stars.

Every round is two grouped minima and two joins over the remaining edges; the rounds needed grow
with the logarithm of the graph. Neighbours of a node are never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``a, b``: the least node that can be reached.

    Loops and repeated edges mean nothing. No edges give no rows.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = edges.filter("a != b").select(high, low).distinct()
    now = stored(edges, "edges", files=files_for(edges.count()))
    state = _state(now)
    while True:
        now = stored(_small_star(_large_star(now)), "edges", files=files_for(state[0]))
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def files_for(rows: int) -> int:
    """Files for so many narrow rows."""
    return max(2, -(-rows // 200_000))


def _state(edges: DataFrame) -> tuple:
    """Two equal states are the same edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours are tied to the least of all neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    tied = both.filter("v > u").join(least, "u")
    return tied.select(F.col("v").alias("a"), F.least("m", "u").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
