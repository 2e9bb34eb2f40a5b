"""Ordered operators over long timelines, cut into time slices.

A plain window partitioned by user puts a user's whole history into one task. One
user may hold a large share of all rows, so every operator here works in two steps:

* rows are grouped by ``(keys, slice)``, a slice being a fixed stretch of time, and
  the ordered work is done inside the slice;
* each slice is reduced to one summary row (with map-side combine), the summaries
  are folded in slice order, and what a slice needs from everything before it (its
  carry) is joined back on ``(keys, slice)``.

Only summaries are ever windowed per key, and their number is bounded by elapsed
time divided by the slice width, not by the number of rows. Rows with equal time
always share a slice, so results do not depend on the width. :func:`fit_width` finds
the width at which no slice of the data at hand is too large for a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE = "_slice"
DAY_S = 86_400
HOUR_S = 3_600


def slice_of(ts: Column, width_s: int) -> Column:
    """Start (in microseconds) of the time slice an instant falls into."""
    micros = F.unix_micros(ts)
    return micros - F.pmod(micros, F.lit(width_s * 1_000_000))


WIDTHS_S = (DAY_S, HOUR_S, 300, 10, 1)


def fit_width(
    df: DataFrame, keys: Sequence[str], ts: str, max_rows: int = 2_000_000, widths_s: Sequence[int] = WIDTHS_S
) -> int:
    """Widest slice, in seconds, whose fullest group stays under ``max_rows``.

    Counts are combined before the shuffle and only their maximum is returned; usually
    the first width fits, so this is one narrow aggregation.
    """
    for width_s in widths_s:
        counts = df.groupBy(*keys, slice_of(F.col(ts), width_s).alias(SLICE)).agg(F.count(F.lit(1)).alias("n"))
        fullest = counts.agg(F.max("n")).first()[0]
        if fullest is None or fullest <= max_rows:
            return width_s
    return widths_s[-1]


def _sliced(df: DataFrame, ts: str, width_s: int) -> DataFrame:
    return df.withColumn(SLICE, slice_of(F.col(ts), width_s))


def _fold(keys: Sequence[str]):
    """Everything before the current slice of the same key."""
    w = Window.partitionBy(*keys).orderBy(SLICE)
    return w, w.rowsBetween(Window.unboundedPreceding, -1)


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    # every slice of rows has exactly one carry row; inner keeps AQE free to split skew
    return rows.join(carry, [*keys, SLICE], "inner")


def previous(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], values: dict[str, str],
    width_s: int = HOUR_S,
) -> DataFrame:
    """Add, per output name, the value a column had in the previous row of the key."""
    rows = _sliced(df, ts, width_s)
    order = F.struct(ts, *tie)
    packed = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    tail = rows.groupBy(*keys, SLICE).agg(F.max_by(packed, order).alias("_tail"))
    w, _ = _fold(keys)
    carry = tail.select(*keys, SLICE, F.lag("_tail").over(w).alias("_carry"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(ts, *tie)
    seen = F.coalesce(F.lag(packed).over(inside), F.col("_carry"))
    return (
        _attach(rows, carry, keys)
        .withColumn("_prev", seen)
        .select(*df.columns, *[F.col(f"_prev.{out}").alias(out) for out in values])
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], values: dict[str, str],
    width_s: int = HOUR_S, peers: bool = False,
) -> DataFrame:
    """Add running totals including the current row (with ``peers``: and its equals in order)."""
    rows = _sliced(df, ts, width_s)
    totals = rows.groupBy(*keys, SLICE).agg(
        *[F.sum(src).alias(f"_t_{out}") for out, src in values.items()]
    )
    _, before = _fold(keys)
    carry = totals.select(
        *keys, SLICE,
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_c_{out}") for out in values],
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy(ts, *tie)
    frame = inside.rangeBetween if peers else inside.rowsBetween
    upto = frame(Window.unboundedPreceding, Window.currentRow)
    return _attach(rows, carry, keys).select(
        *df.columns,
        *[
            (F.col(f"_c_{out}") + F.coalesce(F.sum(src).over(upto), F.lit(0))).alias(out)
            for out, src in values.items()
        ],
    )


def last_known(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], values: dict[str, str],
    width_s: int = HOUR_S,
) -> DataFrame:
    """Add the latest non-NULL value up to and including the current row."""
    rows = _sliced(df, ts, width_s)
    order = F.struct(ts, *tie)
    tails = rows.groupBy(*keys, SLICE).agg(
        *[
            F.max_by(F.col(src), F.when(F.col(src).isNotNull(), order)).alias(f"_t_{out}")
            for out, src in values.items()
        ]
    )
    _, before = _fold(keys)
    carry = tails.select(
        *keys, SLICE,
        *[F.last(f"_t_{out}", ignorenulls=True).over(before).alias(f"_c_{out}") for out in values],
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy(ts, *tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _attach(rows, carry, keys).select(
        *df.columns,
        *[
            F.coalesce(F.last(src, ignorenulls=True).over(upto), F.col(f"_c_{out}")).alias(out)
            for out, src in values.items()
        ],
    )


def sessionize(
    df: DataFrame, keys: Sequence[str], start: str, end: str, tie: Sequence[str],
    gap_s: float = 7_200, width_s: int = HOUR_S,
) -> DataFrame:
    """Add ``prev_end`` and ``session_id``.

    A row opens a session when it starts strictly more than the gap after the end of
    the row before it (not after the largest end so far), or when it is the first.
    """
    gap_us = int(gap_s * 1_000_000)
    rows = _sliced(df, start, width_s)
    inside = Window.partitionBy(*keys, SLICE).orderBy(start, *tie)
    rows = rows.withColumn("_prev", F.lag(F.struct(F.col(end).alias("e"))).over(inside)).withColumn(
        "_opens",
        F.when(F.col("_prev").isNotNull(), _gap(F.col(start), F.col("_prev.e"), gap_us)).otherwise(0),
    )
    summary = rows.groupBy(*keys, SLICE).agg(
        F.sum("_opens").alias("_inner"),
        F.min(start).alias("_first"),
        F.max_by(end, F.struct(start, *tie)).alias("_last_end"),
    )
    w, before = _fold(keys)
    carry = summary.withColumn("_carry_end", F.lag("_last_end").over(w)).withColumn(
        "_first_opens", _gap(F.col("_first"), F.col("_carry_end"), gap_us)
    )
    carry = carry.select(
        *keys, SLICE, "_carry_end",
        (
            F.coalesce(F.sum(F.col("_inner") + F.col("_first_opens")).over(before), F.lit(0))
            + F.col("_first_opens")
        ).alias("_base"),
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _attach(rows, carry, keys).select(
        *df.columns,
        F.when(F.col("_prev").isNotNull(), F.col("_prev.e")).otherwise(F.col("_carry_end")).alias("prev_end"),
        (F.col("_base") + F.sum("_opens").over(upto)).alias("session_id"),
    )


def _gap(start: Column, prev_end: Column, gap_us: int) -> Column:
    late = F.unix_micros(start) - F.unix_micros(prev_end) > F.lit(gap_us)
    return F.when(prev_end.isNull() | late, 1).otherwise(0)


def drop_repeats(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], value: str,
    width_s: int = 30 * DAY_S,
) -> DataFrame:
    """Keep a row only where its value differs from the row before it."""
    marked = previous(df.withColumn("_one", F.lit(True)), keys, ts, tie,
                      {"_before": value, "_seen": "_one"}, width_s)
    return marked.filter(
        F.col("_seen").isNull() | ~F.col("_before").eqNullSafe(F.col(value))
    ).select(*df.columns)


def trailing_count(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int = 60, width_s: int = HOUR_S
) -> DataFrame:
    """Add ``trailing``: other rows of the key in the window ``(ts - seconds, ts]``.

    Each row adds one at its instant and takes one away when it leaves the window,
    which turns the sliding count into a running sum that can be sliced.
    """
    arrive = df.withColumns({"_at": F.col(ts), "_step": F.lit(1)})
    leave = df.select(*keys, (F.col(ts) + F.make_dt_interval(secs=F.lit(seconds))).alias("_at")).withColumn(
        "_step", F.lit(-1)
    )
    both = arrive.unionByName(leave, allowMissingColumns=True)
    summed = running_sum(both, keys, "_at", ["_step"], {"_running": "_step"}, width_s, peers=True)
    return summed.filter(F.col("_step") == 1).select(
        *df.columns, (F.col("_running") - 1).cast("long").alias("trailing")
    )


def asof_last(
    points: DataFrame, history: DataFrame, keys: Sequence[str], ts: str, effective: str,
    values: Sequence[str], tie: Sequence[str] = (), width_s: int = HOUR_S,
) -> DataFrame:
    """Add the values of the latest history entry at or before each point.

    Points and history share one timeline; an entry sorts before a point of the same
    instant. Use :func:`pulseframe.operators.zones.stamp_zone` where the history is short.
    """
    entry = history.select(
        *keys, F.col(effective).alias(ts), F.struct(*values).alias("_entry"), F.lit(0).alias("_kind")
    )
    both = points.withColumn("_kind", F.lit(1)).unionByName(entry, allowMissingColumns=True)
    filled = last_known(both, keys, ts, ["_kind", *tie], {"_known": "_entry"}, width_s)
    return filled.filter(F.col("_kind") == 1).select(
        *points.columns, *[F.col(f"_known.{v}").alias(v) for v in values]
    )
