"""Joins between instants and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulseframe.operators.timeline import slice_of

WIDTH_S = 6 * 3_600


def points_in_spans(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], ts: str, start: str, end: str,
    width_s: int = WIDTH_S,
) -> DataFrame:
    """Inner join of points with half-open spans ``[start, end)`` of the same key.

    Spans are laid onto time slices and joined on key *and* slice, so a busy key is
    spread over its slices and only neighbours in time are compared. A point lies in
    exactly one slice, hence no duplicates. AQE may split what is still skewed.
    """
    last = F.timestamp_micros(F.unix_micros(F.col(end)) - 1)
    step = F.lit(width_s * 1_000_000)
    slices = F.sequence(slice_of(F.col(start), width_s), slice_of(last, width_s), step)
    laid = spans.filter(F.col(end) > F.col(start)).withColumn("_slice", F.explode(slices))
    return (
        points.withColumn("_slice", slice_of(F.col(ts), width_s))
        .join(laid, [*keys, "_slice"], "inner")
        .filter((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end)))
        .drop("_slice")
    )
