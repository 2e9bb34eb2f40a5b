"""Hourly counts of a pure stream that waits for late rows, without a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseframe import schema as S

LATENESS = f"{S.RETENTION_DAYS} days"


def late_rollup(stream: DataFrame, lateness: str = LATENESS, unit: str = "hour") -> DataFrame:
    """Buckets with count, sum, least and greatest value, each once, when nothing can reach it any more.

    A sample that comes again within the lateness counts once. The state is one id for each sample
    and one row for each open bucket. Rows later than that are not counted; :func:`too_late` says
    how many there were, so none is lost unseen. For rows that change or go again, and for rows of
    any age, use :func:`pulseframe.streaming.rollup.stream_rollup`.
    """
    once = stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["user_id", "hk_uuid"])
    value = F.col("metric_value")
    counted = once.groupBy("user_id", "metric_type", F.window("ts", f"1 {unit}").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return counted.select("user_id", "metric_type", F.col("w.start").alias("bucket_ts"), "n", "total", "min_value", "max_value")


def too_late(query: StreamingQuery) -> int:
    """Rows of a query's run that came after the lateness, by its progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
