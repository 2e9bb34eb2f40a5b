"""Bursts of change events, joined over a quiet period."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseframe.operators.timeline import sessionize


def coalesce_bursts(events: DataFrame, gap: str = "5 seconds", watermark: str | None = None) -> DataFrame:
    """One row per user and burst; works on a batch or, with a watermark, on a stream.

    In a batch bursts are cut in time slices (see ``timeline``), so the events of a busy user are
    spread over tasks. A stream uses Spark's session windows, whose state is the open bursts.
    """
    if not events.isStreaming:
        seconds = events.sparkSession.range(1).select(F.expr(f"unix_seconds(timestamp '1970-01-01 00:00:00' + interval {gap})")).first()[0]
        cut = sessionize(events.select("user_id", "ts"), ["user_id"], "ts", "ts", [], seconds)
        end = F.max("ts") + F.expr(f"interval {gap}")
        bursts = cut.groupBy("user_id", "session_id").agg(F.min("ts").alias("burst_start"), end.alias("burst_end"), F.count(F.lit(1)).alias("n"))
        return bursts.drop("session_id")
    if watermark:
        events = events.withWatermark("ts", watermark)
    return (
        events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "n")
    )
