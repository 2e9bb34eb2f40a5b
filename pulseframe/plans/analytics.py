"""Analytic patterns over the derived tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseframe.functions import zones as Z
from pulseframe.operators.ranking import top_k

OFFSETS = {"day_before": -1, "day_of": 0, "day_after": 1}


def _day_value(metric: str, day: Column, anchor: Column, offset: int, value: Column) -> Column:
    return F.max(
        F.when((F.col("metric_type") == metric) & (day == F.date_add(anchor, offset)), value)
    )


def _pivot(metrics: Sequence[str], day: Column, anchor: Column) -> list[Column]:
    value = F.coalesce("sum_value", "avg_value")
    columns = [
        _day_value(m, day, anchor, off, value).alias(f"{m}_{name}")
        for m in metrics
        for name, off in OFFSETS.items()
    ]
    units = [F.max(F.when(F.col("metric_type") == m, F.col("unit"))).alias(f"{m}_unit") for m in metrics]
    return columns + units


def pivot_day_offsets(rollups: DataFrame, anchor_date: str, metrics: Sequence[str], tz: str) -> DataFrame:
    """Day before, day of and day after a fixed date as columns, one row per user.

    Metrics that add up show their sum, the others their average. The date range is
    applied before grouping, so that only three days are read.
    """
    anchor = F.lit(anchor_date).cast("date")
    day = Z.local_date(F.col("bucket_ts"), tz)
    near = rollups.filter(
        F.col("metric_type").isin(*metrics) & day.between(F.date_add(anchor, -1), F.date_add(anchor, 1))
    )
    return near.groupBy("user_id").agg(*_pivot(metrics, day, anchor))


def sleep_context(nights: DataFrame, rollups: DataFrame, metrics: Sequence[str], tz: str) -> DataFrame:
    """Every night with the daily values around it; nights without any keep NULLs.

    Each night asks for three exact days, which keeps the join an equality on user and
    day instead of a range.
    """
    days = nights.withColumn("_day", F.explode(F.array(*[F.date_add("sleep_date", o) for o in OFFSETS.values()])))
    context = rollups.filter(F.col("metric_type").isin(*metrics)).select(
        "user_id", Z.local_date(F.col("bucket_ts"), tz).alias("_day"), "metric_type", "unit",
        "sum_value", "avg_value",
    )
    return (
        days.join(context, ["user_id", "_day"], "left")
        .groupBy("user_id", "sleep_date", "asleep_minutes")
        .agg(*_pivot(metrics, F.col("_day"), F.col("sleep_date")))
    )


def sleep_aligned(nights: DataFrame, rollups: DataFrame, tz: str) -> DataFrame:
    """Nights with the daily rollups of the same local day in the night's own zone.

    A UTC bucket can only fall on the day before, the same or the day after its UTC
    date, so the join is an equality on three candidate dates and then exact.
    """
    zone = Z.safe_zone(F.col("meta.tz_name"), F.lit(tz))
    asked = nights.select("user_id", "sleep_date", "asleep_minutes", zone.alias("night_tz")).withColumn(
        "_utc_day", F.explode(F.array(*[F.date_add("sleep_date", o) for o in (-1, 0, 1)]))
    )
    days = rollups.select(
        "user_id", "metric_type", "bucket_ts", "sum_value", "avg_value", "n",
        F.to_date("bucket_ts").alias("_utc_day"),
    )
    return (
        asked.join(days, ["user_id", "_utc_day"])
        .filter(Z.local_date(F.col("bucket_ts"), F.col("night_tz")) == F.col("sleep_date"))
        .drop("_utc_day")
    )


def workout_splits(workouts: DataFrame, parts: DataFrame) -> DataFrame:
    """Splits with the type and distance of their workout."""
    summary = workouts.select("user_id", "workout_uuid", "workout_type", "distance_km")
    return parts.join(summary, ["user_id", "workout_uuid"])


def total_and_daily_avg(rollups: DataFrame, metric: str) -> DataFrame:
    """Total of a period and its average per day with data."""
    day = F.to_date("bucket_ts")
    total = F.sum("sum_value")
    days = F.count_distinct(day)
    return rollups.filter(F.col("metric_type") == metric).groupBy("user_id").agg(
        total.alias("total"), days.alias("days"), (total / days).alias("per_day")
    )


def _level() -> Column:
    return F.coalesce("sum_value", "avg_value")


def bucket_deltas(rollups: DataFrame) -> DataFrame:
    """Change of each bucket against the one before it.

    One row per user, metric and bucket: the window group is bounded by elapsed time.
    """
    w = Window.partitionBy("user_id", "metric_type").orderBy("bucket_ts")
    return rollups.withColumn("level", _level()).withColumn("delta", F.col("level") - F.lag("level").over(w))


def peaks_deltas(rollups: DataFrame) -> DataFrame:
    """Peak, dip and largest rise and fall per user and metric."""
    return bucket_deltas(rollups).groupBy("user_id", "metric_type").agg(
        F.max("max_value").alias("peak"),
        F.min("min_value").alias("dip"),
        F.max("delta").alias("largest_rise"),
        F.min("delta").alias("largest_fall"),
    )


def top_deltas(rollups: DataFrame, n: int = 3) -> DataFrame:
    """The largest bucket-to-bucket changes over all users and metrics."""
    changes = bucket_deltas(rollups).filter(F.col("delta").isNotNull()).select(
        "user_id", "metric_type", "bucket_ts", "level", "delta"
    )
    return top_k(changes, [F.abs("delta").desc(), F.col("user_id"), F.col("metric_type"), F.col("bucket_ts")], n)
