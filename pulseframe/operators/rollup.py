"""Hourly and daily rollups of raw samples, and their zone re-bucketing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe import schema as S
from pulseframe.functions import meta as M, zones as Z
from pulseframe.functions.metrics import is_sleep

BUCKET = ("user_id", "metric_type", "bucket_ts")


def live_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def compact(samples: DataFrame, unit: str) -> DataFrame:
    """First aggregation level: one row per bucket and distinct unit, context and source.

    All buffers are fixed-width numbers, so this level stays a code-generated hash
    aggregate with map-side combine, and a crowded bucket shrinks before it is
    shuffled. Everything that needs text buffers happens on the compacted rows.
    """
    return (
        live_rows(samples)
        .filter(~is_sleep(F.col("metric_type")))
        .select(
            "user_id", "metric_type", F.date_trunc(unit, "ts").alias("bucket_ts"), "unit",
            Z.stated_zone(F.col("meta"), F.col("hk_metadata")).alias("zone"),
            F.col("meta.utc_offset_min").alias("offset_min"),
            (F.col("meta").isNotNull() | F.col("hk_metadata").isNotNull()).alias("has_context"),
            "hk_source_name", "hk_source_version", "metric_value", "ts",
        )
        .groupBy(*BUCKET, "unit", "zone", "offset_min", "has_context", "hk_source_name", "hk_source_version")
        .agg(
            F.sum("metric_value").alias("total"),
            F.min("metric_value").alias("low"),
            F.max("metric_value").alias("high"),
            F.count(F.lit(1)).alias("n"),
            F.max("ts").alias("latest"),
        )
    )


def latest(col: Column, order: Column) -> Column:
    """Aggregate: the non-NULL value with the greatest order; equal orders take the greater value."""
    return F.max_by(col, F.when(col.isNotNull(), F.struct(order, col)))


def latest_meta(zone: str, offset: str, has_context: str, ts: str) -> Column:
    """Aggregate: zone context of the latest row that carries any context."""
    value = M.context_struct(F.col(zone), F.col(offset))
    return F.max_by(value, F.when(F.col(has_context), F.struct(ts, zone, offset)))


def distinct_sources(name: str = "hk_source_name", version: str = "hk_source_version") -> Column:
    """Aggregate: sorted distinct sources, empty when no row names one."""
    source = F.when(
        F.col(name).isNotNull(), F.struct(F.col(name).alias("name"), F.col(version).alias("version"))
    )
    return F.array_sort(F.collect_set(source)).cast(S.SOURCES)


def rollup(samples: DataFrame, unit: str) -> DataFrame:
    """Rollup by user, metric and UTC hour or day."""
    metric, total, n = F.col("metric_type"), F.sum("total"), F.sum("n")
    return (
        compact(samples, unit)
        .groupBy(*BUCKET)
        .agg(
            latest(F.col("unit"), F.col("latest")).alias("unit"),
            total.alias("_total"),
            F.min("low").alias("min_value"),
            F.max("high").alias("max_value"),
            n.alias("n"),
            latest_meta("zone", "offset_min", "has_context", "latest").alias("meta"),
            distinct_sources().alias("hk_sources"),
        )
        .select(
            *BUCKET, "unit",
            F.when(metric.isin(*S.AVERAGE_METRICS), F.col("_total") / F.col("n")).alias("avg_value"),
            F.when(metric.isin(*S.SUM_METRICS), F.col("_total")).alias("sum_value"),
            "min_value", "max_value", "n", "meta", "hk_sources",
        )
    )


def states(samples: DataFrame, unit: str = "hour") -> DataFrame:
    """Mergeable rollup rows: sum and count of every metric, and the latest unit and context each
    with its instant, so that rows of small buckets add up to those of large ones."""
    at = F.col("latest").alias("at")
    return compact(samples, unit).groupBy(*BUCKET).agg(
        F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"),
        F.max(F.when(F.col("unit").isNotNull(), F.struct(at, "unit"))).alias("last_unit"),
        F.max(F.when(F.col("has_context"), F.struct(at, "zone", "offset_min"))).alias("last_context"),
        distinct_sources().alias("hk_sources"),
    )


def merge_states(parts: DataFrame, unit: str) -> DataFrame:
    """States of smaller buckets, or several of one bucket, merged into those of ``unit``."""
    return parts.withColumn("bucket_ts", F.date_trunc(unit, "bucket_ts")).groupBy(*BUCKET).agg(
        F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"),
        F.max("last_unit").alias("last_unit"), F.max("last_context").alias("last_context"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hk_sources")))).cast(S.SOURCES).alias("hk_sources"),
    )


def finish(merged: DataFrame) -> DataFrame:
    """States as rollup rows."""
    metric = F.col("metric_type")
    return merged.select(
        *BUCKET, F.col("last_unit.unit").alias("unit"),
        F.when(metric.isin(*S.AVERAGE_METRICS), F.col("total") / F.col("n")).alias("avg_value"),
        F.when(metric.isin(*S.SUM_METRICS), F.col("total")).alias("sum_value"),
        F.col("low").alias("min_value"), F.col("high").alias("max_value"), "n",
        M.context_struct(F.col("last_context.zone"), F.col("last_context.offset_min")).alias("meta"), "hk_sources",
    )


def refresh_states(stored: DataFrame, samples: DataFrame, hours: DataFrame) -> DataFrame:
    """Hourly states with those of the touched hours (``user_id, hour``) computed again from the
    samples that are there. Hours whose samples have since been pruned keep their states, so a day
    merged from hours keeps them too, where a day computed again from samples would lose them."""
    touched = hours.select("user_id", F.col("hour").alias("bucket_ts")).distinct()
    keys = ["user_id", "bucket_ts"]
    mine = samples.withColumn("bucket_ts", F.date_trunc("hour", "ts")).join(touched, keys, "left_semi")
    kept = stored.join(touched, keys, "left_anti")
    return kept.select(*stored.columns).unionByName(states(mine.select(*samples.columns), "hour"))


def local_day_rollup(samples: DataFrame) -> DataFrame:
    """Daily rollup cut at the local midnights of each sample's own zone.

    Unlike :func:`rebucket_tz` on daily rollups this starts from raw samples, so no
    sample lands on the neighbouring day.
    """
    zone = Z.safe_zone(Z.stated_zone(F.col("meta"), F.col("hk_metadata")))
    shifted = samples.withColumn("ts", Z.local_time(F.col("ts"), zone))
    return rollup(shifted, "day").withColumnRenamed("bucket_ts", "local_day")


def any_non_null(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Any non-NULL value per group; the smallest, so that reruns agree."""
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in cols])


def rebucket_tz(rollups: DataFrame, unit: str, zone: str) -> DataFrame:
    """Rollup rows relabelled by the local hour or day in which their UTC bucket starts.

    An absent average or sum counts as zero here, as the query contract has it.
    """
    bucket = Z.local_trunc(F.col("bucket_ts"), unit, zone)
    n = F.sum("n")
    weighted = F.sum(F.coalesce("avg_value", F.lit(0.0)) * F.col("n"))
    return (
        rollups.withColumn("bucket_ts", bucket)
        .groupBy("user_id", "bucket_ts", "metric_type")
        .agg(
            F.min("unit").alias("unit"),
            F.min("meta").alias("meta"),
            F.min("hk_sources").alias("hk_sources"),
            F.when(n > 0, weighted / n).alias("avg_value"),
            F.sum(F.coalesce("sum_value", F.lit(0.0))).alias("sum_value"),
            F.min("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
            n.alias("n"),
        )
    )


def weighted_avg(rollups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average across buckets, weighted by sample count; NULL without samples."""
    n = F.sum("n")
    return rollups.groupBy(*keys).agg(
        (F.sum(F.col("avg_value") * F.col("n")) / F.nullif(n, F.lit(0))).alias("avg_value"),
        n.alias("n"),
    )


def drop_sleep_rollups(rollups: DataFrame) -> DataFrame:
    return rollups.filter(~is_sleep(F.col("metric_type")))
