"""Workout rows: attribute form, summary form, and the samples recorded during them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe import schema as S
from pulseframe.functions import meta as M
from pulseframe.functions.clean import blank_to_null, strip, within_span
from pulseframe.operators.intervals import points_in_spans
from pulseframe.operators.rollup import live_rows

WORKOUT = ("user_id", "workout_uuid")


def unpivot_workout(workouts: DataFrame) -> DataFrame:
    """Each workout as three attribute rows with a composite id."""
    columns = ("distance_km", "duration_min", "energy_kcal")
    units = ("km", "min", "kcal")
    rows = F.array(
        *[
            F.struct(F.lit(attr).alias("event_type"), F.col(c).alias("value"), F.lit(u).alias("unit"))
            for attr, c, u in zip(S.WORKOUT_ATTRIBUTES, columns, units)
        ]
    )
    rest = [c for c in workouts.columns if c not in columns]
    return workouts.select(*rest, F.inline(rows)).withColumn(
        "hk_uuid", F.concat_ws("|", "workout_uuid", "event_type")
    )


def expand_deletes(deleted: DataFrame) -> DataFrame:
    """Tombstones of a deleted id: one per workout attribute, and the bare id."""
    ids = F.array(
        *[F.concat_ws("|", "hk_uuid", F.lit(a)) for a in S.WORKOUT_ATTRIBUTES], F.col("hk_uuid")
    )
    return deleted.withColumns({"hk_uuid": F.explode(ids), "op": F.lit("delete")})


def split_workout_id(df: DataFrame, col: str = "hk_uuid") -> DataFrame:
    """Parts of a composite id; ``touches`` marks base workout rows. No bar: both NULL."""
    parts = F.split(F.col(col), "[|]", 2)
    composite = F.col(col).contains("|")
    wid = blank_to_null(parts[0])
    suffix = F.when(composite, F.get(parts, 1))
    return df.withColumns(
        {
            "workout_uuid": F.when(composite, wid),
            "suffix": suffix,
            "touches": F.coalesce(suffix.startswith("workout_") & wid.isNotNull(), F.lit(False)),
        }
    )


def first_by_type(col: str) -> Column:
    """Aggregate: first non-NULL value in order of event type."""
    return F.min_by(col, F.when(F.col(col).isNotNull(), F.col("event_type")))


def workout_pivot(events: DataFrame) -> DataFrame:
    """Attribute rows folded into one row per workout; workouts without a start drop out."""
    kind = F.col("event_type")
    rows = split_workout_id(live_rows(events)).filter(
        F.col("workout_uuid").isNotNull() & strip(F.col("suffix")).isin(*S.WORKOUT_ATTRIBUTES)
    )
    value = {
        "duration_min": "workout_duration_min",
        "distance_km": "workout_distance_km",
        "energy_kcal": "workout_energy_kcal",
    }
    return (
        rows.groupBy(*WORKOUT)
        .agg(
            first_by_type("source").alias("workout_type"),
            first_by_type("ts").alias("start_ts"),
            first_by_type("end_ts").alias("end_ts"),
            *[F.max(F.when(kind == a, F.col("value"))).alias(c) for c, a in value.items()],
            first_by_type("hk_source_name").alias("hk_source_name"),
            first_by_type("hk_source_version").alias("hk_source_version"),
            first_by_type("hk_metadata").alias("hk_metadata"),
        )
        .filter(F.col("start_ts").isNotNull())
    )


def workout_end(df: DataFrame) -> DataFrame:
    """Missing ends become start plus duration; no workout is longer than ``MAX_SPAN_DAYS``."""
    longest = F.lit(S.MAX_SPAN_DAYS * 1_440.0)
    known = F.col("duration_min").isNotNull() & ~F.isnan("duration_min")
    minutes = F.when(known, F.least("duration_min", longest))
    by_duration = F.timestamp_micros(F.unix_micros("start_ts") + F.floor(minutes * 60_000_000 + 0.5))
    return df.withColumn("end_ts", F.coalesce(within_span("start_ts", "end_ts"), by_duration))


def workouts(events: DataFrame) -> DataFrame:
    """Workout summary table from stored attribute rows."""
    return workout_end(workout_pivot(events)).select(
        *WORKOUT, "workout_type", "start_ts", "end_ts", "duration_min", "distance_km", "energy_kcal",
        M.source_list(F.col("hk_source_name"), F.col("hk_source_version")).alias("hk_sources"),
        "hk_metadata",
    )


def distance_workouts(
    df: DataFrame, keywords: Sequence[str] = S.DISTANCE_KEYWORDS, min_km: float = 1.0
) -> DataFrame:
    """Workouts worth splitting: a distance word in the type and enough distance.

    The default words miss ``cycling`` and ``hiking``; pass others to include them.
    """
    kind = F.lower(strip(F.coalesce("workout_type", F.lit(""))))
    return df.filter(kind.rlike("|".join(keywords))).filter(
        F.coalesce("distance_km", F.lit(0.0)) >= min_km
    )


def samples_in_workout(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Live samples with each workout of the same user that was under way."""
    windows = spans.select(
        *WORKOUT,
        F.col("start_ts").alias("workout_start_ts"),
        F.coalesce("end_ts", "start_ts").alias("workout_end_ts"),
    )
    return points_in_spans(
        live_rows(samples), windows, ["user_id"], "ts", "workout_start_ts", "workout_end_ts"
    )


def stream_rank() -> Column:
    """Position of a distance metric in the order of preference, from one on."""
    return F.array_position(F.array(*[F.lit(m) for m in S.DISTANCE_METRICS]), F.col("metric_type"))


def best_stream(in_workout: DataFrame, min_km: float = 1.0) -> DataFrame:
    """The distance metric with the largest total per workout; equal totals keep the listed order."""
    rank = stream_rank()
    totals = (
        in_workout.filter(F.col("metric_type").isin(*S.DISTANCE_METRICS))
        .groupBy(*WORKOUT, "metric_type")
        .agg(F.sum("metric_value").alias("total_km"), F.min("ts").alias("first_ts"))
    )
    packed = F.struct("metric_type", "total_km", "first_ts")
    return (
        totals.groupBy(*WORKOUT)
        .agg(F.max_by(packed, F.struct(F.col("total_km"), -rank)).alias("best"))
        .select(*WORKOUT, "best.*")
        .filter(F.col("total_km") >= min_km)
    )


def upsert_workouts(base: DataFrame, new: DataFrame) -> DataFrame:
    from pulseframe.operators.merge import merge_by_policy

    keep = [c for c in base.columns if c not in (*WORKOUT, "start_ts")]
    return merge_by_policy(
        base, new.withColumn("ordinal", F.lit(0)), WORKOUT, ["start_ts"], keep
    )
