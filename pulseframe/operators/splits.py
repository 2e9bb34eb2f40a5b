"""Equal-distance splits of workouts, in closed form over running distance.

Distances are whole micro-kilometres, so a boundary never slips to the next sample
through floating carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulseframe import schema as S
from pulseframe.operators.intervals import points_in_spans
from pulseframe.operators.rollup import live_rows
from pulseframe.operators.timeline import HOUR_S, SLICE, slice_of
from pulseframe.operators.workouts import WORKOUT, distance_workouts, samples_in_workout, stream_rank

LENGTHS = {"km": S.MICRO_KM, "mi": S.MICRO_KM_PER_MILE}
SPLIT = (*WORKOUT, "segment_unit", "segment_index")


def distance_in_workouts(samples: DataFrame, workouts: DataFrame, **gate) -> DataFrame:
    """Distance samples inside workouts that pass the distance gate."""
    distance = samples.filter(F.col("metric_type").isin(*S.DISTANCE_METRICS)).select(
        "user_id", "hk_uuid", "ts", "end_ts", "metric_type", "metric_value", "deleted_at"
    )
    return samples_in_workout(distance, distance_workouts(workouts, **gate))


def cumulative_distance(inside: DataFrame, min_km: float = 1.0, width_s: int = 6 * HOUR_S) -> DataFrame:
    """Samples of each workout's best distance stream with the distance covered before and after.

    Works in time slices (see ``timeline``): slice totals of all streams give, in one go,
    the distance before each slice, the total and first instant of each stream, and which
    stream of a workout is best, so samples are joined with their slice's row only.
    """
    rows = inside.withColumns(
        {
            "distance_ukm": F.floor(F.col("metric_value") * S.MICRO_KM + 0.5).cast("long"),
            SLICE: slice_of(F.col("ts"), width_s),
        }
    )
    positive = F.when(F.col("distance_ukm") > 0, F.col("distance_ukm")).otherwise(0)
    stream = Window.partitionBy(*WORKOUT, "metric_type")
    rank = stream_rank()
    best = F.max(F.struct("total_km", (-rank).alias("r"))).over(Window.partitionBy(*WORKOUT))
    carry = (
        rows.groupBy(*WORKOUT, "metric_type", SLICE)
        .agg(F.sum(positive).alias("ukm"), F.sum("metric_value").alias("km"), F.min("ts").alias("first"))
        .select(
            *WORKOUT, "metric_type", SLICE,
            F.coalesce(
                F.sum("ukm").over(stream.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_before"),
            F.sum("km").over(stream).alias("total_km"),
            F.min("first").over(stream).alias("first_ts"),
        )
        .withColumn("_best", best)
        .filter((F.col("_best.r") == -rank) & (F.col("total_km") >= min_km))
        .drop("_best")
    )
    inside_slice = Window.partitionBy(*WORKOUT, "metric_type", SLICE).orderBy("ts", "hk_uuid")
    upto = inside_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.filter(F.col("distance_ukm") > 0)
        .join(carry, [*WORKOUT, "metric_type", SLICE])
        .withColumn("covered_ukm", F.col("_before") + F.sum("distance_ukm").over(upto))
        .withColumn("before_ukm", F.col("covered_ukm") - F.col("distance_ukm"))
        .drop(SLICE, "_before")
    )


def distance_stream(samples: DataFrame, workouts: DataFrame, **gate) -> DataFrame:
    return cumulative_distance(distance_in_workouts(samples, workouts, **gate))


def splits(stream: DataFrame, units: tuple[str, ...] = ("km", "mi"), cap: int | None = None) -> DataFrame:
    """Full splits with proportional boundaries inside a sample.

    Per sample the boundaries it contains follow from the distance before and after it. Each
    boundary ends one split and starts the next, so the two ends of a split meet by its number:
    one shuffle on a key that is as fine as the result, however long the workout. All splits are
    returned unless ``cap`` says how many of a workout and unit are wanted.
    """
    length = F.col("length_ukm")
    units_col = F.array(
        *[F.struct(F.lit(u).alias("segment_unit"), F.lit(LENGTHS[u]).cast("long").alias("length_ukm")) for u in units]
    )
    first = F.expr("before_ukm div length_ukm") + 1
    last = F.expr("covered_ukm div length_ukm")
    last = last if cap is None else F.least(last, F.lit(cap))
    span = F.greatest(F.coalesce(F.unix_micros("end_ts") - F.unix_micros("ts"), F.lit(0)), F.lit(0))
    part = (F.col("segment_index") * length - F.col("before_ukm")) / F.col("distance_ukm")
    boundary = F.timestamp_micros(F.unix_micros("ts") + F.floor(span * part + 0.5))
    marks = (
        stream.select("*", F.inline(units_col))
        .filter(last >= first)
        .withColumn("segment_index", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        .withColumn("end_mark", boundary)
    )
    nothing = F.lit(None).cast("timestamp")
    ends = F.struct("segment_index", nothing.alias("start_mark"), "end_mark")
    starts = F.struct((F.col("segment_index") + 1).alias("segment_index"), F.col("end_mark").alias("start_mark"), nothing.alias("end_mark"))
    return (
        marks.select(*WORKOUT, "segment_unit", "workout_start_ts", "workout_end_ts", "first_ts", F.inline(F.array(ends, starts)))
        .groupBy(*SPLIT)
        .agg(*(F.max(c).alias(c) for c in ("workout_start_ts", "workout_end_ts", "first_ts", "start_mark", "end_mark")))
        .filter(F.col("end_mark").isNotNull())
        .select(
            *SPLIT, "workout_start_ts", "workout_end_ts",
            F.coalesce("start_mark", "first_ts").alias("start_ts"), F.col("end_mark").alias("end_ts"),
        )
    )


def hr_in_split(samples: DataFrame, parts: DataFrame) -> DataFrame:
    """Heart-rate samples with the split (and workout) during which they were taken."""
    beats = live_rows(samples).filter(F.col("metric_type") == "heart_rate").select(
        "user_id", "hk_uuid", "ts", F.col("metric_value").alias("bpm")
    )
    return points_in_spans(beats, parts, ["user_id"], "ts", "start_ts", "end_ts").filter(
        (F.col("ts") >= F.col("workout_start_ts")) & (F.col("ts") < F.col("workout_end_ts"))
    )


def split_avg_hr(samples: DataFrame, parts: DataFrame) -> DataFrame:
    return hr_in_split(samples, parts).groupBy(*SPLIT).agg(F.avg("bpm").alias("avg_hr_bpm"))


def split_measures(parts: DataFrame, samples: DataFrame) -> DataFrame:
    """Duration, offsets from the workout start, pace and mean heart rate of each split."""

    def minutes(a: str, b: str):
        return F.greatest(F.lit(0), F.unix_micros(b) - F.unix_micros(a)) / 60_000_000

    return (
        parts.join(split_avg_hr(samples, parts), list(SPLIT), "left")
        .select(
            *SPLIT, "workout_start_ts", "start_ts", "end_ts",
            minutes("workout_start_ts", "start_ts").alias("start_offset_min"),
            minutes("workout_start_ts", "end_ts").alias("end_offset_min"),
            minutes("start_ts", "end_ts").alias("duration_min"),
            "avg_hr_bpm",
        )
        # a split is one unit long, so its pace is its duration in seconds
        .withColumn("pace_s_per_unit", F.col("duration_min") * 60.0)
    )
