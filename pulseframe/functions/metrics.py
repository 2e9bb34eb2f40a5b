"""Column expressions and dimension tables for the metric vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe import schema as S


def _case(col: Column, mapping: dict, default) -> Column:
    expr = F
    for key, value in mapping.items():
        expr = expr.when(col == F.lit(key), F.lit(value))
    return expr.otherwise(default)


def is_event(metric_type: Column) -> Column:
    """Workout and event rows; rows without a type are plain metrics."""
    return F.coalesce(
        metric_type.startswith("event_") | metric_type.startswith("workout_"), F.lit(False)
    )


def is_sleep(metric_type: Column) -> Column:
    return metric_type.like("sleep_%")


def sleep_stage_metric(code: Column) -> Column:
    """Sleep category code to stage metric; unknown codes count as unspecified sleep."""
    return F.format_string(
        "sleep_%s_minutes", _case(code, S.SLEEP_STAGE_CODES, F.lit("asleep_unspecified"))
    )


def stage_label(metric_type: Column) -> Column:
    return _case(metric_type, {f"sleep_{s}_minutes": s for s in S.SLEEP_STAGES}, F.lit(None))


def activity_label(code: Column) -> Column:
    return _case(code, S.ACTIVITY_CODES, F.lit("workout"))


def canonical_value(metric_type: Column, value: Column) -> Column:
    """Saturation fractions become percentage points."""
    return F.when(metric_type == "oxygen_saturation", value * 100.0).otherwise(value)


def duration_value(start: Column, end: Column, unit: Column | str = "min") -> Column:
    """Length of an interval in minutes, or hours where the unit asks for it; never negative."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    minutes = F.greatest(F.lit(0), F.unix_micros(end) - F.unix_micros(start)) / 60_000_000
    return F.when(unit == "hours", minutes / 60.0).otherwise(minutes)


def metric_catalog(spark: SparkSession) -> DataFrame:
    """Dimension of fixed size: one row per known metric."""
    rows = [(m, unit, kind) for m, (unit, kind) in S.METRIC_CATALOG.items()]
    return spark.createDataFrame(rows, "metric_type string, unit_label string, agg_class string")


def with_catalog(df: DataFrame) -> DataFrame:
    """Add unit label and aggregation class; unknown metrics drop out.

    The dimension is a constant of the library (a couple of dozen rows), so the
    broadcast cannot grow with the data.
    """
    return df.join(F.broadcast(metric_catalog(df.sparkSession)), "metric_type", "inner")
