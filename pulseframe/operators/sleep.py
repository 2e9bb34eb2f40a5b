"""Sleep sessions, nights and stage segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseframe import schema as S
from pulseframe.functions import meta as M, zones as Z
from pulseframe.functions.metrics import is_sleep, stage_label
from pulseframe.operators.rollup import distinct_sources, latest, live_rows
from pulseframe.operators.timeline import HOUR_S, sessionize

GAP_S = 2 * 3_600


def sleep_rows(samples: DataFrame) -> DataFrame:
    """Live stage rows as intervals; rows that end before they start are left out."""
    end = F.coalesce("end_ts", "ts")
    return (
        live_rows(samples)
        .filter(is_sleep(F.col("metric_type")) & (F.col("metric_type") != "sleep_hours"))
        .filter(end >= F.col("ts"))
        .select(
            "user_id", "hk_uuid", "metric_type", "metric_value",
            F.col("ts").alias("segment_start_ts"), end.alias("segment_end_ts"),
            "meta", "hk_source_name", "hk_source_version",
            Z.effective_zone(F.col("meta"), F.col("hk_metadata")).alias("tz_name"),
        )
    )


def sleep_sessions_of(rows: DataFrame, gap_s: float = GAP_S, width_s: int = HOUR_S) -> DataFrame:
    """Sleep rows with the end of the row before and a session number per user."""
    return sessionize(
        rows, ["user_id"], "segment_start_ts", "segment_end_ts", ["hk_uuid"], gap_s, width_s
    )


def session_bounds(sessionized: DataFrame) -> DataFrame:
    """Start, end and zone of each session; the zone is that of its latest-starting row."""
    return sessionized.groupBy("user_id", "session_id").agg(
        F.min("segment_start_ts").alias("session_start_ts"),
        F.max("segment_end_ts").alias("session_end_ts"),
        F.max_by("tz_name", F.struct("segment_start_ts", "hk_uuid")).alias("session_tz"),
    )


def label_rows(sessionized: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows with the night they belong to: the local date on which their session ends."""
    night = Z.local_date(F.col("session_end_ts"), Z.safe_zone(F.col("session_tz")))
    dated = sessions.select("user_id", "session_id", night.alias("sleep_date"))
    return sessionized.join(dated, ["user_id", "session_id"])


def label_sleep(samples: DataFrame, gap_s: float = GAP_S, width_s: int = HOUR_S) -> DataFrame:
    rows = sleep_sessions_of(sleep_rows(samples), gap_s, width_s)
    return label_rows(rows, session_bounds(rows))


def _row_context():
    return F.coalesce("meta", M.context_struct(F.col("tz_name"), F.lit(None)))


MINUTES = ("asleep_minutes", "rem_minutes", "core_minutes", "deep_minutes", "awake_minutes")


def _minutes(flag):
    return F.sum(F.when(flag, F.col("minutes")).otherwise(0.0))


def _totals() -> list:
    """Aggregates over rows with stage, minutes and context."""
    stage = F.col("stage")
    return [
        F.min("segment_start_ts").alias("sleep_start_ts"),
        F.max("segment_end_ts").alias("sleep_end_ts"),
        _minutes(stage.isin(*S.ASLEEP_STAGES)).alias("asleep_minutes"),
        *[_minutes(stage == s).alias(f"{s}_minutes") for s in ("rem", "core", "deep", "awake")],
        latest(F.struct("segment_start_ts", "meta"), F.when(F.col("meta").isNotNull(), F.col("segment_start_ts")))
        .alias("last_meta"),
    ]


def night_totals(rows: DataFrame, *more) -> DataFrame:
    """One row per user and night."""
    return (
        rows.groupBy("user_id", "sleep_date").agg(*_totals(), *more)
        .withColumn("meta", F.col("last_meta.meta")).drop("last_meta")
    )


def sleep_daily(sessionized: DataFrame) -> DataFrame:
    """Nights from sessionized rows. Time in bed widens a night but adds no sleep.

    A night is made of whole sessions, so rows are summed up per session first and the
    few session rows then per night; the rows are never joined back to their session.
    """
    rows = sessionized.withColumns(
        {
            "stage": stage_label(F.col("metric_type")),
            "minutes": F.coalesce("metric_value", F.lit(0.0)),
            "meta": _row_context(),
        }
    )
    sessions = rows.groupBy("user_id", "session_id").agg(
        *_totals(),
        F.max_by("tz_name", F.struct("segment_start_ts", "hk_uuid")).alias("session_tz"),
        distinct_sources().alias("hk_sources"),
    )
    night = Z.local_date(F.col("sleep_end_ts"), Z.safe_zone(F.col("session_tz")))
    last = F.max_by("last_meta", F.col("last_meta.segment_start_ts"))["meta"]
    return (
        sessions.withColumn("sleep_date", night)
        .groupBy("user_id", "sleep_date")
        .agg(
            F.min("sleep_start_ts").alias("sleep_start_ts"),
            F.max("sleep_end_ts").alias("sleep_end_ts"),
            *[F.sum(c).alias(c) for c in MINUTES],
            last.alias("meta"),
            _union_sources().alias("hk_sources"),
        )
    )


def _union_sources():
    named = F.filter(F.array_distinct(F.flatten(F.collect_set("hk_sources"))), lambda s: s["name"].isNotNull())
    return F.array_sort(named)


def sleep_segments(labelled: DataFrame) -> DataFrame:
    """Stage intervals of positive length."""
    return labelled.filter(F.col("segment_end_ts") > F.col("segment_start_ts")).select(
        "user_id", "hk_uuid", "sleep_date",
        stage_label(F.col("metric_type")).alias("stage"),
        "segment_start_ts", "segment_end_ts",
        F.coalesce("metric_value", F.lit(0.0)).alias("minutes"),
        _row_context().alias("meta"),
        M.source_list(F.col("hk_source_name"), F.col("hk_source_version")).alias("hk_sources"),
    ).filter(F.col("stage").isNotNull())


def explode_sources(df: DataFrame) -> DataFrame:
    """One row per element of the source array that has a name."""
    return df.withColumn("source", F.explode("hk_sources")).filter(F.col("source.name").isNotNull())


def flatten_sources(segments: DataFrame) -> DataFrame:
    """Distinct sources of a night after unpacking the arrays of its segments."""
    return (
        explode_sources(segments.select("user_id", "sleep_date", "hk_sources"))
        .groupBy("user_id", "sleep_date")
        .agg(F.array_sort(F.collect_set("source")).alias("hk_sources"))
    )


def attach_sources(nights: DataFrame, sources: DataFrame) -> DataFrame:
    """Left join of nights and their source lists; an absent list is empty."""
    return nights.join(sources, ["user_id", "sleep_date"], "left").withColumn(
        "hk_sources", F.coalesce("hk_sources", M.no_sources())
    )


def sleep_daily_from_segments(segments: DataFrame) -> DataFrame:
    """Nights recomputed from stored segments, so that both tables agree.

    Source arrays are made distinct per segment value first and unpacked inside the same
    aggregation, so segments are read and shuffled once.
    """
    return night_totals(segments, _union_sources().alias("hk_sources"))


def upsert_sleep_daily(base: DataFrame, new: DataFrame) -> DataFrame:
    """New nights replace old ones, but context and sources fall back to what was stored."""
    keys = ["user_id", "sleep_date"]
    old = base.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in base.columns if c not in keys])
    joined = new.withColumn("_new", F.lit(True)).join(old, keys, "full_outer")

    def pick(c: str):
        fresh, stored = F.col(c), F.col(f"_old_{c}")
        if c == "meta":
            fresh = F.coalesce(fresh, stored)
        if c == "hk_sources":
            fresh = F.when(F.size(fresh) > 0, fresh).otherwise(F.coalesce(stored, M.no_sources()))
        return F.when(F.col("_new"), fresh).otherwise(stored).alias(c)

    return joined.select(*keys, *[pick(c) for c in base.columns if c not in keys])
