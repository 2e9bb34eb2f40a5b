"""Row-level preparation of mirror uploads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from pulseframe import schema as S
from pulseframe.functions import clean as C, meta as M
from pulseframe.functions.metrics import is_event


def coerce_ts(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: C.to_instant(F.col(c)) for c in cols})


def coerce_num(df: DataFrame, col: str) -> DataFrame:
    """Parse numbers and drop rows without one."""
    return df.withColumn(col, C.to_number(F.col(col))).filter(F.col(col).isNotNull())


def blank_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: C.blank_to_null(F.col(c)) for c in cols})


def stamp_user(df: DataFrame, user_id: str) -> DataFrame:
    """The caller decides whose rows these are, whatever the file says."""
    return df.withColumn("user_id", F.lit(user_id))


def audit_user_ids(df: DataFrame, user_id: str) -> DataFrame:
    """Distinct user ids stated in a file that are not the caller's."""
    stated = C.strip(F.col("user_id"))
    return df.select(stated.alias("user_id")).distinct().filter(F.col("user_id") != user_id)


def retention_cutoffs(df: DataFrame, days: int = S.RETENTION_DAYS, now=None) -> DataFrame:
    """Oldest instant to keep per user, counted back from the newest row of the upload.

    An upload without any valid instant counts back from now if it has deletes;
    otherwise it has no cutoff and none of its rows survive.
    """
    now = F.current_timestamp() if now is None else now
    newest = F.max("ts")
    any_delete = F.coalesce(F.bool_or(C.is_delete(F.col("op"))), F.lit(False))
    return df.groupBy("user_id").agg(
        (F.coalesce(newest, F.when(any_delete, now)) - F.make_dt_interval(days=F.lit(days))).alias("cutoff")
    )


def retention_filter(df: DataFrame, days: int = S.RETENTION_DAYS, now=None, cutoffs: DataFrame | None = None) -> DataFrame:
    """Rows inside the retention window; deletes always stay. ``cutoffs`` are those of the rows, where
    they are known already.

    The per-user cutoffs are an aggregate with map-side combine, joined back on user;
    AQE splits the probe side where one user is large.
    """
    cut = retention_cutoffs(df, days, now) if cutoffs is None else cutoffs
    return (
        df.join(cut, "user_id")
        .filter((F.col("ts") >= F.col("cutoff")) | C.is_delete(F.col("op")))
        .select(*df.columns)
    )


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event rows and metric rows."""
    event = is_event(F.col("metric_type"))
    return df.filter(event), df.filter(~event)


def split_ops(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete rows and upsert rows."""
    delete = C.is_delete(F.col("op"))
    return df.filter(delete), df.filter(~delete)


def identity_violations(df: DataFrame) -> DataFrame:
    """Upsert rows without an id."""
    return df.filter(~C.is_delete(F.col("op")) & C.blank_to_null(F.col("hk_uuid")).isNull())


def identity_guard(df: DataFrame) -> DataFrame:
    """Fail the batch as soon as a task meets an upsert row without an id."""
    bad = ~C.is_delete(F.col("op")) & C.blank_to_null(F.col("hk_uuid")).isNull()
    return df.withColumn(
        "hk_uuid", F.when(bad, F.raise_error(F.lit("upsert row without hk_uuid"))).otherwise(F.col("hk_uuid"))
    )


def complete_rows(df: DataFrame, value: str = "metric_value", kind: str = "metric_type") -> DataFrame:
    return df.dropna(subset=["ts", kind, value])  # a NaN counts as missing


def finite_only(df: DataFrame, col: str) -> DataFrame:
    return df.filter(C.is_finite(F.col(col)))


def parse_mirror(text: DataFrame) -> DataFrame:
    """Typed mirror rows from text rows."""
    text_cols = ("user_id", "metric_type", "unit", "source", "hk_uuid", "hk_source_name",
                 "hk_source_version", "hk_metadata", "op")
    return text.select(
        *[C.blank_to_null(F.col(c)).alias(c) for c in text_cols],
        C.to_instant(F.col("timestamp")).alias("ts"),
        C.to_instant(F.col("end_ts")).alias("end_ts"),
        C.to_instant(F.col("created_at")).alias("created_at"),
        C.to_number(F.col("metric_value")).alias("metric_value"),
        M.tz_context(F.col("timezone"), F.col("utc_offset_min")).alias("meta"),
        *[c for c in ("ordinal",) if c in text.columns],
    )


def as_samples(metrics: DataFrame) -> DataFrame:
    """Sample rows of a batch ready for the merge; ends beyond the longest span are cut."""
    metrics = metrics.withColumn("end_ts", C.within_span("ts", "end_ts"))
    cols = [c for c in S.SAMPLES.fieldNames() if c != "deleted_at"]
    return complete_rows(metrics).filter(F.col("hk_uuid").isNotNull()).select(*cols, "ordinal")


def as_events(events: DataFrame) -> DataFrame:
    """Event rows of a batch ready for the merge; the zone context goes into the metadata, and ends
    beyond the longest span are cut."""
    typed = events.withColumn("end_ts", C.within_span("ts", "end_ts"))
    typed = typed.withColumnsRenamed({"metric_type": "event_type", "metric_value": "value"}).withColumn(
        "hk_metadata", M.merge_metadata(F.col("hk_metadata"), F.col("meta"))
    )
    cols = [c for c in S.EVENTS.fieldNames() if c != "deleted_at"]
    return complete_rows(typed, "value", "event_type").filter(F.col("hk_uuid").isNotNull()).select(
        *cols, "ordinal"
    )


def batch_counts(outcomes: DataFrame) -> DataFrame:
    """Rows of a batch by outcome."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def outcome(df: DataFrame) -> DataFrame:
    """What becomes of each mirror row: deleted, metric, event, dropped as incomplete, stored with its
    end cut to the longest span, or (where the row's ``cutoff`` is known) expired."""
    value = F.col("metric_value")
    complete = F.col("ts").isNotNull() & F.col("metric_type").isNotNull() & value.isNotNull() & ~F.isnan(value)
    if "user_id" in df.columns:
        complete = complete & F.col("user_id").isNotNull()
    expired = F.col("ts") < F.col("cutoff") if "cutoff" in df.columns else F.lit(False)
    cut = F.col("end_ts") > C.latest_end("ts") if "end_ts" in df.columns else F.lit(False)
    return df.withColumn(
        "outcome",
        F.when(C.is_delete(F.col("op")), "deleted")
        .when(~complete, "dropped")
        .when(expired, "expired")
        .when(cut, "cut")
        .when(is_event(F.col("metric_type")), "event")
        .otherwise("metric"),
    )
