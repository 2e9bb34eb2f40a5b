"""Keyed merges, tombstones and slice maintenance of stored tables.

Stored tables are large and batches are small: rows that a batch does not touch pass an
anti join, and only the touched ones meet the batch. While the key set is under the
session's broadcast threshold, stored rows stay in place; beyond it Spark sort-merges, and
both sides are shuffled by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe import schema as S
from pulseframe.functions.clean import blank_to_null
from pulseframe.functions.metrics import is_sleep
from pulseframe.operators.rollup import rollup
from pulseframe.operators.workouts import split_workout_id

SAMPLE_KEYS = ("user_id", "hk_uuid")
SAMPLE_OVERWRITE = ("ts", "metric_type", "metric_value", "meta", "deleted_at")
SAMPLE_KEEP = ("end_ts", "unit", "created_at", "hk_source_name", "hk_source_version", "hk_metadata")
EVENT_KEYS = ("user_id", "hk_uuid", "event_type")
EVENT_OVERWRITE = ("ts", "value", "deleted_at")
EVENT_KEEP = (
    "end_ts", "unit", "source", "created_at", "hk_source_name", "hk_source_version", "hk_metadata",
)


def merge_by_policy(
    base: DataFrame, batch: DataFrame, keys: Sequence[str], overwrite: Sequence[str],
    keep: Sequence[str], ordinal: str = "ordinal", whole: bool = False,
) -> DataFrame:
    """Upsert of a batch, row by row in order of ``ordinal`` (any orderable type).

    ``overwrite`` columns take the last row's value even when NULL; ``keep`` columns
    take the last non-NULL value. With ``whole`` all of ``base``, which then must have one row a
    key, is shuffled by key once and meets the batch there: for batches that touch much of it.
    """
    cols = [*keys, *overwrite, *keep]
    if whole:
        return _merge_whole(base.select(*cols), batch, keys, overwrite, keep, ordinal)
    touched_keys = batch.select(*keys).distinct()
    untouched = base.join(touched_keys, list(keys), "left_anti").select(*cols)
    touched = base.join(touched_keys, list(keys), "left_semi").select(*cols, F.lit(0).alias("_new"))
    fresh = batch.select(*cols, F.lit(1).alias("_new"), F.col(ordinal).alias("_ord"))
    order = F.struct("_new", "_ord")
    merged = (
        touched.unionByName(fresh, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(
            F.max_by(F.struct(*overwrite), order).alias("_last"),
            *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in keep],
        )
        .select(*keys, "_last.*", *keep)
    )
    return untouched.unionByName(merged.select(*cols))


def _merge_whole(base, batch, keys, overwrite, keep, ordinal) -> DataFrame:
    order = F.col(ordinal)
    new = batch.groupBy(*keys).agg(
        F.max_by(F.struct(*overwrite), order).alias("_last"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in keep],
        F.lit(True).alias("_hit"),
    )
    return base.join(new, list(keys), "full_outer").select(
        *keys,
        *[F.when(F.col("_hit"), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c) for c in overwrite],
        *[F.coalesce(f"_{c}", c).alias(c) for c in keep],
    )


def merge_samples(base: DataFrame, batch: DataFrame, whole: bool = False) -> DataFrame:
    """Upsert of samples; a sample that comes back loses its tombstone."""
    live = batch.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return merge_by_policy(base, live, SAMPLE_KEYS, SAMPLE_OVERWRITE, SAMPLE_KEEP, whole=whole)


def merge_events(base: DataFrame, batch: DataFrame, whole: bool = False) -> DataFrame:
    """Upsert of workout and event attributes."""
    live = batch.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return merge_by_policy(base, live, EVENT_KEYS, EVENT_OVERWRITE, EVENT_KEEP, whole=whole)


def deleted_ids(batch: DataFrame) -> DataFrame:
    """Distinct usable ids of the delete rows of a batch."""
    return (
        batch.select("user_id", blank_to_null(F.col("hk_uuid")).alias("hk_uuid"))
        .filter(F.col("hk_uuid").isNotNull())
        .distinct()
    )


def tombstone(base: DataFrame, ids: DataFrame, at: Column, only_live: bool = False) -> DataFrame:
    """Mark rows with a listed id as deleted."""
    marks = ids.select("user_id", "hk_uuid").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    if only_live:
        hit = hit & F.col("deleted_at").isNull()
    return (
        base.join(marks, ["user_id", "hk_uuid"], "left")
        .withColumn("deleted_at", F.when(hit, at).otherwise(F.col("deleted_at")))
        .select(*base.columns)
    )


def prune(base: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Drop stored rows older than the cutoff of their user; users without one keep all."""
    return (
        base.join(cutoffs.select("user_id", "cutoff"), "user_id", "left")
        .filter(F.col("cutoff").isNull() | (F.col("ts") >= F.col("cutoff")))
        .select(*base.columns)
    )


def deleted_workouts(ids: DataFrame) -> DataFrame:
    """Workouts named by deleted composite ids."""
    return (
        split_workout_id(ids)
        .filter(F.col("workout_uuid").isNotNull())
        .select("user_id", "workout_uuid")
        .distinct()
    )


def cascade_delete(derived: DataFrame, workout_ids: DataFrame) -> DataFrame:
    """Derived workout or split rows without those of deleted workouts."""
    return derived.join(workout_ids, ["user_id", "workout_uuid"], "left_anti")


def cascade_flags(events: DataFrame, workout_ids: DataFrame, at: Column) -> DataFrame:
    """Tombstone the old flag rows of deleted workouts."""
    flags = workout_ids.withColumn("_flag", F.explode(F.array(*[F.lit(f) for f in S.LEGACY_FLAGS])))
    ids = flags.select("user_id", F.concat_ws("|", "workout_uuid", "_flag").alias("hk_uuid"))
    return tombstone(events, ids, at, only_live=True)


def touched_hours(batch: DataFrame, base: DataFrame, ids: DataFrame) -> DataFrame:
    """Hours of each user in which something changes: where rows of the batch lie, where the rows
    they replace lay, and where deleted rows lay. Exactly these, not the span between them."""
    keys = ids.select("user_id", "hk_uuid").union(batch.select("user_id", "hk_uuid")).distinct()
    old = base.join(keys, ["user_id", "hk_uuid"], "left_semi")
    hour = F.date_trunc("hour", "ts").alias("hour")
    return batch.select("user_id", hour).union(old.select("user_id", hour)).filter(F.col("hour").isNotNull()).distinct()


def refresh_buckets(rollups: DataFrame, samples: DataFrame, hours: DataFrame, unit: str) -> DataFrame:
    """The buckets of the touched hours computed again, all others as they are."""
    buckets = hours.select("user_id", F.date_trunc(unit, "hour").alias("bucket_ts")).distinct()
    mine = samples.withColumn("bucket_ts", F.date_trunc(unit, "ts")).join(buckets, ["user_id", "bucket_ts"], "left_semi")
    kept = rollups.join(buckets, ["user_id", "bucket_ts"], "left_anti").filter(~is_sleep(F.col("metric_type")))
    return kept.unionByName(rollup(mine.select(*samples.columns), unit))


def affected_window(batch: DataFrame, base: DataFrame, ids: DataFrame) -> DataFrame:
    """Per user: first and last instant a batch affects, widened by stored rows that it deletes
    and by the stored instants of rows that it moves."""
    own = batch.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    keys = ids.select("user_id", "hk_uuid").union(batch.select("user_id", "hk_uuid"))
    stored = (
        base.join(keys.distinct(), ["user_id", "hk_uuid"], "left_semi")
        .groupBy("user_id")
        .agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    )
    return (
        own.unionByName(stored)
        .groupBy("user_id")
        .agg(F.min("lo").alias("t_min"), F.max("hi").alias("t_max"))
        .filter(F.col("t_min").isNotNull())
    )


def align_window(windows: DataFrame, unit: str) -> DataFrame:
    """Whole buckets that cover a window: ``[t0, t1)``."""
    step = F.expr(f"interval 1 {unit}")
    return windows.select(
        "user_id",
        F.date_trunc(unit, "t_min").alias("t0"),
        (F.date_trunc(unit, "t_max") + step).alias("t1"),
    )


def in_window(df: DataFrame, windows: DataFrame, ts: str) -> DataFrame:
    """Rows whose instant lies in the window of their user (one window per user)."""
    return (
        df.join(windows.select("user_id", "t0", "t1"), "user_id")
        .filter((F.col(ts) >= F.col("t0")) & (F.col(ts) < F.col("t1")))
        .select(*df.columns)
    )


def outside_window(df: DataFrame, windows: DataFrame, ts: str) -> DataFrame:
    return (
        df.join(windows.select("user_id", "t0", "t1"), "user_id", "left")
        .filter(F.col("t0").isNull() | (F.col(ts) < F.col("t0")) | (F.col(ts) >= F.col("t1")))
        .select(*df.columns)
    )


def refresh_rollup(rollups: DataFrame, samples: DataFrame, windows: DataFrame, unit: str) -> DataFrame:
    """Recompute the affected buckets and leave all others as they are.

    Affected buckets are replaced whole: a bucket that lost its last sample goes, and
    unit changes come through.
    """
    aligned = align_window(windows, unit)
    fresh = rollup(in_window(samples, aligned, "ts"), unit)
    kept = outside_window(rollups, aligned, "bucket_ts").filter(~is_sleep(F.col("metric_type")))
    return kept.unionByName(fresh)


def touched_workouts(
    events: DataFrame, upserted: DataFrame, windows: DataFrame, hours: int = 72,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Workouts to derive again: those in the batch and those that start near changed samples.

    With the ``stored`` workout table, also those already under way when the window opens;
    otherwise a late sample in the middle of a workout would not reach its splits.
    """
    wide = windows.select(
        "user_id",
        F.col("t_min").alias("t0"),
        (F.col("t_max") + F.make_dt_interval(hours=F.lit(hours))).alias("t1"),
    )
    near = in_window(
        events.filter(F.col("deleted_at").isNull() & (F.col("event_type") == "workout_duration_min")),
        wide, "ts",
    )
    named = split_workout_id(upserted).filter("touches")
    both = named.select("user_id", "workout_uuid").union(
        split_workout_id(near).select("user_id", "workout_uuid")
    )
    if stored is not None:
        running = stored.join(windows, "user_id").filter(
            (F.col("start_ts") <= F.col("t_max")) & (F.coalesce("end_ts", "start_ts") >= F.col("t_min"))
        )
        both = both.union(running.select("user_id", "workout_uuid"))
    return both.filter(F.col("workout_uuid").isNotNull()).distinct()


def replace_splits(base: DataFrame, new: DataFrame, workout_ids: DataFrame) -> DataFrame:
    """Splits of the listed workouts replaced by new ones."""
    return cascade_delete(base, workout_ids).unionByName(new.select(*base.columns))


def backfill_sources(df: DataFrame) -> DataFrame:
    """Fill an absent source array from the single source columns."""
    from pulseframe.functions.meta import source_list

    one = source_list(F.col("hk_source_name"), F.col("hk_source_version"))
    return df.withColumn("hk_sources", F.coalesce("hk_sources", one))


def backfill_from_json(df: DataFrame, text: str, mapping: dict[str, str]) -> DataFrame:
    """Promote attributes of a JSON column into columns that are still NULL."""
    return df.withColumns(
        {c: F.coalesce(c, F.get_json_object(text, path)) for c, path in mapping.items()}
    )
