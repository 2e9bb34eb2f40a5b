"""Ingest of one batch of mirror rows into raw and derived tables.

Everything the batch changes is described by the hours of each user it touches: raw facts are
merged on the days of these, and derived tables are recomputed on the days around them. What is read
and replaced are parts, one day of one bucket of users each. Where replaced and deleted rows lie is
looked up in locators; no stored table is read beyond the parts that are found.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe import schema as S
from pulseframe.operators import clean as O, merge as G, rollup as R, sleep as L, splits as P, workouts as W
from pulseframe.operators.timeline import fit_width
from pulseframe.session import measured_joins
from pulseframe.sources.mirror_csv import with_optional_columns
from pulseframe.sources.tables import BUCKETS, Locator, Part, bucket_of, on_parts, parts_of, read_table, remove, rewrite_parts


@dataclass(frozen=True)
class Store:
    """Table folders under one root, which must be shared by all executors. ``buckets`` of users is
    fixed for the life of the store."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path(name), TABLES[name][0])

    def locator(self, name: str) -> Locator:
        """Where rows of raw facts lie by their ids; where workouts and their splits lie."""
        return Locator(self.spark, f"{self.root}/_keys/{name}", "workout_uuid" if name == "workouts" else "hk_uuid", self.buckets)

    def parts(self, df: DataFrame, day: Column | str = "day") -> set[Part]:
        return parts_of(df, day, self.buckets)

    def rewrite(self, name: str, parts: set[Part], change) -> None:
        schema, day_col, sort = TABLES[name]
        rewrite_parts(self.spark, self.path(name), schema, parts, day_col, sort, change, self.buckets)


# table -> schema, column that gives the day, sort key
TABLES = {
    "samples": (S.SAMPLES, "ts", G.SAMPLE_KEYS),
    "events": (S.EVENTS, "ts", G.EVENT_KEYS),
    "rollup_hourly": (S.ROLLUP, "bucket_ts", R.BUCKET),
    "rollup_daily": (S.ROLLUP, "bucket_ts", R.BUCKET),
    "sleep_daily": (S.NIGHTS, "sleep_date", ("user_id", "sleep_date")),
    "sleep_segments": (S.SEGMENTS, "sleep_date", ("user_id", "hk_uuid")),
    "workouts": (S.WORKOUTS, "start_ts", W.WORKOUT),
    "workout_splits": (S.SPLITS, "workout_start_ts", P.SPLIT),
}


def apply_batch(
    store: Store, text: DataFrame, batch_id: str, at: Column | None = None,
    user_id: str | None = None, retention_days: int = S.RETENTION_DAYS, sleep_gap_s: float = L.GAP_S,
) -> DataFrame:
    """Ingest text rows and refresh everything derived from them; returns counts by outcome.

    Replaying a batch gives the same tables, as a stream may do after a failure.
    """
    with measured_joins(store.spark):
        return _apply_batch(store, text, batch_id, F.current_timestamp() if at is None else at, user_id, retention_days, sleep_gap_s)


def _apply_batch(store, text, batch_id, at, user_id, retention_days, sleep_gap_s) -> DataFrame:
    parsed, cutoffs = _prepare(store, text, batch_id, user_id, retention_days, at)
    rows = O.retention_filter(parsed, retention_days, at, cutoffs)
    deletes, upserts = O.split_ops(rows)
    event_rows, metric_rows = O.route(upserts)
    # each is read many times below
    kept = lambda df, name: _kept(store, df, f"_staging/{batch_id}/{name}")
    ids = kept(G.deleted_ids(deletes), "deleted")
    events, samples = kept(O.as_events(event_rows), "new_events"), kept(O.as_samples(metric_rows), "new_samples")
    gone = G.deleted_workouts(ids)
    flags = gone.withColumn("f", F.explode(F.array(*[F.lit(f) for f in S.LEGACY_FLAGS]))).select(
        "user_id", F.concat_ws("|", "workout_uuid", "f").alias("hk_uuid")
    )
    # what is touched depends on the stored rows as they were; a replay after a partial attempt
    # finds them changed already, so the first complete answer of a batch stands
    places = store.locator("samples").parts(_keys(samples, ids))
    hours = _kept(store, G.touched_hours(samples, on_parts(store.read("samples"), places), ids), f"_staging/{batch_id}/hours", once=True)
    windows = hours.groupBy("user_id").agg(F.min("hour").alias("t_min"), (F.max("hour") + F.expr("interval 1 hour")).alias("t_max"))
    _together(
        store,
        lambda: _merge_raw(store, "events", events, ids.union(flags), cutoffs, at, G.merge_events),
        lambda: _merge_raw(store, "samples", samples, ids, cutoffs, at, G.merge_samples, places),
    )
    # raw facts are in place; the derived tables do not depend on each other
    _together(
        store,
        lambda: _refresh_rollup(store, hours, "rollup_hourly", "hour"),
        lambda: _refresh_rollup(store, hours, "rollup_daily", "day"),
        lambda: _refresh_sleep(store, hours, sleep_gap_s),
        lambda: _refresh_workouts(store, events, gone, hours, windows, batch_id),
    )
    counts = O.batch_counts(O.outcome(parsed.join(cutoffs, "user_id", "left")))
    rows = [tuple(r) for r in counts.collect()]  # one row an outcome
    _finish(store, batch_id)
    return store.spark.createDataFrame(rows, counts.schema)


def apply_samples(store: Store, changes: DataFrame, batch_id: str, units: dict[str, str] | None = None) -> None:
    """Merge changed samples (a ``deleted_at`` deletes) and refresh the rollups they touch.

    ``ordinal`` orders the versions of one sample; without it the latest ``created_at`` counts.
    """
    with measured_joins(store.spark):
        _apply_samples(store, changes, batch_id, units)


def _apply_samples(store: Store, changes: DataFrame, batch_id: str, units: dict[str, str] | None) -> None:
    if "ordinal" not in changes.columns:
        changes = changes.withColumn("ordinal", F.struct(F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp")), "ts"))
    last = F.max_by(F.struct(*changes.columns), "ordinal").alias("row")
    latest = _kept(store, changes.groupBy(*G.SAMPLE_KEYS).agg(last).select("row.*"), f"_staging/{batch_id}/changes", once=True)
    dead, live = latest.filter("deleted_at IS NOT NULL"), latest.filter("deleted_at IS NULL")
    places = store.locator("samples").parts(_keys(live, dead))
    hours = _kept(store, G.touched_hours(live, on_parts(store.read("samples"), places), dead), f"_staging/{batch_id}/hours", once=True)
    _merge_raw(store, "samples", live, dead.select("user_id", "hk_uuid"), None, F.current_timestamp(), G.merge_samples, places)
    units = units or {"rollup_hourly": "hour", "rollup_daily": "day"}
    _together(store, *(lambda n=n, u=u: _refresh_rollup(store, hours, n, u) for n, u in units.items()))
    _finish(store, batch_id)


def _together(store: Store, *steps: Callable[[], None]) -> None:
    """Run independent steps at once, so that their jobs share the cluster; the first error is raised."""
    with ThreadPoolExecutor(len(steps)) as pool:
        for done in [pool.submit(inheritable_thread_target(store.spark)(step)) for step in steps]:
            done.result()


def _folder(store: Store, path: str):
    """Spark's own view of a folder in whatever file system the store is."""
    at = store.spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(store.spark._jsc.hadoopConfiguration())


def _finish(store: Store, batch_id: str) -> None:
    remove(store.spark, store.path(f"_staging/{batch_id}"))
    for name in ("samples", "events", "workouts"):
        store.locator(name).compact()


def _keys(*rows: DataFrame) -> DataFrame:
    """Ids of rows, each once."""
    return reduce(DataFrame.union, (r.select("user_id", "hk_uuid") for r in rows)).distinct()


def _kept(store: Store, df: DataFrame, name: str, once: bool = False) -> DataFrame:
    """Written and read back: later steps must not depend on tables they change. With ``once`` a
    complete earlier answer is taken instead."""
    path = store.path(name)
    done, files = _folder(store, f"{path}/_SUCCESS")
    if not (once and files.exists(done)):
        df.write.mode("overwrite").parquet(path)
    return store.spark.read.schema(df.schema).parquet(path)


def _prepare(store, text, batch_id, user_id, retention_days, at) -> tuple[DataFrame, DataFrame]:
    """Typed rows of the batch and the retention cutoff of each user."""
    full = with_optional_columns(text)
    if user_id is not None:
        full = O.stamp_user(full, user_id)
    parsed = _kept(store, O.identity_guard(O.parse_mirror(full)), f"_staging/{batch_id}/rows")
    cutoffs = _kept(store, O.retention_cutoffs(parsed, retention_days, at), f"_staging/{batch_id}/cutoffs")
    return parsed, cutoffs


def _merge_raw(store, name, batch, ids, cutoffs, at, merge, places=None) -> None:
    """Prune, tombstone, then upsert, all in one rewrite of the affected parts; what has nothing to do
    costs no join of the stored rows. ``places`` are the parts of the keys, where known already."""
    locator = store.locator(name)
    new, dead, oldest_kept = not batch.isEmpty(), not ids.isEmpty(), None
    places = locator.parts(_keys(ids, batch)) if places is None and (new or dead) else places
    parts = (places or set()) | (store.parts(batch, F.to_date("ts")) if new else set())
    if cutoffs is not None:
        oldest_kept = cutoffs.agg(F.max(F.to_date("cutoff"))).first()[0]
        buckets = sorted(r[0] for r in cutoffs.select(bucket_of(buckets=store.buckets)).distinct().collect())
        # only days up to the newest cutoff, of the users of the batch, can hold expired rows
        old = store.read(name).filter((F.col("day") <= F.lit(oldest_kept)) & F.col("user_bucket").isin(*buckets))
        parts |= store.parts(old.join(cutoffs, "user_id").filter(F.col("ts") < F.col("cutoff")))
    if new:
        locator.add(batch, "ts")
    # rows of a day after that of the newest cutoff are not expired
    expiring = oldest_kept is not None and any(day <= oldest_kept for day, _ in parts)

    def change(base: DataFrame) -> DataFrame:
        base = G.prune(base, cutoffs) if expiring else base
        base = G.tombstone(base, ids, at) if dead else base
        return merge(base, batch, whole=True) if new else base

    store.rewrite(name, parts, change)


def _dates(hours: DataFrame, before: int = 0, after: int = 0, name: str = "day") -> DataFrame:
    """Users and the days around their touched hours."""
    near = F.array(*(F.date_add(F.to_date("hour"), i) for i in range(-before, after + 1)))
    return hours.select("user_id", F.explode(near).alias(name)).distinct()


def _refresh_rollup(store: Store, hours: DataFrame, name: str, unit: str) -> None:
    parts = store.parts(_dates(hours))
    samples = on_parts(store.read("samples"), parts).drop("day", "user_bucket")
    store.rewrite(name, parts, lambda base: G.refresh_buckets(base, samples, hours, unit))


def _refresh_sleep(store: Store, hours: DataFrame, gap_s: float) -> None:
    """Recompute the nights around changed samples: nights are written from one day before to two
    days after a touched day, and rows are read two days further to either side."""
    dates, reach = _dates(hours, 1, 2, "sleep_date"), _dates(hours, 3, 4)
    writes, reads = store.parts(dates, "sleep_date"), store.parts(reach)
    if not writes:
        return
    near = on_parts(store.read("samples"), reads).join(reach, ["user_id", "day"], "left_semi").drop("day", "user_bucket")

    def touched(df: DataFrame) -> DataFrame:
        return df.join(dates, ["user_id", "sleep_date"], "left_semi")

    def others(df: DataFrame) -> DataFrame:
        return df.join(dates, ["user_id", "sleep_date"], "left_anti")

    width_s = fit_width(L.sleep_rows(near), ["user_id"], "segment_start_ts")
    fresh = touched(L.sleep_segments(L.label_sleep(near, gap_s, width_s)))
    store.rewrite("sleep_segments", writes, lambda base: others(base).unionByName(fresh.select(*S.SEGMENTS.fieldNames())))
    stored = on_parts(store.read("sleep_segments"), writes).drop("day", "user_bucket")
    nights = L.sleep_daily_from_segments(touched(stored)).select(*S.NIGHTS.fieldNames())

    def change(base: DataFrame) -> DataFrame:
        # a stored night survives only if it still has segments, or lies outside the window
        old = base.join(nights.select("user_id", "sleep_date"), ["user_id", "sleep_date"], "left_semi")
        return others(base).unionByName(L.upsert_sleep_daily(old, nights))

    store.rewrite("sleep_daily", writes, change)


def _refresh_workouts(store, upserted, gone, hours, windows, batch_id) -> None:
    places = store.locator("workouts")
    starts = on_parts(store.read("events"), store.parts(_dates(hours, 0, 4)))
    # a workout under way began at most the longest span before
    running = on_parts(store.read("workouts"), store.parts(_dates(hours, S.MAX_SPAN_DAYS + 1)))
    touched = _kept(
        store, G.touched_workouts(starts, upserted.select("user_id", "hk_uuid"), windows, stored=running),
        f"_staging/{batch_id}/touched",
    )
    ids = touched.select("user_id", F.col("workout_uuid").alias("hk_uuid"))
    events = on_parts(store.read("events"), store.locator("events").parts(ids)).drop("day", "user_bucket")
    mine = W.split_workout_id(events).join(touched, list(W.WORKOUT), "left_semi").select(*events.columns)
    new = _kept(store, W.workouts(mine).select(*S.WORKOUTS.fieldNames()), f"_staging/{batch_id}/new_workouts")
    changed = new.select(*W.WORKOUT).union(gone).distinct()

    # splits lie on the day of their workout's start, so one locator serves both
    parts = places.parts(changed) | store.parts(new, F.to_date("start_ts"))
    if not parts:
        return
    places.add(new, "start_ts")
    store.rewrite("workouts", parts, lambda base: W.upsert_workouts(G.cascade_delete(base, gone), new))
    days = F.sequence(F.to_date("start_ts"), F.to_date(F.coalesce("end_ts", "start_ts")), F.expr("interval 1 day"))
    samples = on_parts(store.read("samples"), store.parts(new.select("user_id", F.explode(days).alias("day"))))
    bare = _kept(store, P.splits(P.distance_stream(samples, new)), f"_staging/{batch_id}/splits")  # read twice below
    measured = P.split_measures(bare, samples).select(*S.SPLITS.fieldNames())
    store.rewrite("workout_splits", parts, lambda base: G.replace_splits(base, measured, changed))
