"""Zone look-ups, localisation and joins of derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.nights import GAP
from pulseframe.catalog.registry import query
from pulseframe.catalog.shape import rounded
from pulseframe.catalog.sql import local, with_parts
from pulseframe.operators import rollup as R, sleep as S, splits as P, workouts as W, zones as N
from pulseframe.plans import analytics as Y
from pulseframe.sources import adapter as A

REQUEST = "America/New_York"


def _nights(spark, sf):
    return S.sleep_daily(S.sleep_sessions_of(S.sleep_rows(A.samples(spark, sf)), GAP))


@query("asof_timezone", with_parts(f"""SELECT hk_uuid, z AS timezone,
 CAST((epoch_us({local('ts', 'z')}) - epoch_us(ts)) // 60000000 AS INTEGER) AS utc_offset_min
 FROM (SELECT s.hk_uuid, s.ts, coalesce(CASE WHEN g.src = 'geocode' THEN g.tz END, d.tz) AS z FROM samples s
 LEFT JOIN geo g ON s.user_id = g.user_id AND s.ts >= g.since AND (g.until IS NULL OR s.ts < g.until)
 LEFT JOIN dev d ON s.user_id = d.user_id AND s.ts >= d.since AND (d.until IS NULL OR s.ts < d.until))"""))
def asof_timezone(spark, sf):
    geo, device = A.zone_history(spark, sf)
    return N.stamp_zone(A.samples(spark, sf), geo, device).select("hk_uuid", "timezone", "utc_offset_min")


def _workout_rows(spark, sf):
    """Workout rows of a result: half without metadata, some without a usable id."""
    w = W.workouts(A.workout_events(spark, sf))
    n = F.regexp_extract("workout_uuid", r"(\d+)", 1).cast("long")
    rows = w.select(
        "user_id", F.when(n % 3 != 0, F.col("workout_uuid")).alias("workout_uuid"), "start_ts", "end_ts",
        F.when(n % 2 == 0, F.col("hk_metadata")).alias("hk_metadata"),
    )
    return rows, w


@query("workout_tz", with_parts("SELECT user_id, start_ts, hk_zone AS row_tz FROM wk"))
def workout_tz(spark, sf):
    rows, w = _workout_rows(spark, sf)
    return N.workout_tz(rows, w).select("user_id", "start_ts", "row_tz")


@query("localise_workouts", with_parts(f"""SELECT user_id, workout_uuid, strftime({local('start_ts', 'z')}, '%Y-%m-%d %I:%M %p') AS start_ts,
 strftime({local('end_ts', 'z')}, '%Y-%m-%d %I:%M %p') AS end_ts, hk_zone AS event_tz
 FROM (SELECT *, coalesce(hk_zone, '{REQUEST}') AS z FROM wk)"""))
def localise_workouts(spark, sf):
    w = W.workouts(A.workout_events(spark, sf))
    rows = w.select("user_id", "workout_uuid", "start_ts", "end_ts")
    return N.localise_workouts(rows, w, REQUEST)


@query("bucket_tz", with_parts("""SELECT d.user_id, d.metric_type, d.bucket_ts,
 CASE WHEN h.user_id IS NOT NULL THEN h.meta.tz ELSE d.meta.tz END AS row_tz
 FROM daily d LEFT JOIN hourly h USING (user_id, metric_type, bucket_ts)"""))
def bucket_tz(spark, sf):
    samples = A.samples(spark, sf)
    daily = R.rollup(samples, "day")
    rows = daily.select("user_id", "metric_type", "bucket_ts")
    return N.bucket_tz(rows, R.rollup(samples, "hour"), daily)


@query("localise_rollups", with_parts(f"""SELECT user_id, metric_type, n, strftime({local('bucket_ts', 'z')}, '%Y-%m-%d %I:%M %p') AS bucket_ts, row_tz AS bucket_tz
 FROM (SELECT *, meta.tz AS row_tz, coalesce(meta.tz, '{REQUEST}') AS z FROM hourly)"""))
def localise_rollups(spark, sf):
    samples = A.samples(spark, sf)
    hourly = R.rollup(samples, "hour")
    rows = hourly.select("user_id", "metric_type", "bucket_ts", "n")
    return N.localise_rollups(rows, hourly, R.rollup(samples, "day"), REQUEST)


@query("sleep_tz", with_parts("SELECT user_id, sleep_date, asleep_minutes, meta.tz AS row_tz FROM nights"))
def sleep_tz(spark, sf):
    nights = _nights(spark, sf)
    return N.sleep_tz(nights.select("user_id", "sleep_date", "asleep_minutes"), nights)


@query("localise_sleep", with_parts(f"""SELECT user_id, sleep_date, strftime({local('sleep_start_ts', 'z')}, '%Y-%m-%d %I:%M %p') AS sleep_start_ts,
 strftime({local('sleep_end_ts', 'z')}, '%Y-%m-%d %I:%M %p') AS sleep_end_ts, meta.tz AS event_tz
 FROM (SELECT *, coalesce(meta.tz, '{REQUEST}') AS z FROM nights)"""))
def localise_sleep(spark, sf):
    nights = _nights(spark, sf)
    rows = nights.select("user_id", "sleep_date", "sleep_start_ts", "sleep_end_ts")
    return N.localise_sleep(rows, nights, REQUEST)


@query("event_tz", with_parts("SELECT user_id, ts, min(hk_zone) AS row_tz FROM wevents GROUP BY 1, 2"))
def event_tz(spark, sf):
    events = A.workout_events(spark, sf)
    return N.event_tz(events.select("user_id", "ts").distinct(), events)


@query("localise_events", with_parts(f"""SELECT user_id, hk_uuid, event_type, strftime({local('ts', 'z')}, '%Y-%m-%d %I:%M %p') AS ts, row_tz AS event_tz
 FROM (SELECT e.*, z.row_tz, coalesce(z.row_tz, '{REQUEST}') AS z
  FROM wevents e LEFT JOIN (SELECT user_id, ts, min(hk_zone) AS row_tz FROM wevents GROUP BY 1, 2) z USING (user_id, ts))"""))
def localise_events(spark, sf):
    events = A.workout_events(spark, sf)
    return N.localise_events(events.select("user_id", "hk_uuid", "event_type", "ts"), events, REQUEST)


@query("workout_splits_join", with_parts("""SELECT p.user_id, p.workout_uuid, segment_unit, segment_index, start_ts, end_ts, workout_type, distance_km
 FROM parts p JOIN wk w USING (user_id, workout_uuid)""".replace("start_ts, end_ts", "p.start_ts, p.end_ts")))
def workout_splits_join(spark, sf):
    w = W.workouts(A.workout_events(spark, sf))
    parts = P.splits(P.distance_stream(A.samples(spark, sf), w)).select(*P.SPLIT, "start_ts", "end_ts")
    return Y.workout_splits(w, parts)


CONTEXT_METRICS = ("steps", "heart_rate")


def _pivot_sql(day: str, anchor: str) -> str:
    out = []
    for m in CONTEXT_METRICS:
        for name, off in Y.OFFSETS.items():
            out.append(
                f"round(max(CASE WHEN metric_type = '{m}' AND {day} = {anchor} + ({off}) "
                f"THEN coalesce(sum_value, avg_value) END), 6) AS {m}_{name}"
            )
        out.append(f"max(CASE WHEN metric_type = '{m}' THEN unit END) AS {m}_unit")
    return ", ".join(out)


def _round_pivot(df):
    return rounded(df, *[f"{m}_{n}" for m in CONTEXT_METRICS for n in Y.OFFSETS])


@query("sleep_context_join", with_parts(f"""SELECT user_id, sleep_date, asleep_minutes, {_pivot_sql('d', 'sleep_date')}
 FROM (SELECT n.user_id, n.sleep_date, n.asleep_minutes, r.metric_type, r.unit, r.sum_value, r.avg_value, r.d FROM nights n
 LEFT JOIN (SELECT *, CAST({local('bucket_ts', "'" + REQUEST + "'")} AS DATE) AS d FROM daily WHERE metric_type IN ('steps', 'heart_rate')) r
 ON n.user_id = r.user_id AND r.d BETWEEN n.sleep_date - 1 AND n.sleep_date + 1) GROUP BY 1, 2, 3"""))
def sleep_context_join(spark, sf):
    rollups = R.rollup(A.samples(spark, sf), "day")
    return _round_pivot(Y.sleep_context(_nights(spark, sf), rollups, CONTEXT_METRICS, REQUEST))


@query("pivot_day_offsets", with_parts(f"""SELECT user_id, {_pivot_sql('d', "DATE '2024-01-10'")}
 FROM (SELECT *, CAST({local('bucket_ts', "'" + REQUEST + "'")} AS DATE) AS d FROM daily WHERE metric_type IN ('steps', 'heart_rate'))
 WHERE d BETWEEN DATE '2024-01-09' AND DATE '2024-01-11' GROUP BY 1"""))
def pivot_day_offsets(spark, sf):
    rollups = R.rollup(A.samples(spark, sf), "day")
    return _round_pivot(Y.pivot_day_offsets(rollups, "2024-01-10", CONTEXT_METRICS, REQUEST))


@query("sleep_aligned_join", with_parts(f"""SELECT n.user_id, n.sleep_date, n.asleep_minutes, n.z AS night_tz, r.metric_type, r.bucket_ts,
 round(r.sum_value, 6) AS sum_value, round(r.avg_value, 6) AS avg_value, r.n
 FROM (SELECT *, coalesce(meta.tz, '{REQUEST}') AS z FROM nights) n JOIN daily r
 ON n.user_id = r.user_id AND CAST({local('r.bucket_ts', 'n.z')} AS DATE) = n.sleep_date"""))
def sleep_aligned_join(spark, sf):
    rollups = R.rollup(A.samples(spark, sf), "day")
    return rounded(Y.sleep_aligned(_nights(spark, sf), rollups, REQUEST), "sum_value", "avg_value")
