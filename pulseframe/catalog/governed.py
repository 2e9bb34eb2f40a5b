"""The governed SQL surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.nights import GAP
from pulseframe.catalog.registry import query
from pulseframe.catalog.shape import rollup_out, rounded
from pulseframe.catalog.sql import ROLLUP_OUT, local, rebucket, with_parts
from pulseframe.operators import rollup as R, sleep as S, splits as P, workouts as W
from pulseframe.plans import views as V
from pulseframe.sources import adapter as A

USER = "7"
TZ = "America/New_York"
MINE = f"WHERE user_id = '{USER}'"


def derived_tables(spark, sf):
    samples = A.samples(spark, sf)
    rows = S.sleep_sessions_of(S.sleep_rows(samples), GAP)
    workouts = W.workouts(A.workout_events(spark, sf))
    return {
        "derived_rollup_hourly": R.rollup(samples, "hour"),
        "derived_rollup_daily": R.rollup(samples, "day"),
        "derived_sleep_daily": S.sleep_daily(rows),
        "derived_sleep_segments": S.sleep_segments(S.label_rows(rows, S.session_bounds(rows))),
        "derived_workouts": workouts,
        "derived_workout_segments": P.splits(P.distance_stream(samples, workouts)),
    }


def _session(spark, sf, user=USER):
    return V.governed_session(spark, lambda s: derived_tables(s, sf), user, TZ)


@query("view_user_scope", with_parts(f"""SELECT 'night' AS kind, user_id, CAST(sleep_date AS VARCHAR) AS item, CAST(asleep_minutes AS DOUBLE) AS amount FROM nights {MINE}
 UNION ALL SELECT 'segment', user_id, hk_uuid, CAST(minutes AS DOUBLE) FROM segs {MINE}
 UNION ALL SELECT 'workout', user_id, workout_uuid, distance_km FROM wk {MINE}
 UNION ALL SELECT 'split', user_id, workout_uuid, CAST(segment_index AS DOUBLE) FROM parts {MINE}"""))
def view_user_scope(spark, sf):
    session = _session(spark, sf)
    return session.sql("""
        SELECT 'night' AS kind, user_id, CAST(sleep_date AS STRING) AS item, asleep_minutes AS amount FROM derived_sleep_daily
        UNION ALL SELECT 'segment', user_id, hk_uuid, minutes FROM derived_sleep_segments
        UNION ALL SELECT 'workout', user_id, workout_uuid, distance_km FROM derived_workouts
        UNION ALL SELECT 'split', user_id, workout_uuid, CAST(segment_index AS DOUBLE) FROM derived_workout_segments""")


@query("view_rollup_tz", with_parts(f"SELECT {ROLLUP_OUT} FROM rb {MINE}", rb=rebucket("daily", "day", TZ)))
def view_rollup_tz(spark, sf):
    return rollup_out(_session(spark, sf).table("derived_rollup_daily"))


@query("sql_two_binds", with_parts(f"""SELECT metric_type, count(*) AS buckets, round(sum(sum_value), 6) AS total FROM rb {MINE}
 AND {local('bucket_ts', "'" + TZ + "'")} >= TIMESTAMP '2024-01-05' GROUP BY 1""", rb=rebucket("hourly", "hour", TZ)))
def sql_two_binds(spark, sf):
    rows = V.ask(
        _session(spark, sf),
        """SELECT metric_type, count(*) AS buckets, sum(sum_value) AS total FROM derived_rollup_hourly
           WHERE user_id = :user_id AND from_utc_timestamp(bucket_ts, :tz_name) >= timestamp '2024-01-05' GROUP BY metric_type""",
        USER, TZ,
    )
    return rounded(rows, "total")


@query("four_table_join", with_parts(f"""SELECT w.workout_uuid, w.workout_type, s.segment_unit, s.segment_index, n.asleep_minutes, round(r.sum_value, 6) AS steps
 FROM (SELECT * FROM wk {MINE}) w JOIN (SELECT * FROM parts {MINE}) s USING (workout_uuid)
 LEFT JOIN (SELECT * FROM nights {MINE}) n ON n.sleep_date = CAST({local('w.start_ts', "'" + TZ + "'")} AS DATE)
 LEFT JOIN (SELECT * FROM rb {MINE}) r ON r.metric_type = 'steps'
  AND CAST({local('r.bucket_ts', "'" + TZ + "'")} AS DATE) = CAST({local('w.start_ts', "'" + TZ + "'")} AS DATE)""", rb=rebucket("daily", "day", TZ)))
def four_table_join(spark, sf):
    rows = V.ask(
        _session(spark, sf),
        """SELECT w.workout_uuid, w.workout_type, s.segment_unit, s.segment_index, n.asleep_minutes, r.sum_value AS steps
           FROM derived_workouts w
           JOIN derived_workout_segments s ON s.workout_uuid = w.workout_uuid
           LEFT JOIN derived_sleep_daily n ON n.sleep_date = to_date(from_utc_timestamp(w.start_ts, :tz_name))
           LEFT JOIN derived_rollup_daily r ON r.metric_type = 'steps'
             AND to_date(from_utc_timestamp(r.bucket_ts, :tz_name)) = to_date(from_utc_timestamp(w.start_ts, :tz_name))
           WHERE w.user_id = :user_id""",
        USER, TZ,
    )
    return rounded(rows, "steps")


@query("post_filter", with_parts("SELECT * FROM (SELECT count(*) AS buckets, max(max_value) AS peak FROM hourly) WHERE buckets > 10"))
def post_filter(spark, sf):
    totals = R.rollup(A.samples(spark, sf), "hour").agg(
        F.count(F.lit(1)).alias("buckets"), F.max("max_value").alias("peak")
    )
    return V.post_filter(totals, F.col("buckets") > 10)


@query("calendar_spine", with_parts("""SELECT c.step_ts, count(s.hk_uuid) AS n FROM (SELECT unnest(generate_series(
 (SELECT date_trunc('day', min(ts)) FROM ev), (SELECT date_trunc('day', max(ts)) FROM ev), INTERVAL 1 DAY)) AS step_ts) c
 LEFT JOIN samples s ON date_trunc('day', s.ts) = c.step_ts GROUP BY 1"""))
def calendar_spine(spark, sf):
    samples = A.samples(spark, sf)
    bounds = A.events(spark, sf).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spine = bounds.select(V.calendar_days(F.col("lo"), F.col("hi")).alias("step_ts"))
    per_day = samples.groupBy(F.date_trunc("day", "ts").alias("step_ts")).agg(F.count("hk_uuid").alias("n"))
    return spine.join(per_day, "step_ts", "left").select("step_ts", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("governed_arrays", with_parts(f"""SELECT 'day' AS kind, CAST(c.d AS VARCHAR) AS item, count(r.metric_type) AS n
 FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS d) c
 LEFT JOIN (SELECT * FROM rb {MINE}) r ON CAST({local('r.bucket_ts', "'" + TZ + "'")} AS DATE) = c.d GROUP BY ALL
 UNION ALL SELECT 'part', p, count(*) FROM (SELECT unnest(string_split(workout_uuid, '-')) AS p FROM wk {MINE}) GROUP BY ALL
 UNION ALL SELECT 'attribute', a, count(*) FROM (SELECT unnest(['km ' || workout_type, 'kcal ' || workout_type]) AS a FROM wk {MINE}) GROUP BY ALL""",
    rb=rebucket("daily", "day", TZ)))
def governed_arrays(spark, sf):
    """Ad-hoc texts with a calendar, an array as a lateral table, and an expanded array column."""
    session = _session(spark, sf)
    texts = [
        """SELECT 'day' AS kind, CAST(to_date(c.value) AS STRING) AS item, count(r.metric_type) AS n
           FROM generate_series(timestamp'2024-01-01', timestamp'2024-02-05') c LEFT JOIN derived_rollup_daily r
           ON to_date(from_utc_timestamp(r.bucket_ts, :tz_name)) = to_date(c.value) AND r.user_id = :user_id GROUP BY 2""",
        """SELECT 'part' AS kind, u.value AS item, count(*) AS n
           FROM derived_workouts w, LATERAL unnest(split(w.workout_uuid, '-')) u WHERE w.user_id = :user_id GROUP BY 2""",
        """SELECT 'attribute' AS kind, a AS item, count(*) AS n FROM derived_workouts
           LATERAL VIEW explode(array('km ' || workout_type, 'kcal ' || workout_type)) t AS a WHERE user_id = :user_id GROUP BY 2""",
    ]
    rows = [V.ask(session, text, USER, TZ) for text in texts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
