"""Sleep: sessions, nights, segments; and window functions over timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.registry import query
from pulseframe.catalog.shape import nested_as_json, night_out, rounded
from pulseframe.catalog.sql import NIGHT_OUT, meta_json, sessions, with_parts
from pulseframe.functions import meta as M, metrics
from pulseframe.operators import ranking as K, sleep as S, timeline as T
from pulseframe.sources import adapter as A

GAP = 24 * 3_600  # the test stream is sparse, so nights are told apart by a day


def _labelled(spark, sf):
    return S.label_sleep(A.samples(spark, sf), GAP)


@query("prev_end", with_parts(
    "SELECT user_id, hk_uuid, segment_start_ts, prev_end FROM two", two=sessions("2 HOUR")))
def prev_end(spark, sf):
    rows = S.sleep_rows(A.samples(spark, sf))
    out = T.previous(rows, ["user_id"], "segment_start_ts", ["hk_uuid"], {"prev_end": "segment_end_ts"})
    return out.select("user_id", "hk_uuid", "segment_start_ts", "prev_end")


@query("sessionize", with_parts(
    "SELECT user_id, hk_uuid, prev_end, CAST(session_id AS BIGINT) AS session_id FROM two", two=sessions("2 HOUR")))
def sessionize(spark, sf):
    rows = S.sleep_sessions_of(S.sleep_rows(A.samples(spark, sf)))
    return rows.select("user_id", "hk_uuid", "prev_end", "session_id")


@query("sleep_sessions", with_parts(
    "SELECT user_id, CAST(session_id AS BIGINT) AS session_id, session_start_ts, session_end_ts, session_tz FROM bounds"))
def sleep_sessions(spark, sf):
    return S.session_bounds(S.sleep_sessions_of(S.sleep_rows(A.samples(spark, sf)), GAP))


@query("session_label", with_parts("""SELECT s.user_id, s.hk_uuid, CAST(s.session_id AS BIGINT) AS session_id, b.session_start_ts, b.session_end_ts
 FROM sess s JOIN bounds b USING (user_id, session_id)"""))
def session_label(spark, sf):
    rows = S.sleep_sessions_of(S.sleep_rows(A.samples(spark, sf)), GAP)
    bounds = S.session_bounds(rows)
    return rows.join(bounds, ["user_id", "session_id"]).select(
        "user_id", "hk_uuid", "session_id", "session_start_ts", "session_end_ts"
    )


@query("sleep_labelled", with_parts("""SELECT user_id, hk_uuid, metric_type, segment_start_ts, segment_end_ts,
 CAST(session_id AS BIGINT) AS session_id, sleep_date FROM labelled"""))
def sleep_labelled(spark, sf):
    return _labelled(spark, sf).select(
        "user_id", "hk_uuid", "metric_type", "segment_start_ts", "segment_end_ts", "session_id", "sleep_date"
    )


@query("sleep_segments", with_parts(f"""SELECT user_id, hk_uuid, sleep_date, stage, segment_start_ts, segment_end_ts, minutes,
 {meta_json('m_tz', 'm_off')} AS meta, CAST(to_json(hk_sources) AS VARCHAR) AS hk_sources FROM segs"""))
def sleep_segments(spark, sf):
    return nested_as_json(S.sleep_segments(_labelled(spark, sf)))


@query("sleep_daily", with_parts(f"SELECT {NIGHT_OUT} FROM nights"))
def sleep_daily(spark, sf):
    return night_out(S.sleep_daily(S.sleep_sessions_of(S.sleep_rows(A.samples(spark, sf)), GAP)))


@query("sleep_daily_reconciled", with_parts(f"SELECT {NIGHT_OUT} FROM nights_seg"))
def sleep_daily_reconciled(spark, sf):
    return night_out(S.sleep_daily_from_segments(S.sleep_segments(_labelled(spark, sf))))


@query("flatten_sources", with_parts(
    "SELECT user_id, sleep_date, CAST(to_json(hk_sources) AS VARCHAR) AS hk_sources FROM nights_seg WHERE len(hk_sources) > 0"))
def flatten_sources(spark, sf):
    return nested_as_json(S.flatten_sources(S.sleep_segments(_labelled(spark, sf))))


@query("left_join_sources", with_parts(
    "SELECT user_id, sleep_date, round(asleep_minutes, 6) AS asleep_minutes, CAST(to_json(hk_sources) AS VARCHAR) AS hk_sources FROM nights_seg"))
def left_join_sources(spark, sf):
    segments = S.sleep_segments(_labelled(spark, sf))
    joined = S.attach_sources(S.night_totals(segments), S.flatten_sources(segments))
    return nested_as_json(rounded(joined, "asleep_minutes")).select(
        "user_id", "sleep_date", "asleep_minutes", "hk_sources"
    )


@query("lateral_sources", with_parts("""SELECT user_id, hk_uuid, hk_sources[1].name AS name, hk_sources[1].version AS version
 FROM segs WHERE len(hk_sources) > 0"""))
def lateral_sources(spark, sf):
    rows = S.explode_sources(S.sleep_segments(_labelled(spark, sf)))
    return rows.select("user_id", "hk_uuid", "source.name", "source.version")


def _split_history(nights):
    """Stored nights (older minutes, some without context) and the new ones."""
    odd = F.dayofmonth("sleep_date") % 2 == 1
    base = nights.filter(odd).withColumn("asleep_minutes", F.col("asleep_minutes") + 1)
    third = F.dayofmonth("sleep_date") % 3 == 0
    new = nights.filter(F.dayofmonth("sleep_date") % 5 != 0).withColumns(
        {
            "meta": F.when(~third, F.col("meta")),
            "hk_sources": F.when(third, M.no_sources()).otherwise(F.col("hk_sources")),
        }
    )
    return base, new


@query("upsert_sleep_daily", with_parts(f"""SELECT user_id, sleep_date,
 CASE WHEN d % 5 <> 0 THEN asleep_minutes ELSE asleep_minutes + 1 END AS asleep_minutes,
 CASE WHEN d % 5 <> 0 AND d % 3 <> 0 OR d % 2 = 1 THEN {meta_json('meta.tz', 'meta.off')} END AS meta,
 CASE WHEN d % 5 <> 0 AND d % 3 <> 0 OR d % 2 = 1 THEN CAST(to_json(hk_sources) AS VARCHAR) ELSE '[]' END AS hk_sources
 FROM (SELECT *, day(sleep_date) AS d FROM nights) WHERE d % 5 <> 0 OR d % 2 = 1"""))
def upsert_sleep_daily(spark, sf):
    nights = S.sleep_daily(S.sleep_sessions_of(S.sleep_rows(A.samples(spark, sf)), GAP))
    base, new = _split_history(nights)
    return nested_as_json(S.upsert_sleep_daily(base, new)).select(
        "user_id", "sleep_date", "asleep_minutes", "meta", "hk_sources"
    )


@query("stage_label", with_parts("""SELECT hk_uuid, CASE WHEN metric_type LIKE 'sleep_%' THEN
 regexp_replace(metric_type, '^sleep_(.*)_minutes$', '\\1') END AS stage FROM samples"""))
def stage_label(spark, sf):
    return A.samples(spark, sf).select("hk_uuid", metrics.stage_label(F.col("metric_type")).alias("stage"))


@query("sleep_stage_metric", with_parts("""SELECT event_id, CASE k % 8 WHEN 0 THEN 'sleep_in_bed_minutes' WHEN 2 THEN 'sleep_awake_minutes'
 WHEN 3 THEN 'sleep_core_minutes' WHEN 4 THEN 'sleep_deep_minutes' WHEN 5 THEN 'sleep_rem_minutes'
 ELSE 'sleep_asleep_unspecified_minutes' END AS metric_type FROM ev"""))
def sleep_stage_metric(spark, sf):
    return A.events(spark, sf).select(
        "event_id", metrics.sleep_stage_metric(F.col("k") % 8).alias("metric_type")
    )


# --- windows over other timelines -------------------------------------------------

@query("trailing_count", with_parts("""SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts
 RANGE BETWEEN INTERVAL 59999999 MICROSECOND PRECEDING AND CURRENT ROW) - 1 AS trailing FROM ev"""))
def trailing_count(spark, sf):
    rows = A.events(spark, sf).select("event_id", "user_id", "ts")
    return T.trailing_count(rows, ["user_id"], "ts", 60)


@query("latest_per_key", with_parts("""SELECT user_id, metric_type, hk_uuid, ts FROM (SELECT *, row_number() OVER (
 PARTITION BY user_id, metric_type ORDER BY ts DESC, hk_uuid) AS rn FROM samples) WHERE rn = 1"""))
def latest_per_key(spark, sf):
    rows = A.samples(spark, sf).select("user_id", "metric_type", "hk_uuid", "ts")
    return K.latest_per_key(rows, ["user_id", "metric_type"], [F.col("ts").desc(), F.col("hk_uuid")])


@query("last_n_per_user", with_parts("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (
 PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev) WHERE rn <= 64"""))
def last_n_per_user(spark, sf):
    rows = A.events(spark, sf).select("user_id", "event_id", "ts")
    return K.last_n(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 64)


@query("dedupe_consecutive", with_parts("""SELECT user_id, event_id, ts, tz_name FROM (SELECT *,
 lag(tz_name) OVER w AS p, row_number() OVER w AS rn FROM ctx WHERE tz_name IS NOT NULL
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE rn = 1 OR p IS DISTINCT FROM tz_name"""))
def dedupe_consecutive(spark, sf):
    rows = A.events(spark, sf).selectExpr("*", *A.CONTEXT).selectExpr(
        "user_id", "event_id", "ts", "timezone AS tz_name"
    ).filter("tz_name IS NOT NULL")
    return T.drop_repeats(rows, ["user_id"], "ts", ["event_id"], "tz_name")


@query("asof_window", with_parts("""SELECT event_id, user_id, ts, tz_seen FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS tz_seen FROM ev)
 WHERE event_type <> 'signup'"""))
def asof_window(spark, sf):
    e = A.events(spark, sf)
    points = e.filter("event_type <> 'signup'").select("event_id", "user_id", "ts")
    history = e.filter("event_type = 'signup'").select(
        "user_id", F.col("ts").alias("effective_at"), F.col("value").alias("tz_seen")
    )
    return T.asof_last(points, history, ["user_id"], "ts", "effective_at", ["tz_seen"], ["event_id"])


@query("coalesce_bursts", with_parts("""SELECT user_id, min(ts) AS burst_start, max(ts) + INTERVAL 5 MINUTE AS burst_end, count(*) AS n
 FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM (
 SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS opens FROM ev))
 GROUP BY user_id, b"""))
def coalesce_bursts(spark, sf):
    from pulseframe.streaming.bursts import coalesce_bursts as bursts

    return bursts(A.events(spark, sf), "5 minutes")
