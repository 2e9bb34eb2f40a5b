"""Projections, filters and predicates on mirror rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.registry import query
from pulseframe.catalog.shape import rounded
from pulseframe.catalog.sql import WHITE, local, meta_json, with_parts
from pulseframe.functions import clean as C, meta as M, metrics, zones as Z
from pulseframe.operators import clean as O, rollup as R, workouts as W
from pulseframe.sources import adapter as A


def _typed(spark, sf):
    return O.parse_mirror(A.text_rows(spark, sf)).withColumn("event_id", F.col("ordinal"))


@query("coerce_ts", with_parts("SELECT event_id, ts FROM typed"))
def coerce_ts(spark, sf):
    return O.coerce_ts(A.text_rows(spark, sf), ["timestamp"]).select("event_id", F.col("timestamp").alias("ts"))


@query("coerce_num", with_parts("SELECT event_id, metric_value FROM typed WHERE metric_value IS NOT NULL"))
def coerce_num(spark, sf):
    return O.coerce_num(A.text_rows(spark, sf), "metric_value").select("event_id", "metric_value")


@query("blank_to_null", with_parts("SELECT event_id, unit, hk_uuid, metric_type FROM typed"))
def blank_to_null(spark, sf):
    cols = ["unit", "hk_uuid", "metric_type"]
    return O.blank_to_null(A.text_rows(spark, sf), cols).select("event_id", *cols)


@query("stamp_user", with_parts("SELECT event_id, 'caller' AS user_id FROM text_rows"))
def stamp_user(spark, sf):
    return O.stamp_user(A.text_rows(spark, sf), "caller").select("event_id", "user_id")


@query("audit_user_ids", with_parts(f"SELECT DISTINCT trim(user_id, {WHITE}) AS user_id FROM text_rows WHERE trim(user_id, {WHITE}) <> '1'"))
def audit_user_ids(spark, sf):
    return O.audit_user_ids(A.text_rows(spark, sf), "1")


@query("retention_filter", with_parts("""SELECT event_id, t.user_id, ts, op FROM typed t
 JOIN (SELECT user_id, max(ts) - INTERVAL 10 DAY AS cutoff FROM typed GROUP BY 1) c USING (user_id)
 WHERE ts >= cutoff OR lower(op) = 'delete'"""))
def retention_filter(spark, sf):
    # ten days instead of sixty: the test stream spans a month
    return O.retention_filter(_typed(spark, sf), 10).select("event_id", "user_id", "ts", "op")


MIXED = """SELECT user_id, hk_uuid, metric_type, metric_value FROM mirror
 UNION ALL SELECT user_id, hk_uuid, event_type, value FROM wevents"""


def _mixed(spark, sf):
    s = A.mirror_samples(spark, sf).select("user_id", "hk_uuid", "metric_type", "metric_value")
    e = A.workout_events(spark, sf).select("user_id", "hk_uuid", F.col("event_type").alias("metric_type"), F.col("value").alias("metric_value"))
    return s.unionByName(e)


@query("route_events", with_parts("SELECT * FROM mixed WHERE starts_with(metric_type, 'event_') OR starts_with(metric_type, 'workout_')", mixed=MIXED))
def route_events(spark, sf):
    return O.route(_mixed(spark, sf))[0]


@query("route_metrics", with_parts("SELECT * FROM mixed WHERE NOT (starts_with(metric_type, 'event_') OR starts_with(metric_type, 'workout_'))", mixed=MIXED))
def route_metrics(spark, sf):
    return O.route(_mixed(spark, sf))[1]


@query("split_ops", with_parts("SELECT event_id, hk_uuid, coalesce(lower(op) = 'delete', false) AS is_delete FROM text_rows"))
def split_ops(spark, sf):
    deletes, upserts = O.split_ops(A.text_rows(spark, sf))
    return deletes.select("event_id", "hk_uuid", F.lit(True).alias("is_delete")).unionByName(
        upserts.select("event_id", "hk_uuid", F.lit(False).alias("is_delete"))
    )


@query("identity_guard", with_parts(f"SELECT event_id, user_id FROM text_rows WHERE coalesce(lower(op), 'upsert') <> 'delete' AND nullif(trim(hk_uuid, {WHITE}), '') IS NULL"))
def identity_guard(spark, sf):
    return O.identity_violations(A.text_rows(spark, sf)).select("event_id", "user_id")


@query("complete_rows", with_parts("SELECT event_id, ts, metric_type, metric_value FROM typed WHERE ts IS NOT NULL AND metric_type IS NOT NULL AND metric_value IS NOT NULL"))
def complete_rows(spark, sf):
    return O.complete_rows(_typed(spark, sf)).select("event_id", "ts", "metric_type", "metric_value")


@query("live_rows", with_parts("SELECT user_id, hk_uuid, ts FROM samples WHERE deleted_at IS NULL"))
def live_rows(spark, sf):
    return R.live_rows(A.samples(spark, sf)).select("user_id", "hk_uuid", "ts")


@query("split_workout_id", with_parts("""SELECT hk_uuid, split_part(hk_uuid, '|', 1) AS workout_uuid, event_type AS suffix, true AS touches FROM wevents
 UNION ALL SELECT hk_uuid, NULL, NULL, false FROM mirror"""))
def split_workout_id(spark, sf):
    ids = A.workout_events(spark, sf).select("hk_uuid").union(A.mirror_samples(spark, sf).select("hk_uuid"))
    return W.split_workout_id(ids)


@query("tz_context", with_parts(f"SELECT event_id, {meta_json('tz_name', 'utc_offset_min')} AS meta FROM typed"))
def tz_context(spark, sf):
    context = M.tz_context(F.col("timezone"), F.col("utc_offset_min"))
    return A.text_rows(spark, sf).select("event_id", M.context_json(context).alias("meta"))


@query("merge_metadata", with_parts("""SELECT event_id, CASE WHEN tz_name IS NULL AND utc_offset_min IS NULL THEN src
 ELSE '{' || concat_ws(',',
  CASE WHEN src LIKE '%HKTimeZone%' THEN '"HKTimeZone":"Europe/Paris"' WHEN src = 'not json' THEN '"_raw_hk_metadata":"not json"' END,
  '"tz_name":"' || coalesce(tz_name, CASE WHEN src LIKE '%Tokyo%' THEN 'Asia/Tokyo' END) || '"',
  '"utc_offset_min":' || utc_offset_min, CASE WHEN src LIKE '%Tokyo%' THEN '"x":1' END) || '}' END AS hk_metadata
 FROM (SELECT event_id, tz_name, utc_offset_min, CASE WHEN k % 6 = 0 THEN 'not json' ELSE hk_metadata END AS src FROM mirror)"""))
def merge_metadata(spark, sf):
    rows = _typed(spark, sf)
    return rows.select("event_id", M.merge_metadata(F.col("hk_metadata"), F.col("meta")).alias("hk_metadata"))


@query("json_safe_metadata", with_parts("""SELECT event_id, CASE WHEN k % 6 <> 0 THEN '{"count":' || k || CASE WHEN k % 4 = 0 THEN ',"name":"a"' ELSE '' END || '}' END AS hk_metadata FROM ev"""))
def json_safe_metadata(spark, sf):
    k = F.col("k")
    raw = F.concat(
        F.lit('{"list":[1,2],"none":null'),
        F.when(k % 6 != 0, F.concat(F.lit(',"count":'), k)).otherwise(F.lit("")),
        F.when((k % 6 != 0) & (k % 4 == 0), F.lit(',"name":"a"')).otherwise(F.lit("")),
        F.lit(',"obj":{"z":1}}'),
    )
    return A.events(spark, sf).select("event_id", M.json_safe(raw).alias("hk_metadata"))


@query("effective_tz", with_parts("SELECT hk_uuid, coalesce(zone, 'UTC') AS tz_name FROM samples"))
def effective_tz(spark, sf):
    zone = Z.effective_zone(F.col("meta"), F.col("hk_metadata"))
    return A.samples(spark, sf).select("hk_uuid", zone.alias("tz_name"))


@query("normalise_units", with_parts("""SELECT event_id, CASE WHEN k % 2 = 0 THEN 'oxygen_saturation' ELSE 'heart_rate' END AS metric_type,
 CASE WHEN k % 2 = 0 THEN k / 100.0 * 100.0 ELSE CAST(k AS DOUBLE) END AS metric_value FROM ev"""))
def normalise_units(spark, sf):
    k = F.col("k")
    kind = F.when(k % 2 == 0, "oxygen_saturation").otherwise("heart_rate")
    value = F.when(k % 2 == 0, k / 100.0).otherwise(k.cast("double"))
    rows = A.events(spark, sf).select("event_id", kind.alias("metric_type"), value.alias("metric_value"))
    return rows.withColumn("metric_value", metrics.canonical_value(F.col("metric_type"), F.col("metric_value")))


@query("duration_minutes", with_parts("""SELECT hk_uuid, CASE WHEN metric_type LIKE 'sleep_a%' THEN round(greatest(0, epoch_us(end_ts) - epoch_us(ts)) / 60000000 / 60, 6)
 ELSE round(greatest(0, epoch_us(end_ts) - epoch_us(ts)) / 60000000, 6) END AS duration FROM samples WHERE end_ts IS NOT NULL"""))
def duration_minutes(spark, sf):
    unit = F.when(F.col("metric_type").like("sleep_a%"), "hours").otherwise("min")
    rows = A.samples(spark, sf).filter("end_ts IS NOT NULL").select(
        "hk_uuid", metrics.duration_value(F.col("ts"), F.col("end_ts"), unit).alias("duration")
    )
    return rounded(rows, "duration")


@query("activity_label", with_parts("""SELECT event_id, CASE k WHEN 37 THEN 'running' WHEN 52 THEN 'walking' WHEN 13 THEN 'cycling'
 WHEN 46 THEN 'swimming' WHEN 24 THEN 'hiking' WHEN 16 THEN 'elliptical' WHEN 57 THEN 'yoga' WHEN 50 THEN 'strength'
 WHEN 61 THEN 'skiing_downhill' WHEN 60 THEN 'skiing_xc' WHEN 67 THEN 'snowboarding' ELSE 'workout' END AS label FROM ev"""))
def activity_label(spark, sf):
    return A.events(spark, sf).select("event_id", metrics.activity_label(F.col("k")).alias("label"))


@query("metric_catalog", with_parts("""SELECT s.hk_uuid, s.metric_type, c.unit_label, c.agg_class FROM samples s JOIN (VALUES
 ('heart_rate', 'bpm', 'average'), ('steps', 'count', 'sum'), ('body_mass', 'kg', 'average'),
 ('distance_walking_running_km', 'km', 'sum')) AS c(metric_type, unit_label, agg_class) USING (metric_type)"""))
def metric_catalog(spark, sf):
    return metrics.with_catalog(A.samples(spark, sf)).select("hk_uuid", "metric_type", "unit_label", "agg_class")


@query("finite_only", with_parts("SELECT event_id, value FROM ev WHERE k % 10 NOT IN (0, 1, 2)"))
def finite_only(spark, sf):
    k = F.col("k") % 10
    dirty = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k != 2, F.col("value"))
    return O.finite_only(A.events(spark, sf).withColumn("value", dirty), "value").select("event_id", "value")


@query("unpivot_workout", with_parts("SELECT user_id, hk_uuid, event_type, ts, end_ts, value, unit, source FROM wevents"))
def unpivot_workout(spark, sf):
    return A.workout_events(spark, sf).select(
        "user_id", "hk_uuid", "event_type", "ts", "end_ts", "value", "unit", "source"
    )


@query("expand_deletes", with_parts("""SELECT user_id, u.hk_uuid, 'delete' AS op FROM (SELECT user_id, workout_uuid AS w FROM facts WHERE op = 'delete'),
 LATERAL (VALUES (w || '|workout_distance_km'), (w || '|workout_duration_min'), (w || '|workout_energy_kcal'), (w)) AS u(hk_uuid)"""))
def expand_deletes(spark, sf):
    deleted = A.workout_facts(spark, sf).filter("op = 'delete'").select(
        "user_id", F.col("workout_uuid").alias("hk_uuid"), "op"
    )
    return W.expand_deletes(deleted)


@query("distance_workouts", with_parts("SELECT user_id, workout_uuid, workout_type, distance_km FROM gate"))
def distance_workouts(spark, sf):
    return W.distance_workouts(W.workouts(A.workout_events(spark, sf))).select(
        "user_id", "workout_uuid", "workout_type", "distance_km"
    )


@query("day_window", with_parts(f"""SELECT hk_uuid, ts, w.name AS period FROM samples s JOIN (VALUES
 ('today', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-21'), ('yesterday', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-20'),
 ('last_7', TIMESTAMP '2024-01-14', TIMESTAMP '2024-01-21')) AS w(name, a, b)
 ON {local('s.ts', "'America/New_York'")} >= w.a AND {local('s.ts', "'America/New_York'")} < w.b"""))
def day_window(spark, sf):
    rows = A.samples(spark, sf)
    # the anchor is an instant late on the 20th in New York, already the 21st in UTC
    anchor = F.lit("2024-01-21 02:00:00").cast("timestamp")
    out = None
    for name, days, ending in (("today", 1, 0), ("yesterday", 1, 1), ("last_7", 7, 0)):
        lo, hi = Z.day_window(anchor, "America/New_York", days, ending)
        part = rows.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).select("hk_uuid", "ts", F.lit(name).alias("period"))
        out = part if out is None else out.unionByName(part)
    return out


@query("chat_clean", with_parts("""SELECT conversation_id, id, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, length(content) AS n
 FROM msgs WHERE trim(content) <> ''"""))
def chat_clean(spark, sf):
    from pulseframe.operators.chat import chat_clean as clean

    return clean(A.messages(spark, sf)).select("conversation_id", "id", "role", F.length("content").cast("long").alias("n"))


@query("clean_title", with_parts(r"""SELECT conversation_id, id, coalesce(nullif(CASE WHEN length(t) > 60 THEN left(t, 57) || '...' ELSE t END, ''), 'New Chat') AS title
 FROM (SELECT conversation_id, id, regexp_replace(trim(trim('Title: ' || content, ' '), '"''.:'), '^[Tt][Ii][Tt][Ll][Ee]:[ \t\n\r\f\v]*', '') AS t FROM msgs)"""))
def clean_title(spark, sf):
    titled = F.concat(F.lit("Title: "), "content")
    return A.messages(spark, sf).select("conversation_id", "id", C.clean_title(titled).alias("title"))


@query("format_minutes", with_parts("""SELECT event_id, CASE WHEN m >= 60 THEN (m // 60) || ' hr ' || (m % 60) || ' min' ELSE m || ' min' END AS text
 FROM (SELECT event_id, k * 5 AS m FROM ev)"""))
def format_minutes(spark, sf):
    return A.events(spark, sf).select("event_id", C.format_minutes(F.col("k") * 5.0).alias("text"))


@query("json_number", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_number(spark, sf):
    from pulseframe.session import configure

    rows = configure(spark).read.parquet(f"{sf}/events.parquet")
    return rows.select("event_id", M.json_number(F.col("props"), "$.k").alias("k"))


@query("utc_offset", with_parts(f"""SELECT hk_uuid, CAST((epoch_us({local('ts', 'zone')}) - epoch_us(ts)) // 60000000 AS INTEGER) AS utc_offset_min
 FROM samples WHERE zone IS NOT NULL"""))
def utc_offset(spark, sf):
    zone = Z.stated_zone(F.col("meta"), F.col("hk_metadata"))
    rows = A.samples(spark, sf).withColumn("zone", zone).filter("zone IS NOT NULL")
    return rows.select("hk_uuid", Z.offset_minutes(F.col("ts"), F.col("zone")).alias("utc_offset_min"))


@query("batch_counts", with_parts("""SELECT CASE WHEN lower(coalesce(op, '')) = 'delete' THEN 'deleted'
 WHEN ts IS NULL OR metric_type IS NULL OR metric_value IS NULL THEN 'dropped' ELSE 'metric' END AS outcome, count(*) AS n FROM typed GROUP BY 1"""))
def batch_counts(spark, sf):
    return O.batch_counts(O.outcome(_typed(spark, sf)))
