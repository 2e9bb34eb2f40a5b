"""Shared parts of the comparison SQL: the adapter of ``sources.adapter`` as plain SQL."""

from __future__ import annotations

import re


def meta_json(zone: str, offset: str) -> str:
    """JSON text of a zone context, absent parts left out."""
    return (
        f"CASE WHEN {zone} IS NOT NULL AND {offset} IS NOT NULL "
        f"THEN '{{\"tz_name\":\"' || {zone} || '\",\"utc_offset_min\":' || {offset} || '}}' "
        f"WHEN {zone} IS NOT NULL THEN '{{\"tz_name\":\"' || {zone} || '\"}}' "
        f"WHEN {offset} IS NOT NULL THEN '{{\"utc_offset_min\":' || {offset} || '}}' END"
    )


def local(ts: str, zone: str) -> str:
    """Wall-clock time of a UTC timestamp."""
    return f"({ts} AT TIME ZONE 'UTC' AT TIME ZONE {zone})"


def utc(ts: str, zone: str) -> str:
    """UTC timestamp of a wall-clock time."""
    return f"({ts} AT TIME ZONE {zone} AT TIME ZONE 'UTC')"


#: white space of any kind, as SQL
WHITE = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

# The metrics that a rollup averages and those that it sums.
AVG_METRICS = """('heart_rate','resting_heart_rate','walking_hr_avg','hr_variability_sdnn','walking_speed',
'vo2_max','body_mass','body_mass_index','blood_glucose','oxygen_saturation','blood_pressure_systolic',
'blood_pressure_diastolic','respiratory_rate','body_temperature')"""
SUM_METRICS = """('steps','active_energy_burned','distance_walking_running_km','distance_cycling_km',
'distance_swimming_km','dietary_water','mindfulness_minutes','active_time_minutes')"""

PARTS: dict[str, str] = {}

PARTS["ev"] = """SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type, value,
 CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""

PARTS["ctx"] = """SELECT *,
 CASE k % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Kolkata' END AS tz_name,
 CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN -300 WHEN 2 THEN 330 END AS utc_offset_min,
 CASE WHEN k % 5 = 0 THEN '{"HKTimeZone":"Europe/Paris"}'
      WHEN k % 5 = 1 THEN '{"tz_name":"Asia/Tokyo","x":1}' END AS hk_metadata,
 CASE WHEN k % 5 = 0 THEN 'Europe/Paris' WHEN k % 5 = 1 THEN 'Asia/Tokyo' END AS hk_zone,
 CASE k % 3 WHEN 0 THEN 'Watch' WHEN 1 THEN 'Phone' END AS hk_source_name,
 CASE WHEN k % 3 < 2 THEN CAST(k % 2 AS VARCHAR) END AS hk_source_version,
 ts + INTERVAL 1 MINUTE AS created_at,
 CASE WHEN event_id % 37 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM ev"""

PARTS["mirror"] = """SELECT user_id, 'S-' || event_id AS hk_uuid, ts,
 CASE WHEN event_type IN ('click', 'purchase') THEN ts + to_minutes(k) END AS end_ts,
 CASE event_type WHEN 'view' THEN 'heart_rate' WHEN 'purchase' THEN 'distance_walking_running_km'
  WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'steps' ELSE 'body_mass' END
  ELSE 'sleep_' || CASE k % 6 WHEN 0 THEN 'awake' WHEN 1 THEN 'in_bed' WHEN 2 THEN 'rem' WHEN 3 THEN 'core'
   WHEN 4 THEN 'deep' ELSE 'asleep_unspecified' END || '_minutes' END AS metric_type,
 CASE event_type WHEN 'click' THEN CAST(k AS DOUBLE) WHEN 'purchase' THEN round(value / 10, 4) ELSE value END AS metric_value,
 CASE WHEN k % 10 <> 9 THEN CASE event_type WHEN 'view' THEN 'bpm' WHEN 'purchase' THEN 'km'
  WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'count' ELSE 'kg' END ELSE 'min' END END AS unit,
 created_at, tz_name, utc_offset_min, hk_source_name, hk_source_version, hk_metadata, hk_zone, op, event_id, k
 FROM ctx WHERE event_type <> 'signup'"""

PARTS["samples"] = """SELECT *, coalesce(tz_name, hk_zone) AS zone,
 CASE WHEN op = 'delete' THEN ts + INTERVAL 1 DAY END AS deleted_at FROM mirror"""

PARTS["text_rows"] = """SELECT event_id,
 CASE WHEN k % 9 = 0 THEN ' u' || user_id ELSE user_id END AS user_id,
 CASE WHEN k % 11 = 0 THEN 'not a time' WHEN k % 11 = 1 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS timestamp,
 ts AS true_ts,
 CASE WHEN k % 13 = 0 THEN '' ELSE metric_type END AS metric_type,
 CASE WHEN k % 7 = 0 THEN 'n/a' WHEN k % 7 = 1 THEN ' ' || chr(9) WHEN k % 7 = 2 THEN 'NaN' ELSE ' ' || format('{:.4f}', metric_value) END AS metric_value,
 CASE WHEN k % 8 = 0 THEN ' ' || chr(10) || chr(13) ELSE chr(9) || unit || chr(10) END AS unit,
 coalesce(tz_name, ' ') AS timezone,
 CASE WHEN k % 4 = 1 THEN '-300.0' ELSE CAST(utc_offset_min AS VARCHAR) END AS utc_offset_min,
 CASE WHEN op = 'delete' THEN 'DELETE' WHEN k % 2 = 0 THEN 'upsert' END AS op,
 CASE WHEN k % 17 = 0 THEN chr(11) ELSE hk_uuid END AS hk_uuid, k FROM mirror"""

PARTS["typed"] = f"""SELECT event_id, nullif(trim(user_id, {WHITE}), '') AS user_id,
 CASE WHEN timestamp NOT IN ('not a time', '') THEN true_ts END AS ts,
 nullif(trim(metric_type, {WHITE}), '') AS metric_type, nullif(TRY_CAST(trim(metric_value, {WHITE}) AS DOUBLE), CAST('nan' AS DOUBLE)) AS metric_value,
 nullif(trim(unit, {WHITE}), '') AS unit, nullif(trim(timezone, {WHITE}), '') AS tz_name,
 CAST(TRY_CAST(utc_offset_min AS DOUBLE) AS INTEGER) AS utc_offset_min,
 op, nullif(trim(hk_uuid, {WHITE}), '') AS hk_uuid, k FROM text_rows"""

PARTS["facts"] = """SELECT user_id, 'W-' || event_id AS workout_uuid, ts,
 CASE WHEN k % 3 <> 0 THEN ts + to_minutes(1440 * (1 + k % 5)) END AS end_ts,
 CASE k % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'walking' WHEN 2 THEN 'cycling' ELSE 'strength' END AS source,
 value AS distance_km, CAST(1440 * (1 + k % 5) AS DOUBLE) AS duration_min, value * 2 AS energy_kcal,
 created_at, tz_name, utc_offset_min, hk_source_name, hk_source_version, hk_metadata, hk_zone, op, event_id, k
 FROM ctx WHERE event_type = 'signup'"""

PARTS["wevents"] = """SELECT user_id, workout_uuid || '|' || t.event_type AS hk_uuid, t.event_type, ts, end_ts, t.value, t.unit,
 source, created_at, hk_source_name, hk_source_version, hk_metadata, hk_zone, workout_uuid, op,
 CASE WHEN op = 'delete' THEN ts + INTERVAL 1 DAY END AS deleted_at
 FROM facts, LATERAL (VALUES ('workout_distance_km', distance_km, 'km'), ('workout_duration_min', duration_min, 'min'),
  ('workout_energy_kcal', energy_kcal, 'kcal')) AS t(event_type, value, unit)"""

PARTS["wk"] = """SELECT user_id, workout_uuid, source AS workout_type, ts AS start_ts,
 coalesce(end_ts, ts + to_minutes(CAST(duration_min AS INTEGER))) AS end_ts, duration_min, distance_km, energy_kcal,
 hk_source_name, hk_source_version, hk_metadata, hk_zone
 FROM facts WHERE op <> 'delete'"""


def _rollup(unit: str) -> str:
    return f"""SELECT user_id, metric_type, date_trunc('{unit}', ts) AS bucket_ts,
 arg_max(unit, ts) FILTER (WHERE unit IS NOT NULL) AS unit,
 CASE WHEN metric_type IN {AVG_METRICS} THEN sum(metric_value) / count(*) END AS avg_value,
 CASE WHEN metric_type IN {SUM_METRICS} THEN sum(metric_value) END AS sum_value,
 min(metric_value) AS min_value, max(metric_value) AS max_value, count(*) AS n,
 arg_max({{'tz': zone, 'off': utc_offset_min}}, ts)
  FILTER (WHERE tz_name IS NOT NULL OR utc_offset_min IS NOT NULL OR hk_metadata IS NOT NULL) AS meta,
 coalesce(list_sort(list(DISTINCT {{'name': hk_source_name, 'version': hk_source_version}})
  FILTER (WHERE hk_source_name IS NOT NULL)), []) AS hk_sources
 FROM samples WHERE deleted_at IS NULL AND metric_type NOT LIKE 'sleep_%' GROUP BY 1, 2, 3"""


PARTS["hourly"] = _rollup("hour")
PARTS["daily"] = _rollup("day")

PARTS["srows"] = """SELECT user_id, hk_uuid, metric_type, metric_value, ts AS segment_start_ts,
 coalesce(end_ts, ts) AS segment_end_ts, tz_name AS meta_tz, utc_offset_min AS meta_off,
 coalesce(zone, 'UTC') AS tz_name, hk_source_name, hk_source_version
 FROM samples WHERE deleted_at IS NULL AND metric_type LIKE 'sleep_%' AND metric_type <> 'sleep_hours'
 AND coalesce(end_ts, ts) >= ts"""


def sessions(gap: str) -> str:
    return f"""SELECT *, sum(CASE WHEN prev_end IS NULL OR segment_start_ts - prev_end > INTERVAL {gap} THEN 1 ELSE 0 END)
 OVER (PARTITION BY user_id ORDER BY segment_start_ts, hk_uuid ROWS UNBOUNDED PRECEDING) AS session_id
 FROM (SELECT *, lag(segment_end_ts) OVER (PARTITION BY user_id ORDER BY segment_start_ts, hk_uuid) AS prev_end FROM srows)"""


PARTS["sess"] = sessions("24 HOUR")
PARTS["bounds"] = """SELECT user_id, session_id, min(segment_start_ts) AS session_start_ts, max(segment_end_ts) AS session_end_ts,
 arg_max(tz_name, segment_start_ts) AS session_tz FROM sess GROUP BY 1, 2"""
PARTS["labelled"] = f"""SELECT s.*, CAST({local('b.session_end_ts', 'b.session_tz')} AS DATE) AS sleep_date
 FROM sess s JOIN bounds b USING (user_id, session_id)"""
PARTS["segs"] = """SELECT user_id, hk_uuid, sleep_date, regexp_replace(metric_type, '^sleep_(.*)_minutes$', '\\1') AS stage,
 segment_start_ts, segment_end_ts, coalesce(metric_value, 0) AS minutes,
 CASE WHEN meta_tz IS NULL AND meta_off IS NULL THEN tz_name ELSE meta_tz END AS m_tz, meta_off AS m_off,
 CASE WHEN hk_source_name IS NOT NULL THEN [{'name': hk_source_name, 'version': hk_source_version}] ELSE [] END AS hk_sources
 FROM labelled WHERE segment_end_ts > segment_start_ts"""


def nights(source: str) -> str:
    """Nights from rows with stage and minutes; sources as list of structs."""
    return f"""SELECT user_id, sleep_date, min(segment_start_ts) AS sleep_start_ts, max(segment_end_ts) AS sleep_end_ts,
 sum(CASE WHEN stage IN ('rem', 'core', 'deep', 'asleep_unspecified') THEN minutes ELSE 0 END) AS asleep_minutes,
 sum(CASE WHEN stage = 'rem' THEN minutes ELSE 0 END) AS rem_minutes,
 sum(CASE WHEN stage = 'core' THEN minutes ELSE 0 END) AS core_minutes,
 sum(CASE WHEN stage = 'deep' THEN minutes ELSE 0 END) AS deep_minutes,
 sum(CASE WHEN stage = 'awake' THEN minutes ELSE 0 END) AS awake_minutes,
 arg_max({{'tz': m_tz, 'off': m_off}}, segment_start_ts) AS meta,
 coalesce(list_sort(list(DISTINCT hk_sources[1]) FILTER (WHERE len(hk_sources) > 0)), []) AS hk_sources
 FROM {source} GROUP BY 1, 2"""


PARTS["allsegs"] = PARTS["segs"].replace(" WHERE segment_end_ts > segment_start_ts", "")
PARTS["nights"] = nights("allsegs")
PARTS["nights_seg"] = nights("segs")

PARTS["wspan"] = """SELECT user_id, workout_uuid, workout_type, distance_km, start_ts AS workout_start_ts,
 coalesce(end_ts, start_ts) AS workout_end_ts FROM wk"""
PARTS["gate"] = """SELECT * FROM wspan WHERE regexp_matches(lower(trim(coalesce(workout_type, ''))), 'run|walk|hike|cycle|bike|swim|row|ski')
 AND coalesce(distance_km, 0) >= 1.0"""
PARTS["dist"] = """SELECT s.user_id, s.hk_uuid, s.ts, s.end_ts, s.metric_type, s.metric_value, w.workout_uuid, w.workout_start_ts, w.workout_end_ts
 FROM samples s JOIN gate w ON s.user_id = w.user_id AND s.ts >= w.workout_start_ts AND s.ts < w.workout_end_ts
 WHERE s.deleted_at IS NULL AND s.metric_type IN ('distance_walking_running_km', 'distance_cycling_km', 'distance_swimming_km')"""
PARTS["best"] = """SELECT * FROM (SELECT user_id, workout_uuid, metric_type, sum(metric_value) AS total_km, min(ts) AS first_ts,
 row_number() OVER (PARTITION BY user_id, workout_uuid ORDER BY sum(metric_value) DESC,
  CASE metric_type WHEN 'distance_walking_running_km' THEN 1 WHEN 'distance_cycling_km' THEN 2 ELSE 3 END) AS rn
 FROM dist GROUP BY 1, 2, 3) WHERE rn = 1 AND total_km >= 1.0"""
PARTS["cum"] = """SELECT *, covered_ukm - distance_ukm AS before_ukm FROM (
 SELECT *, CAST(sum(distance_ukm) OVER (PARTITION BY user_id, workout_uuid ORDER BY ts, hk_uuid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS covered_ukm
 FROM (SELECT d.*, b.first_ts, CAST(floor(d.metric_value * 1000000 + 0.5) AS BIGINT) AS distance_ukm
  FROM dist d JOIN best b USING (user_id, workout_uuid, metric_type)) WHERE distance_ukm > 0)"""
PARTS["parts"] = """SELECT user_id, workout_uuid, segment_unit, segment_index, workout_start_ts, workout_end_ts,
 coalesce(lag(end_ts) OVER (PARTITION BY user_id, workout_uuid, segment_unit ORDER BY segment_index), first_ts) AS start_ts, end_ts
 FROM (SELECT *, make_timestamp(epoch_us(ts) + CAST(floor(greatest(coalesce(epoch_us(x_end) - epoch_us(ts), 0), 0)
   * ((segment_index * len - before_ukm) / CAST(distance_ukm AS DOUBLE)) + 0.5) AS BIGINT)) AS end_ts
  FROM (SELECT user_id, workout_uuid, ts, end_ts AS x_end, first_ts, workout_start_ts, workout_end_ts, before_ukm, distance_ukm,
    u.segment_unit, u.len, CAST(unnest(range(before_ukm // u.len + 1, covered_ukm // u.len + 1)) AS INTEGER) AS segment_index
   FROM cum, (VALUES ('km', 1000000), ('mi', 1609344)) AS u(segment_unit, len)))"""
PARTS["hr"] = """SELECT p.user_id, p.workout_uuid, p.segment_unit, p.segment_index, s.hk_uuid, s.ts, s.metric_value AS bpm
 FROM samples s JOIN parts p ON s.user_id = p.user_id AND s.ts >= p.start_ts AND s.ts < p.end_ts
  AND s.ts >= p.workout_start_ts AND s.ts < p.workout_end_ts
 WHERE s.deleted_at IS NULL AND s.metric_type = 'heart_rate'"""

PARTS["msgs"] = """SELECT CAST(conv_id % 7 AS VARCHAR) AS user_id, conv_id AS conversation_id, turn AS id,
 make_timestamp((1704067200 + conv_id * 60 + turn // 2) * 1000000) AS timestamp, role, text AS content FROM conversations"""
PARTS["titles"] = """SELECT DISTINCT user_id, conversation_id,
 CASE WHEN conversation_id % 3 <> 0 THEN 'Chat ' || conversation_id END AS title FROM msgs"""
PARTS["ups"] = "SELECT doc_id, source AS user_id, text AS content FROM documents"

PARTS["geo"] = """SELECT user_id, h.since, lead(h.since) OVER (PARTITION BY user_id ORDER BY h.since) AS until, h.tz, h.src
 FROM (SELECT DISTINCT user_id FROM ev), (VALUES (TIMESTAMP '2024-01-05', 'Europe/Paris', 'geocode'),
 (TIMESTAMP '2024-01-10', 'Asia/Kolkata', 'seed_device_tz'), (TIMESTAMP '2024-01-20', 'America/New_York', 'geocode')) AS h(since, tz, src)"""
PARTS["dev"] = """SELECT user_id, h.since, lead(h.since) OVER (PARTITION BY user_id ORDER BY h.since) AS until, h.tz
 FROM (SELECT DISTINCT user_id FROM ev), (VALUES (TIMESTAMP '2024-01-03', 'UTC'), (TIMESTAMP '2024-01-08', 'Asia/Kolkata'),
 (TIMESTAMP '2024-01-12', NULL)) AS h(since, tz)"""

PARTS["batch"] = """SELECT user_id, hk_uuid, ts, end_ts, metric_type, metric_value + 1 AS metric_value,
 CASE WHEN event_id % 10 <> 0 THEN unit END AS unit, tz_name, utc_offset_min, hk_source_name, event_id
 FROM mirror WHERE event_id % 5 = 0"""


def rebucket(source: str, unit: str, zone: str) -> str:
    z = f"'{zone}'"
    return f"""SELECT user_id, {utc(f"date_trunc('{unit}', {local('bucket_ts', z)})", z)} AS bucket_ts, metric_type,
 min(unit) AS unit,
 arg_min(meta, {{'a': coalesce(meta.tz, ''), 'b': coalesce(meta.off, -100000)}})
  FILTER (WHERE meta.tz IS NOT NULL OR meta.off IS NOT NULL) AS meta,
 min(hk_sources) AS hk_sources,
 CASE WHEN sum(n) > 0 THEN sum(coalesce(avg_value, 0) * n) / sum(n) END AS avg_value,
 sum(coalesce(sum_value, 0)) AS sum_value, min(min_value) AS min_value, max(max_value) AS max_value, CAST(sum(n) AS BIGINT) AS n
 FROM {source} GROUP BY 1, 2, 3"""


ROLLUP_OUT = f"""user_id, metric_type, bucket_ts, unit, round(avg_value, 6) AS avg_value, round(sum_value, 6) AS sum_value,
 min_value, max_value, n, {meta_json('meta.tz', 'meta.off')} AS meta, CAST(to_json(hk_sources) AS VARCHAR) AS hk_sources"""
NIGHT_OUT = f"""user_id, sleep_date, sleep_start_ts, sleep_end_ts, round(asleep_minutes, 6) AS asleep_minutes,
 round(rem_minutes, 6) AS rem_minutes, round(core_minutes, 6) AS core_minutes, round(deep_minutes, 6) AS deep_minutes,
 round(awake_minutes, 6) AS awake_minutes, {meta_json('meta.tz', 'meta.off')} AS meta,
 CAST(to_json(hk_sources) AS VARCHAR) AS hk_sources"""


def with_parts(select: str, **extra: str) -> str:
    """A SELECT with the parts it mentions put before it as common table expressions."""
    known = {**PARTS, **extra}
    needed: dict[str, str] = {}

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?i)(?:\bfrom|\bjoin|,)\s*\(?\s*(\w+)", text)):
            if word in known and word not in needed:
                needed[word] = ""
                visit(known[word])
                del needed[word]
                needed[word] = known[word]

    visit(select)
    recursive = any(re.search(rf"(?i)\bfrom {n} ", t) for n, t in needed.items())
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({t})" for n, t in needed.items()) + "\n" + select if needed else select
