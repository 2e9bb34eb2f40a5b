"""Workouts, the samples inside them, and their splits."""

from __future__ import annotations

from pulseframe.catalog.registry import query
from pulseframe.catalog.shape import nested_as_json, rounded
from pulseframe.catalog.sql import with_parts
from pulseframe.operators import splits as P, workouts as W
from pulseframe.sources import adapter as A


def _workouts(spark, sf):
    return W.workouts(A.workout_events(spark, sf))


def _stream(spark, sf):
    return P.distance_stream(A.samples(spark, sf), _workouts(spark, sf))


@query("workout_pivot", with_parts("""SELECT user_id, workout_uuid, source AS workout_type, ts AS start_ts, end_ts, duration_min, distance_km, energy_kcal,
 hk_source_name, hk_source_version, hk_metadata FROM facts WHERE op <> 'delete'"""))
def workout_pivot(spark, sf):
    return W.workout_pivot(A.workout_events(spark, sf))


@query("workout_end", with_parts("SELECT user_id, workout_uuid, end_ts FROM wk"))
def workout_end(spark, sf):
    return W.workout_end(W.workout_pivot(A.workout_events(spark, sf))).select("user_id", "workout_uuid", "end_ts")


@query("workouts", with_parts("""SELECT user_id, workout_uuid, workout_type, start_ts, end_ts, duration_min, distance_km, energy_kcal,
 CASE WHEN hk_source_name IS NOT NULL THEN CAST(to_json([{'name': hk_source_name, 'version': hk_source_version}]) AS VARCHAR) ELSE '[]' END AS hk_sources,
 hk_metadata FROM wk"""))
def workouts(spark, sf):
    return nested_as_json(_workouts(spark, sf))


@query("samples_in_workout", with_parts("""SELECT s.user_id, s.hk_uuid, s.metric_type, s.ts, w.workout_uuid FROM samples s JOIN wspan w
 ON s.user_id = w.user_id AND s.ts >= w.workout_start_ts AND s.ts < w.workout_end_ts WHERE s.deleted_at IS NULL"""))
def samples_in_workout(spark, sf):
    rows = W.samples_in_workout(A.samples(spark, sf), _workouts(spark, sf))
    return rows.select("user_id", "hk_uuid", "metric_type", "ts", "workout_uuid")


@query("best_stream", with_parts("SELECT user_id, workout_uuid, metric_type, round(total_km, 6) AS total_km, first_ts FROM best"))
def best_stream(spark, sf):
    inside = W.samples_in_workout(A.samples(spark, sf), W.distance_workouts(_workouts(spark, sf)))
    return rounded(W.best_stream(inside), "total_km")


@query("cumulative_distance", with_parts("SELECT user_id, workout_uuid, hk_uuid, distance_ukm, before_ukm, covered_ukm FROM cum"))
def cumulative_distance(spark, sf):
    return _stream(spark, sf).select(
        "user_id", "workout_uuid", "hk_uuid", "distance_ukm", "before_ukm", "covered_ukm"
    )


SPLIT_SQL = "SELECT user_id, workout_uuid, segment_unit, segment_index, start_ts, end_ts FROM parts WHERE segment_unit = "


@query("splits_km", with_parts(SPLIT_SQL + "'km'"))
def splits_km(spark, sf):
    return P.splits(_stream(spark, sf), ("km",)).select(*P.SPLIT, "start_ts", "end_ts")


@query("splits_mi", with_parts(SPLIT_SQL + "'mi'"))
def splits_mi(spark, sf):
    return P.splits(_stream(spark, sf), ("mi",)).select(*P.SPLIT, "start_ts", "end_ts")


@query("hr_in_split", with_parts("SELECT user_id, workout_uuid, segment_unit, segment_index, hk_uuid, bpm FROM hr"))
def hr_in_split(spark, sf):
    rows = P.hr_in_split(A.samples(spark, sf), P.splits(_stream(spark, sf)))
    return rows.select(*P.SPLIT, "hk_uuid", "bpm")


@query("split_avg_hr", with_parts("SELECT user_id, workout_uuid, segment_unit, segment_index, round(avg(bpm), 6) AS avg_hr_bpm FROM hr GROUP BY 1, 2, 3, 4"))
def split_avg_hr(spark, sf):
    return rounded(P.split_avg_hr(A.samples(spark, sf), P.splits(_stream(spark, sf))), "avg_hr_bpm")


@query("split_measures", with_parts("""SELECT p.user_id, p.workout_uuid, p.segment_unit, p.segment_index,
 greatest(0, epoch_us(start_ts) - epoch_us(workout_start_ts)) / 60000000 AS start_offset_min,
 greatest(0, epoch_us(end_ts) - epoch_us(workout_start_ts)) / 60000000 AS end_offset_min,
 greatest(0, epoch_us(end_ts) - epoch_us(start_ts)) / 60000000 AS duration_min,
 greatest(0, epoch_us(end_ts) - epoch_us(start_ts)) / 60000000 * 60 AS pace_s_per_unit, round(h.bpm, 6) AS avg_hr_bpm
 FROM parts p LEFT JOIN (SELECT user_id, workout_uuid, segment_unit, segment_index, avg(bpm) AS bpm FROM hr GROUP BY 1, 2, 3, 4) h
 USING (user_id, workout_uuid, segment_unit, segment_index)"""))
def split_measures(spark, sf):
    rows = P.split_measures(P.splits(_stream(spark, sf)), A.samples(spark, sf))
    return rounded(rows, "avg_hr_bpm").select(
        *P.SPLIT, "start_offset_min", "end_offset_min", "duration_min", "pace_s_per_unit", "avg_hr_bpm"
    )
