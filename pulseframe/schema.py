"""Schemas and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

META = T.StructType(
    [T.StructField("tz_name", T.StringType()), T.StructField("utc_offset_min", T.IntegerType())]
)
SOURCES = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])
)
_TYPES = {
    "string": T.StringType(), "timestamp": T.TimestampType(), "date": T.DateType(),
    "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "meta": META, "sources": SOURCES,
}


def table(text: str) -> T.StructType:
    """Schema from ``name type`` pairs; works before a session exists."""
    pairs = [item.split() for item in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# The column order of a mirror upload.
MIRROR_COLUMNS = (
    "user_id", "timestamp", "metric_type", "metric_value", "unit", "source", "timezone",
    "utc_offset_min", "place_country", "place_region", "place_city", "created_at", "op",
    "hk_uuid", "end_ts", "hk_source_bundle_id", "hk_source_name", "hk_source_version",
    "hk_metadata",
)
CORRUPT_COLUMN = "_corrupt_record"
MIRROR_TEXT = T.StructType(
    [T.StructField(c, T.StringType()) for c in MIRROR_COLUMNS]
    + [T.StructField(CORRUPT_COLUMN, T.StringType())]
)

SAMPLES = table(
    "user_id string, hk_uuid string, ts timestamp, end_ts timestamp, metric_type string, "
    "metric_value double, unit string, created_at timestamp, meta meta, hk_source_name string, "
    "hk_source_version string, hk_metadata string, deleted_at timestamp"
)
EVENTS = table(
    "user_id string, hk_uuid string, event_type string, ts timestamp, end_ts timestamp, value double, "
    "unit string, source string, created_at timestamp, hk_source_name string, "
    "hk_source_version string, hk_metadata string, deleted_at timestamp"
)
ROLLUP = table(
    "user_id string, metric_type string, bucket_ts timestamp, unit string, avg_value double, "
    "sum_value double, min_value double, max_value double, n bigint, meta meta, hk_sources sources"
)
NIGHTS = table(
    "user_id string, sleep_date date, sleep_start_ts timestamp, sleep_end_ts timestamp, "
    "asleep_minutes double, rem_minutes double, core_minutes double, deep_minutes double, "
    "awake_minutes double, meta meta, hk_sources sources"
)
SEGMENTS = table(
    "user_id string, hk_uuid string, sleep_date date, stage string, segment_start_ts timestamp, "
    "segment_end_ts timestamp, minutes double, meta meta, hk_sources sources"
)
WORKOUTS = table(
    "user_id string, workout_uuid string, workout_type string, start_ts timestamp, end_ts timestamp, "
    "duration_min double, distance_km double, energy_kcal double, hk_sources sources, hk_metadata string"
)
SPLITS = table(
    "user_id string, workout_uuid string, segment_unit string, segment_index int, "
    "workout_start_ts timestamp, start_ts timestamp, end_ts timestamp, start_offset_min double, "
    "end_offset_min double, duration_min double, avg_hr_bpm double, pace_s_per_unit double"
)
LEDGER = table(
    "user_id string, content_hash string, task_id string, file_size bigint, upload_mode string, "
    "seed_batch_id string, seed_chunk_index int, seed_chunk_total int, status string, "
    "request_count bigint, row_count bigint, created_at timestamp, updated_at timestamp, "
    "completed_at timestamp, error_message string"
)

# Metric name -> (unit label, aggregation class).
METRIC_CATALOG = {
    "heart_rate": ("bpm", "average"),
    "resting_heart_rate": ("bpm", "average"),
    "walking_hr_avg": ("bpm", "average"),
    "hr_variability_sdnn": ("ms", "average"),
    "steps": ("count", "sum"),
    "walking_speed": ("m_per_s", "average"),
    "vo2_max": ("ml_per_kg_min", "average"),
    "active_energy_burned": ("kcal", "sum"),
    "distance_walking_running_km": ("km", "sum"),
    "distance_cycling_km": ("km", "sum"),
    "distance_swimming_km": ("km", "sum"),
    "dietary_water": ("L", "sum"),
    "body_mass": ("kg", "average"),
    "body_mass_index": ("bmi", "average"),
    "blood_glucose": ("mg_dL", "average"),
    "oxygen_saturation": ("percent", "average"),
    "blood_pressure_systolic": ("mmHg", "average"),
    "blood_pressure_diastolic": ("mmHg", "average"),
    "respiratory_rate": ("breaths_per_min", "average"),
    "body_temperature": ("degC", "average"),
    "mindfulness_minutes": ("min", "sum"),
    "sleep_hours": ("hours", "sum"),
    "active_time_minutes": ("min", "sum"),
}
# Classes used when rolling up. Sleep totals are kept in nights, not rollups.
AVERAGE_METRICS = tuple(m for m, (_, kind) in METRIC_CATALOG.items() if kind == "average")
SUM_METRICS = tuple(
    m for m, (_, kind) in METRIC_CATALOG.items() if kind == "sum" and m != "sleep_hours"
)
# Sleep category code -> stage label, in the order of the platform enum.
SLEEP_STAGE_CODES = {0: "in_bed", 1: "asleep_unspecified", 2: "awake", 3: "core", 4: "deep", 5: "rem"}
SLEEP_STAGES = ("awake", "in_bed", "rem", "core", "deep", "asleep_unspecified")
ASLEEP_STAGES = ("rem", "core", "deep", "asleep_unspecified")
# Workout activity code -> label; every other code is a plain "workout".
ACTIVITY_CODES = {
    37: "running", 52: "walking", 13: "cycling", 46: "swimming", 24: "hiking",
    16: "elliptical", 57: "yoga", 50: "strength", 61: "skiing_downhill",
    60: "skiing_xc", 67: "snowboarding",
}
# Words that mark a distance activity, distance streams in preference order.
DISTANCE_KEYWORDS = ("run", "walk", "hike", "cycle", "bike", "swim", "row", "ski")
DISTANCE_METRICS = ("distance_walking_running_km", "distance_cycling_km", "distance_swimming_km")
WORKOUT_ATTRIBUTES = ("workout_distance_km", "workout_duration_min", "workout_energy_kcal")
LEGACY_FLAGS = ("event_hard_workout", "event_long_run_km")
# Limits.
RETENTION_DAYS = 60
MICRO_KM = 1_000_000
MICRO_KM_PER_MILE = 1_609_344
MAX_UPLOAD_BYTES = 200 * 1024 * 1024
PROCESSING_TIMEOUT_S = 300
# Ours: a sample or workout ends at most this long after its start; later ends are cut.
MAX_SPAN_DAYS = 31
