"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.catalog.registry import query
from pulseframe.catalog.shape import rollup_out
from pulseframe.catalog.sql import ROLLUP_OUT, with_parts
from pulseframe.functions.metrics import activity_label
from pulseframe.operators import clean as O, ledger as L, merge as G, rollup as R
from pulseframe.schema import ROLLUP
from pulseframe.session import work_folder
from pulseframe.sources import adapter as A, mirror_csv as C, tables as T

EXPORT = """SELECT user_id, hk_uuid, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, metric_type,
 format('{:.4f}', metric_value) AS metric_value,
 CASE metric_type WHEN 'heart_rate' THEN 'bpm' WHEN 'steps' THEN 'count' WHEN 'body_mass' THEN 'kg'
  WHEN 'distance_walking_running_km' THEN 'km' ELSE 'min' END AS unit,
 coalesce(hk_source_name, '') AS source, coalesce(tz_name, '') AS timezone,
 coalesce(CAST(utc_offset_min AS VARCHAR), '') AS utc_offset_min, 'upsert' AS op,
 CASE WHEN end_ts <> ts THEN strftime(end_ts, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS end_ts,
 coalesce(hk_metadata, '') AS hk_metadata FROM samples WHERE deleted_at IS NULL"""
EXPORTED = ("user_id", "hk_uuid", "timestamp", "metric_type", "metric_value", "unit", "source",
            "timezone", "utc_offset_min", "op", "end_ts", "hk_metadata")


KINDS = f"""SELECT 'sample' AS kind, * FROM ({EXPORT})
 UNION ALL SELECT 'workout', user_id, workout_uuid || '|' || a.attr, strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), a.attr,
  format('{{:.4f}}', CASE a.u WHEN 'km' THEN distance_km WHEN 'min' THEN duration_min ELSE energy_kcal END), a.u, source, '', '', 'upsert',
  coalesce(strftime(end_ts, '%Y-%m-%dT%H:%M:%SZ'), ''), ''
  FROM facts, (VALUES ('workout_distance_km', 'km'), ('workout_duration_min', 'min'), ('workout_energy_kcal', 'kcal')) AS a(attr, u)
 UNION ALL SELECT 'delete', user_id, hk_uuid || d.suffix, '', '', '', '', '', '', '', 'delete', '', '' FROM samples,
  (VALUES (''), ('|workout_distance_km'), ('|workout_duration_min'), ('|workout_energy_kcal')) AS d(suffix) WHERE deleted_at IS NOT NULL"""


@query("export_rows", with_parts(KINDS))
def export_rows(spark, sf):
    """A delta with samples, workouts and deletes."""
    samples = A.samples(spark, sf)
    facts = A.workout_facts(spark, sf).withColumn("source", activity_label(F.col("activity_code")))
    parts = {
        "sample": C.export_mirror(R.live_rows(samples)), "workout": C.export_workouts(facts),
        "delete": C.export_deletes(samples.filter("deleted_at IS NOT NULL")),
    }
    rows = [df.select(F.lit(kind).alias("kind"), *EXPORTED) for kind, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _mirror_folder(spark, sf) -> str:
    """All live samples written as mirror files."""
    path = work_folder(spark, "mirror")
    C.write_mirror_csv(C.export_mirror(R.live_rows(A.samples(spark, sf))), path)
    return path


@query("scan_mirror_csv", with_parts("""SELECT user_id, hk_uuid, date_trunc('second', ts) AS ts, metric_type,
 CAST(format('{:.4f}', metric_value) AS DOUBLE) AS metric_value, date_trunc('second', CASE WHEN end_ts <> ts THEN end_ts END) AS end_ts,
 tz_name, hk_metadata FROM samples WHERE deleted_at IS NULL"""))
def scan_mirror_csv(spark, sf):
    rows = O.parse_mirror(C.read_mirror_csv(spark, _mirror_folder(spark, sf)))
    return rows.select(
        "user_id", "hk_uuid", "ts", "metric_type", "metric_value", "end_ts",
        F.col("meta.tz_name").alias("tz_name"), "hk_metadata",
    )


@query("optional_columns", with_parts("""SELECT user_id, hk_uuid, date_trunc('second', ts) AS ts, metric_type,
 CAST(format('{:.4f}', metric_value) AS DOUBLE) AS metric_value,
 CASE WHEN event_id % 4 IN (1, 2) THEN NULL ELSE date_trunc('second', CASE WHEN end_ts <> ts THEN end_ts END) END AS end_ts,
 CASE WHEN event_id % 4 = 1 OR metric_type LIKE 'sleep_%' THEN NULL ELSE hk_source_name END AS hk_source_name,
 CASE WHEN event_id % 4 <> 1 THEN tz_name END AS tz_name, 'upsert' AS op
 FROM samples WHERE deleted_at IS NULL AND metric_type NOT LIKE 'sleep_%'"""))
def optional_columns(spark, sf):
    """Mirror files of four ages in one folder: full ones, old ones without operation, unit, end,
    source and zone, ones without an end, and newer ones with more columns in another order."""
    path = work_folder(spark, "ages")
    live = R.live_rows(A.samples(spark, sf)).filter("metric_type NOT LIKE 'sleep_%'")
    rows = C.export_mirror(live).withColumn("_age", F.substring("hk_uuid", 3, 20).cast("long") % 4)
    base = list(S.MIRROR_COLUMNS)
    old = ["user_id", "timestamp", "metric_type", "metric_value", "hk_uuid"]
    ages = {0: base, 1: old, 2: [c for c in base if c != "end_ts"], 3: ["firmware", *reversed(base), "battery"]}
    for age, columns in ages.items():
        more = rows.filter(F.col("_age") == age).withColumns({"firmware": F.lit("9,1"), "battery": F.lit("7")})
        C.write_mirror_csv(more.select(*columns), f"{path}/age={age}")
    typed = O.parse_mirror(C.read_mirror_csv(spark, f"{path}/*"))
    return typed.select("user_id", "hk_uuid", "ts", "metric_type", "metric_value", "end_ts", "hk_source_name",
                        F.col("meta.tz_name").alias("tz_name"), "op")


@query("scan_user_range", with_parts("""SELECT hk_uuid, ts, metric_type, metric_value FROM samples WHERE user_id = '7'
 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND metric_type IN ('heart_rate', 'steps')"""))
def scan_user_range(spark, sf):
    """From a stored table, of which the days of the range and the bucket of the user are read."""
    path = work_folder(spark, "stored")
    T.replace_slice(A.samples(spark, sf).select(*S.SAMPLES.fieldNames()), path, "ts", G.SAMPLE_KEYS, 2)
    t0, t1 = (F.lit(d).cast("timestamp") for d in ("2024-01-05", "2024-01-20"))
    rows = T.scan_samples(T.read_table(spark, path, S.SAMPLES), "7", t0, t1, ["heart_rate", "steps"], 2)
    return rows.select("hk_uuid", "ts", "metric_type", "metric_value")


@query("sink_upsert", with_parts("""SELECT s.user_id, s.hk_uuid, s.ts, coalesce(b.metric_value, s.metric_value) AS metric_value,
 coalesce(b.unit, s.unit) AS unit, CASE WHEN b.hk_uuid IS NULL THEN s.deleted_at END AS deleted_at
 FROM samples s LEFT JOIN batch b USING (user_id, hk_uuid)"""))
def sink_upsert(spark, sf):
    """Stored once, then a batch merged into the parts of the stored table that hold its rows."""
    root = work_folder(spark, "samples")
    base = A.samples(spark, sf).select(*S.SAMPLES.fieldNames())
    locator = T.Locator(spark, f"{root}/k", buckets=2)
    locator.add(base, "ts")
    T.replace_slice(base, f"{root}/t", "ts", G.SAMPLE_KEYS, locator.buckets)
    batch = A.upsert_batch(spark, sf).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    T.write_upsert(
        spark, batch, f"{root}/t", S.SAMPLES, G.SAMPLE_KEYS, G.SAMPLE_OVERWRITE, G.SAMPLE_KEEP, locator
    )
    return T.read_table(spark, f"{root}/t", S.SAMPLES).select(
        "user_id", "hk_uuid", "ts", "metric_value", "unit", "deleted_at"
    )


@query("sink_replace_slice", with_parts(f"SELECT {ROLLUP_OUT} FROM hourly"))
def sink_replace_slice(spark, sf):
    """A stale table whose later days are replaced by recomputed ones."""
    path = work_folder(spark, "hourly")
    fresh = R.rollup(A.samples(spark, sf), "hour").select(*ROLLUP.fieldNames())
    late = F.col("bucket_ts") >= F.lit("2024-01-15").cast("timestamp")
    stale = fresh.withColumn("n", F.when(late, F.col("n") + 1).otherwise(F.col("n")))
    T.replace_slice(stale, path, "bucket_ts", R.BUCKET, 2)
    T.replace_slice(fresh.filter(late), path, "bucket_ts", R.BUCKET, 2)
    return rollup_out(T.read_table(spark, path, ROLLUP))


@query("upload_lookup", with_parts("""SELECT user_id, sha256(content) AS content_hash, count(*) AS request_count FROM ups
 WHERE user_id = (SELECT min(user_id) FROM ups) GROUP BY 1, 2"""))
def upload_lookup(spark, sf):
    """The stored ledger read back for one user."""
    path = work_folder(spark, "ledger")
    uploads = A.uploads(spark, sf)
    L.dedupe_content(uploads).write.parquet(path)
    first = uploads.agg(F.min("user_id")).first()[0]
    return T.read_uploads(spark, path, first).select("user_id", "content_hash", "request_count")
