"""Upserts, tombstones, cascades and incremental refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.registry import query
from pulseframe.catalog.shape import rollup_out
from pulseframe.catalog.sql import ROLLUP_OUT, with_parts
from pulseframe.functions import meta as M
from pulseframe.operators import merge as G, rollup as R, splits as P, workouts as W
from pulseframe.sources import adapter as A

AT = "2024-03-01 00:00:00"
BASE_TS = "TIMESTAMP '2024-03-01'"


def _at():
    return F.lit(AT).cast("timestamp")


@query("upsert_samples", with_parts("""SELECT s.user_id, s.hk_uuid, s.ts, s.metric_type,
 coalesce(b.metric_value, s.metric_value) AS metric_value, coalesce(b.unit, s.unit) AS unit,
 CASE WHEN b.hk_uuid IS NULL THEN s.deleted_at END AS deleted_at, s.hk_source_name
 FROM samples s LEFT JOIN batch b USING (user_id, hk_uuid)"""))
def upsert_samples(spark, sf):
    merged = G.merge_samples(A.samples(spark, sf), A.upsert_batch(spark, sf))
    return merged.select(
        "user_id", "hk_uuid", "ts", "metric_type", "metric_value", "unit", "deleted_at", "hk_source_name"
    )


@query("upsert_events", with_parts("""SELECT user_id, hk_uuid, event_type, CASE WHEN hit THEN value * 2 ELSE value END AS value,
 CASE WHEN NOT hit THEN deleted_at END AS deleted_at, unit, source
 FROM (SELECT *, CAST(substr(workout_uuid, 3) AS BIGINT) % 3 = 0 AS hit FROM wevents)"""))
def upsert_events(spark, sf):
    base = A.workout_events(spark, sf)
    number = F.regexp_extract("hk_uuid", r"W-(\d+)", 1).cast("long")
    batch = base.filter(number % 3 == 0).withColumns(
        {"value": F.col("value") * 2, "source": F.lit(None).cast("string"), "ordinal": number}
    )
    return G.merge_events(base, batch).select(
        "user_id", "hk_uuid", "event_type", "value", "deleted_at", "unit", "source"
    )


@query("tombstone", with_parts(f"""SELECT user_id, hk_uuid, CASE WHEN event_id % 50 = 0 THEN {BASE_TS} ELSE deleted_at END AS deleted_at FROM samples"""))
def tombstone(spark, sf):
    ids = A.mirror_samples(spark, sf).filter("event_id % 50 = 0").select("user_id", "hk_uuid")
    return G.tombstone(A.samples(spark, sf), ids, _at()).select("user_id", "hk_uuid", "deleted_at")


@query("prune", with_parts("""SELECT user_id, hk_uuid, ts FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM samples)
 WHERE ts >= m - INTERVAL 10 DAY"""))
def prune(spark, sf):
    from pulseframe.operators.clean import retention_cutoffs

    cutoffs = retention_cutoffs(A.mirror_samples(spark, sf), 10)
    return G.prune(A.samples(spark, sf), cutoffs).select("user_id", "hk_uuid", "ts")


@query("cascade_delete", with_parts("SELECT user_id, workout_uuid, start_ts FROM allw WHERE op <> 'delete'",
 allw="SELECT user_id, workout_uuid, ts AS start_ts, op FROM facts"))
def cascade_delete(spark, sf):
    facts = A.workout_facts(spark, sf)
    derived = facts.select("user_id", "workout_uuid", F.col("ts").alias("start_ts"))
    ids = W.expand_deletes(
        facts.filter("op = 'delete'").select("user_id", F.col("workout_uuid").alias("hk_uuid"), "op")
    )
    return G.cascade_delete(derived, G.deleted_workouts(G.deleted_ids(ids)))


@query("cascade_flags", with_parts(f"""SELECT user_id, hk_uuid, CASE WHEN op = 'delete' THEN {BASE_TS} END AS deleted_at
 FROM (SELECT user_id, workout_uuid || '|event_hard_workout' AS hk_uuid, op FROM facts
  UNION ALL SELECT user_id, workout_uuid || '|event_long_run_km', op FROM facts)"""))
def cascade_flags(spark, sf):
    facts = A.workout_facts(spark, sf)
    flags = facts.select(
        "user_id", F.explode(F.array(F.lit("event_hard_workout"), F.lit("event_long_run_km"))).alias("f"), "workout_uuid"
    ).select("user_id", F.concat_ws("|", "workout_uuid", "f").alias("hk_uuid"), F.lit(None).cast("timestamp").alias("deleted_at"))
    ids = facts.filter("op = 'delete'").select("user_id", "workout_uuid")
    return G.cascade_flags(flags, ids, _at())


# the latest three days arrive as a batch; deletes come from anywhere
WINDOW = """SELECT user_id, min(ts) AS t_min, max(ts) AS t_max FROM (
 SELECT user_id, ts FROM mirror WHERE ts >= TIMESTAMP '2024-01-20'
 UNION ALL SELECT user_id, ts FROM samples WHERE event_id % 400 = 0) GROUP BY 1"""


def _window(spark, sf):
    m = A.mirror_samples(spark, sf)
    batch = m.filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp"))
    ids = m.filter("event_id % 400 = 0").select("user_id", "hk_uuid")
    return G.affected_window(batch, A.samples(spark, sf), ids)


@query("affected_window", with_parts("SELECT * FROM win", win=WINDOW))
def affected_window(spark, sf):
    return _window(spark, sf)


@query("align_window", with_parts("""SELECT user_id, date_trunc('day', t_min) AS d0, date_trunc('day', t_max) + INTERVAL 1 DAY AS d1,
 date_trunc('hour', t_min) AS h0, date_trunc('hour', t_max) + INTERVAL 1 HOUR AS h1 FROM win""", win=WINDOW))
def align_window(spark, sf):
    windows = _window(spark, sf)
    days = G.align_window(windows, "day").withColumnsRenamed({"t0": "d0", "t1": "d1"})
    hours = G.align_window(windows, "hour").withColumnsRenamed({"t0": "h0", "t1": "h1"})
    return days.join(hours, "user_id")


@query("refresh_rollup", with_parts(f"SELECT {ROLLUP_OUT} FROM hourly"))
def refresh_rollup(spark, sf):
    """Refreshing a stale table over the changed window gives the same as a full rollup."""
    samples = A.samples(spark, sf)
    edge = F.lit("2024-01-20").cast("timestamp")
    stale = R.rollup(samples, "hour").withColumn(
        "max_value", F.when(F.col("bucket_ts") >= edge, F.col("max_value") + 100).otherwise(F.col("max_value"))
    )
    windows = samples.filter(F.col("ts") >= edge).groupBy("user_id").agg(
        F.lit(None).cast("timestamp").alias("x"), F.max("ts").alias("t_max")
    ).select("user_id", edge.alias("t_min"), "t_max")
    return rollup_out(G.refresh_rollup(stale, samples, windows, "hour"))


@query("upsert_workouts", with_parts("""SELECT user_id, workout_uuid, workout_type,
 CASE WHEN n % 2 = 0 THEN start_ts + INTERVAL 1 HOUR ELSE start_ts END AS start_ts,
 CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN distance_km + 1 ELSE distance_km END AS distance_km, end_ts
 FROM (SELECT *, CAST(substr(workout_uuid, 3) AS BIGINT) AS n FROM wk)"""))
def upsert_workouts(spark, sf):
    base = W.workouts(A.workout_events(spark, sf))
    n = F.regexp_extract("workout_uuid", r"(\d+)", 1).cast("long")
    new = base.filter(n % 2 == 0).withColumns(
        {
            "start_ts": F.col("start_ts") + F.expr("interval 1 hour"),
            "distance_km": F.when(n % 3 != 0, F.col("distance_km") + 1),
            "end_ts": F.lit(None).cast("timestamp"),
            "workout_type": F.lit(None).cast("string"),
        }
    )
    return W.upsert_workouts(base, new).select(
        "user_id", "workout_uuid", "workout_type", "start_ts", "distance_km", "end_ts"
    )


@query("replace_splits", with_parts("""SELECT user_id, workout_uuid, segment_unit, segment_index,
 CASE WHEN CAST(substr(workout_uuid, 3) AS BIGINT) % 2 = 0 THEN start_ts + INTERVAL 1 MINUTE ELSE start_ts END AS start_ts, end_ts FROM parts"""))
def replace_splits(spark, sf):
    parts = _parts(spark, sf).select(*P.SPLIT, "start_ts", "end_ts")
    even = F.regexp_extract("workout_uuid", r"(\d+)", 1).cast("long") % 2 == 0
    new = parts.filter(even).withColumn("start_ts", F.col("start_ts") + F.expr("interval 1 minute"))
    ids = W.workouts(A.workout_events(spark, sf)).filter(even).select("user_id", "workout_uuid")
    return G.replace_splits(parts, new, ids)


def _parts(spark, sf):
    stream = P.distance_stream(A.samples(spark, sf), W.workouts(A.workout_events(spark, sf)))
    return P.splits(stream)


@query("touched_workouts", with_parts("""SELECT DISTINCT user_id, workout_uuid FROM (
 SELECT user_id, workout_uuid FROM wevents WHERE CAST(substr(workout_uuid, 3) AS BIGINT) % 9 = 0
 UNION ALL SELECT e.user_id, e.workout_uuid FROM wevents e JOIN win w USING (user_id)
 WHERE e.deleted_at IS NULL AND e.event_type = 'workout_duration_min' AND e.ts >= w.t_min AND e.ts < w.t_max + INTERVAL 72 HOUR)""", win=WINDOW))
def touched_workouts(spark, sf):
    events = A.workout_events(spark, sf)
    upserted = events.filter(F.regexp_extract("hk_uuid", r"W-(\d+)", 1).cast("long") % 9 == 0)
    return G.touched_workouts(events, upserted.select("user_id", "hk_uuid"), _window(spark, sf))


@query("union_ids", with_parts("SELECT user_id, hk_uuid FROM samples WHERE event_id % 3 = 0 OR event_id % 5 = 0"))
def union_ids(spark, sf):
    from pulseframe.operators.ranking import union_ids as union

    m = A.mirror_samples(spark, sf)
    a = m.filter("event_id % 3 = 0").select("user_id", "hk_uuid")
    b = m.filter("event_id % 5 = 0").select("user_id", "hk_uuid")
    return union(a, b)


@query("backfill_sources", with_parts("""SELECT hk_uuid, CASE WHEN k % 2 = 0 THEN '[]' WHEN hk_source_name IS NOT NULL
 THEN CAST(to_json([{'name': hk_source_name, 'version': hk_source_version}]) AS VARCHAR) ELSE '[]' END AS hk_sources FROM mirror"""))
def backfill_sources(spark, sf):
    m = A.mirror_samples(spark, sf)
    rows = m.withColumn("hk_sources", F.when(F.col("k") % 2 == 0, M.no_sources()))
    return G.backfill_sources(rows).select("hk_uuid", M.sources_json(F.col("hk_sources")).alias("hk_sources"))


@query("backfill_from_json", with_parts("""SELECT hk_uuid, coalesce(hk_source_name, CASE WHEN k % 5 = 0 THEN 'Europe/Paris' END) AS hk_source_name,
 coalesce(hk_source_version, CASE WHEN k % 5 = 1 THEN '1' END) AS hk_source_version FROM mirror"""))
def backfill_from_json(spark, sf):
    rows = A.mirror_samples(spark, sf).select("hk_uuid", "hk_source_name", "hk_source_version", "hk_metadata")
    mapping = {"hk_source_name": "$.HKTimeZone", "hk_source_version": "$.x"}
    return G.backfill_from_json(rows, "hk_metadata", mapping).drop("hk_metadata")


@query("semi_ids", with_parts("SELECT user_id, hk_uuid, metric_value FROM samples WHERE event_id % 20 = 0"))
def semi_ids(spark, sf):
    from pulseframe.operators.ranking import semi_ids as semi

    ids = A.mirror_samples(spark, sf).filter("event_id % 20 = 0").select("user_id", "hk_uuid")
    return semi(A.samples(spark, sf), ids, ["user_id", "hk_uuid"]).select("user_id", "hk_uuid", "metric_value")
