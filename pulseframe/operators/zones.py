"""Zone stamping of samples and localisation of result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseframe.functions import zones as Z
from pulseframe.functions.clean import blank_to_null
from pulseframe.operators.timeline import DAY_S, SLICE, slice_of


#: stretch of time whose zone entries are held together; a client changes zones a few times in it
STRETCH_S = 30 * DAY_S


def zone_index(points: DataFrame, geo: DataFrame, device: DataFrame, ts: str = "ts", width_s: int = STRETCH_S) -> DataFrame:
    """One row for each user and stretch of time that holds a point or an entry: the entries of both
    histories in it, in order, and the ones in force when it begins. An open-ended entry is thus
    carried into later stretches and never laid out over them."""
    entry = lambda df, kind, tz: df.select("user_id", slice_of(F.col("effective_at"), width_s).alias(SLICE), F.lit(kind).alias("kind"),
                                           F.struct(F.col("effective_at").alias("since"), tz.alias("tz")).alias("entry"))
    stated = F.when(F.col("src") == "geocode", Z.known_zone(F.col("tz")))
    entries = entry(geo, "geo", stated).unionByName(entry(device, "dev", Z.known_zone(F.col("tz"))))
    met = points.select("user_id", slice_of(F.col(ts), width_s).alias(SLICE)).distinct()
    none = F.lit(None)
    rows = entries.unionByName(met.select("*", none.cast("string").alias("kind"), none.cast(entries.schema["entry"].dataType).alias("entry")))
    listed = rows.groupBy("user_id", SLICE).agg(*(
        F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("entry")))).alias(k) for k in ("geo", "dev")))
    before = Window.partitionBy("user_id").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k: F.last(F.try_element_at(k, F.lit(-1)), ignorenulls=True).over(before)
    return listed.select("*", last("geo").alias("geo_before"), last("dev").alias("dev_before"))


def stamp_zone(samples: DataFrame, geo: DataFrame, device: DataFrame, ts: str = "ts", width_s: int = STRETCH_S) -> DataFrame:
    """Add the zone a sample was taken in and its offset.

    The geocoded entry in force wins; if the entry in force is only a placeholder, or
    its zone is unknown, the device history decides; before any entry the zone is NULL.
    A sample meets the one index row of its user and stretch, whatever the length of the
    history; samples are joined on both and not sorted by time.
    """
    at = F.col(ts)
    index = zone_index(samples, geo, device, ts, width_s)
    joined = samples.withColumn(SLICE, slice_of(at, width_s)).join(index, ["user_id", SLICE], "left")

    def in_force(k: str) -> Column:
        begun = F.filter(k, lambda e: e["since"] <= at)
        return F.coalesce(F.try_element_at(begun, F.lit(-1)), F.col(f"{k}_before"))["tz"]

    return joined.select(*samples.columns, F.coalesce(in_force("geo"), in_force("dev")).alias("timezone")).withColumn(
        "utc_offset_min", Z.offset_minutes(at, F.col("timezone"))
    )


def workout_tz(rows: DataFrame, workouts: DataFrame) -> DataFrame:
    """Add ``row_tz``: zone in the row's own metadata, else its workout's, else that of the
    user's workout starting at the same instant."""
    stated = workouts.select(
        "user_id", "workout_uuid", "start_ts", Z.zone_from_json(F.col("hk_metadata")).alias("_tz")
    ).filter(F.col("_tz").isNotNull())
    own = Z.zone_from_json(F.col("hk_metadata")) if "hk_metadata" in rows.columns else F.lit(None)
    out = rows.withColumn("_own", own.cast("string"))
    found = ["_own"]
    if "workout_uuid" in rows.columns:
        by_id = stated.groupBy("user_id", "workout_uuid").agg(F.min("_tz").alias("_by_id"))
        out = out.join(by_id, ["user_id", "workout_uuid"], "left")
        found.append("_by_id")
    anchor = next((c for c in ("workout_start_ts", "start_ts") if c in rows.columns), None)
    if anchor:
        by_start = stated.groupBy("user_id", F.col("start_ts").alias(anchor)).agg(
            F.min_by("_tz", "workout_uuid").alias("_by_start")
        )
        out = out.join(by_start, ["user_id", anchor], "left")
        found.append("_by_start")
    return out.select(*rows.columns, F.coalesce(*found).alias("row_tz"))


def _meta_zone(meta: Column) -> Column:
    return blank_to_null(meta["tz_name"])


def bucket_tz(rows: DataFrame, hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """Add ``row_tz``: zone in the row's context, else in the hourly bucket of the same
    instant, else (if no such bucket is stored) in the daily one."""
    keys = ["user_id", "bucket_ts"] + (["metric_type"] if "metric_type" in rows.columns else [])

    def lookup(table: DataFrame, out: str) -> DataFrame:
        return table.groupBy(*keys).agg(F.min(_meta_zone(F.col("meta"))).alias(out), F.lit(True).alias(f"{out}_hit"))

    own = _meta_zone(F.col("meta")) if "meta" in rows.columns else F.lit(None).cast("string")
    joined = rows.join(lookup(hourly, "_h"), keys, "left").join(lookup(daily, "_d"), keys, "left")
    stored = F.when(F.col("_h_hit"), F.col("_h")).otherwise(F.col("_d"))
    return joined.select(*rows.columns, F.coalesce(own, stored).alias("row_tz"))


def sleep_tz(rows: DataFrame, nights: DataFrame) -> DataFrame:
    """Add ``row_tz``: zone in the row's context, else that of the stored night."""
    stored = nights.select("user_id", "sleep_date", _meta_zone(F.col("meta")).alias("_n"))
    own = _meta_zone(F.col("meta")) if "meta" in rows.columns else F.lit(None).cast("string")
    return rows.join(stored, ["user_id", "sleep_date"], "left").select(
        *rows.columns, F.coalesce(own, F.col("_n")).alias("row_tz")
    )


def event_tz(rows: DataFrame, events: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``row_tz``: zone in the metadata of the user's workout row at the same instant."""
    stated = (
        events.filter(F.col("event_type").like("workout_%"))
        .groupBy("user_id", F.col("ts").alias(ts))
        .agg(F.min_by(Z.zone_from_json(F.col("hk_metadata")), "hk_uuid").alias("row_tz"))
    )
    return rows.join(stated, ["user_id", ts], "left")


def localise(
    rows: DataFrame, ts_cols: Sequence[str], request_tz: str, out_tz: str, tz_col: str = "row_tz"
) -> DataFrame:
    """Display text for instants in the row's zone, else the request zone, else UTC.

    ``out_tz`` names the row's zone where that zone was used.
    """
    zone = F.coalesce(out_tz, Z.safe_zone(request_tz))
    return (
        rows.withColumn(out_tz, Z.known_zone(F.col(tz_col)))
        .withColumns({c: Z.display(F.col(c), zone) for c in ts_cols})
        .drop(tz_col)
    )


def localise_rollups(rows, hourly, daily, request_tz: str) -> DataFrame:
    return localise(bucket_tz(rows, hourly, daily), ["bucket_ts"], request_tz, "bucket_tz")


def localise_workouts(rows, workouts, request_tz: str) -> DataFrame:
    cols = [c for c in ("start_ts", "end_ts", "workout_start_ts") if c in rows.columns]
    return localise(workout_tz(rows, workouts), cols, request_tz, "event_tz")


def localise_sleep(rows, nights, request_tz: str) -> DataFrame:
    return localise(sleep_tz(rows, nights), ["sleep_start_ts", "sleep_end_ts"], request_tz, "event_tz")


def localise_events(rows, events, request_tz: str, ts: str = "ts") -> DataFrame:
    return localise(event_tz(rows, events, ts), [ts], request_tz, "event_tz")
