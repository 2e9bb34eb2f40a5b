"""Rollups and aggregates over buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.registry import query
from pulseframe.catalog.shape import rollup_out, rounded
from pulseframe.catalog.sql import ROLLUP_OUT, meta_json, rebucket, with_parts
from pulseframe.functions import meta as M
from pulseframe.operators import rollup as R
from pulseframe.operators.ranking import distinct_keys
from pulseframe.sources import adapter as A

NY = "America/New_York"
INDIA = "Asia/Kolkata"


@query("rollup_hourly", with_parts(f"SELECT {ROLLUP_OUT} FROM hourly"))
def rollup_hourly(spark, sf):
    return rollup_out(R.rollup(A.samples(spark, sf), "hour"))


@query("rollup_daily", with_parts(f"SELECT {ROLLUP_OUT} FROM daily"))
def rollup_daily(spark, sf):
    return rollup_out(R.rollup(A.samples(spark, sf), "day"))


@query("daily_from_hours", with_parts(f"SELECT {ROLLUP_OUT} FROM daily"))
def daily_from_hours(spark, sf):
    """Hourly states of all samples; then the samples before noon expire, those of the evenings are
    sent with other values and sent right again. Days merged from the hours are those of all samples."""
    samples = A.samples(spark, sf)
    hour = F.hour("ts")
    there, evening = samples.filter(hour >= 12), hour >= 18
    hours = samples.filter(evening).select("user_id", F.date_trunc("hour", "ts").alias("hour"))
    wrong = there.withColumn("metric_value", F.when(evening, F.col("metric_value") + 1).otherwise(F.col("metric_value")))
    once = R.refresh_states(R.states(samples), wrong, hours)
    return rollup_out(R.finish(R.merge_states(R.refresh_states(once, there, hours), "day")))


@query("latest_unit", with_parts("SELECT user_id, metric_type, bucket_ts, unit FROM daily"))
def latest_unit(spark, sf):
    return R.compact(A.samples(spark, sf), "day").groupBy(*R.BUCKET).agg(
        R.latest(F.col("unit"), F.col("latest")).alias("unit")
    )


@query("latest_meta", with_parts(f"SELECT user_id, metric_type, bucket_ts, {meta_json('meta.tz', 'meta.off')} AS meta FROM daily"))
def latest_meta(spark, sf):
    rows = R.compact(A.samples(spark, sf), "day").groupBy(*R.BUCKET).agg(
        R.latest_meta("zone", "offset_min", "has_context", "latest").alias("meta")
    )
    return rows.withColumn("meta", M.context_json(F.col("meta")))


@query("distinct_sources", with_parts(
    "SELECT user_id, metric_type, bucket_ts, CAST(to_json(hk_sources) AS VARCHAR) AS hk_sources FROM daily"))
def distinct_sources(spark, sf):
    rows = R.compact(A.samples(spark, sf), "day").groupBy(*R.BUCKET).agg(
        R.distinct_sources().alias("hk_sources")
    )
    return rows.withColumn("hk_sources", M.sources_json(F.col("hk_sources")))


@query("rebucket_hourly_tz", with_parts(f"SELECT {ROLLUP_OUT} FROM rb", rb=rebucket("hourly", "hour", INDIA)))
def rebucket_hourly_tz(spark, sf):
    return rollup_out(R.rebucket_tz(R.rollup(A.samples(spark, sf), "hour"), "hour", INDIA))


@query("rebucket_daily_tz", with_parts(f"SELECT {ROLLUP_OUT} FROM rb", rb=rebucket("daily", "day", NY)))
def rebucket_daily_tz(spark, sf):
    return rollup_out(R.rebucket_tz(R.rollup(A.samples(spark, sf), "day"), "day", NY))


@query("local_day_rollup", with_parts("""SELECT user_id, metric_type,
 date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE coalesce(zone, 'UTC')) AS local_day,
 min(metric_value) AS min_value, max(metric_value) AS max_value, count(*) AS n
 FROM samples WHERE deleted_at IS NULL AND metric_type NOT LIKE 'sleep_%' GROUP BY 1, 2, 3"""))
def local_day_rollup(spark, sf):
    return R.local_day_rollup(A.samples(spark, sf)).select(
        "user_id", "metric_type", "local_day", "min_value", "max_value", "n"
    )


@query("any_non_null", with_parts("SELECT user_id, metric_type, min(unit) AS unit, min(hk_source_name) AS hk_source_name FROM samples GROUP BY 1, 2"))
def any_non_null(spark, sf):
    return R.any_non_null(A.samples(spark, sf), ["user_id", "metric_type"], ["unit", "hk_source_name"])


@query("weighted_avg", with_parts("""SELECT user_id, metric_type, round(sum(avg_value * n) / nullif(sum(n), 0), 6) AS avg_value,
 CAST(sum(n) AS BIGINT) AS n FROM hourly GROUP BY 1, 2"""))
def weighted_avg(spark, sf):
    return rounded(R.weighted_avg(R.rollup(A.samples(spark, sf), "hour"), ["user_id", "metric_type"]), "avg_value")


# a rollup table as an older writer left it, sleep rows included
OLD_ROLLUP = """SELECT user_id, metric_type, date_trunc('hour', ts) AS bucket_ts, count(*) AS n
 FROM samples WHERE deleted_at IS NULL GROUP BY 1, 2, 3"""


@query("drop_sleep_rollups", with_parts("SELECT * FROM old WHERE metric_type NOT LIKE 'sleep_%'", old=OLD_ROLLUP))
def drop_sleep_rollups(spark, sf):
    old = R.live_rows(A.samples(spark, sf)).groupBy(
        "user_id", "metric_type", F.date_trunc("hour", "ts").alias("bucket_ts")
    ).agg(F.count(F.lit(1)).alias("n"))
    return R.drop_sleep_rollups(old)


@query("distinct_pairs", with_parts("SELECT DISTINCT date_trunc('day', ts) AS bucket_ts, metric_type FROM samples"))
def distinct_pairs(spark, sf):
    rows = A.samples(spark, sf).withColumn("bucket_ts", F.date_trunc("day", "ts"))
    return distinct_keys(rows, ["bucket_ts", "metric_type"])
