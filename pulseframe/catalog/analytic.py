"""Sorts, top-k and composed analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.joins import _nights
from pulseframe.catalog.registry import query
from pulseframe.catalog.shape import rounded
from pulseframe.catalog.sql import with_parts
from pulseframe.operators import ranking as K, rollup as R
from pulseframe.plans import analytics as Y
from pulseframe.sources import adapter as A

DELTAS = """SELECT *, level - lag(level) OVER (PARTITION BY user_id, metric_type ORDER BY bucket_ts) AS delta
 FROM (SELECT *, coalesce(sum_value, avg_value) AS level FROM hourly)"""


@query("top_k", with_parts("SELECT hk_uuid, metric_value, ts FROM samples ORDER BY metric_value DESC, hk_uuid LIMIT 20"))
def top_k(spark, sf):
    rows = A.samples(spark, sf).select("hk_uuid", "metric_value", "ts")
    return K.top_k(rows, [F.col("metric_value").desc(), F.col("hk_uuid")], 20)


@query("latest_sleep", with_parts("""SELECT user_id, sleep_date, asleep_minutes FROM (SELECT *, row_number() OVER (
 PARTITION BY user_id ORDER BY sleep_date DESC) AS rn FROM nights) WHERE rn = 1"""))
def latest_sleep(spark, sf):
    return K.latest_sleep(_nights(spark, sf).select("user_id", "sleep_date", "asleep_minutes"))


@query("peaks_deltas", with_parts("""SELECT user_id, metric_type, max(max_value) AS peak, min(min_value) AS dip,
 round(max(delta), 6) AS largest_rise, round(min(delta), 6) AS largest_fall FROM d GROUP BY 1, 2""", d=DELTAS))
def peaks_deltas(spark, sf):
    return rounded(Y.peaks_deltas(R.rollup(A.samples(spark, sf), "hour")), "largest_rise", "largest_fall")


@query("top_deltas", with_parts("""SELECT user_id, metric_type, bucket_ts, round(level, 6) AS level, round(delta, 6) AS delta FROM d
 WHERE delta IS NOT NULL ORDER BY abs(delta) DESC, user_id, metric_type, bucket_ts LIMIT 3""", d=DELTAS))
def top_deltas(spark, sf):
    return rounded(Y.top_deltas(R.rollup(A.samples(spark, sf), "hour")), "level", "delta")


@query("total_and_daily_avg", with_parts("""SELECT user_id, round(sum(sum_value), 6) AS total, count(DISTINCT CAST(bucket_ts AS DATE)) AS days,
 round(sum(sum_value) / count(DISTINCT CAST(bucket_ts AS DATE)), 6) AS per_day FROM hourly WHERE metric_type = 'steps' GROUP BY 1"""))
def total_and_daily_avg(spark, sf):
    return rounded(Y.total_and_daily_avg(R.rollup(A.samples(spark, sf), "hour"), "steps"), "total", "per_day")
