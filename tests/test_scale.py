"""Properties that must hold for any data: slicing never shows, skew never changes results."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from pulseframe.operators import intervals as I, rollup as R, timeline as T
from pulseframe.sources import adapter as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark):
    """Events in which one user holds a third of all rows, with equal instants among them."""
    e = A.events(spark, SF)
    user = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("user_id"))
    ts = F.when(F.col("event_id") % 10 < 3, F.date_trunc("hour", "ts")).otherwise(F.col("ts"))
    return e.withColumns({"user_id": user, "ts": ts}).persist()


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def plain():
    """The window over a whole user that the sliced operators must agree with."""
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


WIDTHS = (3_600, 86_400, 10**7)


def test_width_fits_the_fullest_slice(hot):
    assert T.fit_width(hot, ["user_id"], "ts", 10**6) == T.DAY_S
    narrow = T.fit_width(hot, ["user_id"], "ts", 3)
    assert narrow < T.DAY_S
    fullest = hot.groupBy("user_id", T.slice_of(F.col("ts"), narrow)).count().agg(F.max("count")).first()[0]
    assert fullest <= 3 or narrow == T.WIDTHS_S[-1]


@pytest.mark.parametrize("width", WIDTHS)
def test_previous_equals_plain_lag(hot, width):
    got = T.previous(hot, ["user_id"], "ts", ["event_id"], {"p": "value"}, width).select("event_id", "p")
    assert _sorted(got.fillna(-1)) == _sorted(hot.select("event_id", F.lag("value").over(plain()).alias("p")).fillna(-1))


@pytest.mark.parametrize("width", WIDTHS)
def test_running_sum_equals_plain_window(hot, width):
    got = T.running_sum(hot, ["user_id"], "ts", ["event_id"], {"s": "k"}, width).select("event_id", "s")
    assert _sorted(got) == _sorted(hot.select("event_id", F.sum("k").over(plain())))


@pytest.mark.parametrize("width", WIDTHS)
def test_last_known_equals_plain_window(hot, width):
    rows = hot.withColumn("v", F.when(F.col("k") % 5 == 0, F.col("value")))
    got = T.last_known(rows, ["user_id"], "ts", ["event_id"], {"l": "v"}, width).select("event_id", "l")
    assert _sorted(got.fillna(-1)) == _sorted(rows.select("event_id", F.last("v", True).over(plain()).alias("l")).fillna(-1))


@pytest.mark.parametrize("width", WIDTHS)
def test_sessions_equal_plain_window(hot, width):
    rows = hot.withColumn("e", F.col("ts") + F.make_dt_interval(mins=F.col("k")))
    prev = F.lag("e").over(plain())
    flag = F.when(prev.isNull() | (F.unix_micros("ts") - F.unix_micros(prev) > 7_200_000_000), 1).otherwise(0)
    want = rows.withColumn("f", flag).select("event_id", F.sum("f").over(plain()))
    got = T.sessionize(rows, ["user_id"], "ts", "e", ["event_id"], 7_200, width)
    assert _sorted(got.select("event_id", "session_id")) == _sorted(want)


@pytest.mark.parametrize("width", (60, 3_600, 10**7))
def test_trailing_count_equals_range_window(hot, width):
    us = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_599_999_999, 0)
    want = hot.select("event_id", F.count("*").over(us) - 1)
    got = T.trailing_count(hot.select("event_id", "user_id", "ts"), ["user_id"], "ts", 3_600, width)
    assert _sorted(got.select("event_id", "trailing")) == _sorted(want)


@pytest.mark.parametrize("width", (600, 21_600, 10**6))
def test_interval_join_equals_brute_force(hot, width):
    points = hot.filter("k < 50").select("user_id", "event_id", "ts").toPandas()
    spans = hot.filter("k >= 50").select("user_id", F.col("event_id").alias("span"), F.col("ts").alias("a"),
                                         (F.col("ts") + F.make_dt_interval(mins=F.col("k") * 60)).alias("b"))
    both = points.merge(spans.toPandas(), on="user_id")
    want = both[(both.ts >= both.a) & (both.ts < both.b)][["event_id", "span"]]
    got = I.points_in_spans(hot.filter("k < 50"), spans, ["user_id"], "ts", "a", "b", width).select("event_id", "span")
    assert _sorted(got) == sorted(map(tuple, want.itertuples(index=False)))


def test_hours_add_up_to_days(spark):
    samples = A.samples(spark, SF)
    hours = R.rollup(samples, "hour").groupBy("user_id", "metric_type", F.date_trunc("day", "bucket_ts").alias("d")).agg(
        F.sum("n").alias("n"), F.round(F.sum("sum_value"), 6).alias("s"), F.max("max_value").alias("m"))
    days = R.rollup(samples, "day").select(
        "user_id", "metric_type", F.col("bucket_ts").alias("d"), "n", F.round("sum_value", 6).alias("s"), F.col("max_value").alias("m"))
    assert hours.exceptAll(days).count() == 0 and days.exceptAll(hours).count() == 0


def test_trailing_count_of_a_busy_minute(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("u", i, start + dt.timedelta(milliseconds=900 * i)) for i in range(61)]
    rows += [("u", 61, start + dt.timedelta(seconds=60)), ("u", 62, start + dt.timedelta(seconds=60, milliseconds=1))]
    df = spark.createDataFrame(rows, "user_id string, event_id bigint, ts timestamp")
    trailing = {r.event_id: r.trailing for r in T.trailing_count(df, ["user_id"], "ts").collect()}
    assert trailing[60] == 60 and trailing[62] > 60 - 1
