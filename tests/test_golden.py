"""Hand-checked cases for the quirks of mirror data."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.functions import clean as C, meta as M, zones as Z
from pulseframe.operators import (
    chat, clean as O, merge as G, rollup as R, sleep as L, splits as P, zones as N,
)
from pulseframe.sources import mirror_csv


def at(text):
    return dt.datetime.fromisoformat(text)


def samples(spark, rows):
    """Sample rows from dicts; everything not named is NULL."""
    defaults = {"user_id": "u", "metric_value": 1.0, "metric_type": "heart_rate"}
    full = [[{**defaults, **r}.get(c) for c in S.SAMPLES.fieldNames()] for r in rows]
    return spark.createDataFrame(full, S.SAMPLES)


def stage(uuid, start, end, kind="core", **more):
    a, b = at(start), at(end)
    return {
        "hk_uuid": uuid, "ts": a, "end_ts": b, "metric_type": f"sleep_{kind}_minutes",
        "metric_value": (b - a).total_seconds() / 60, **more,
    }


def nights(spark, rows, gap=L.GAP_S):
    df = L.sleep_daily(L.sleep_sessions_of(L.sleep_rows(samples(spark, rows)), gap))
    return {(r.user_id, str(r.sleep_date)): r for r in df.collect()}


# --- upserts and deletes -----------------------------------------------------------

def test_last_row_wins_but_known_values_are_kept(spark):
    base = samples(spark, [])
    batch = samples(spark, [
        {"hk_uuid": "a", "ts": at("2024-01-01"), "metric_value": 1.0, "unit": "bpm", "meta": ("UTC", 0)},
        {"hk_uuid": "a", "ts": at("2024-01-02"), "metric_value": 2.0, "unit": "x"},
        {"hk_uuid": "a", "ts": at("2024-01-03"), "metric_value": 3.0},
    ]).withColumn("ordinal", F.dayofmonth("ts"))
    (row,) = G.merge_samples(base, batch).collect()
    assert (row.metric_value, row.unit, row.ts, row.meta) == (3.0, "x", at("2024-01-03"), None)


def test_merge_is_idempotent(spark):
    base = samples(spark, [{"hk_uuid": "a", "ts": at("2024-01-01")}, {"hk_uuid": "b", "ts": at("2024-01-01")}])
    batch = samples(spark, [{"hk_uuid": "b", "ts": at("2024-01-02")}]).withColumn("ordinal", F.lit(1))
    once = G.merge_samples(base, batch)
    twice = G.merge_samples(once, batch)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_upsert_brings_a_deleted_sample_back(spark):
    base = samples(spark, [{"hk_uuid": "a", "ts": at("2024-01-01")}])
    ids = spark.createDataFrame([("u", "a")], "user_id string, hk_uuid string")
    gone = G.tombstone(base, ids, F.lit("2024-02-01").cast("timestamp"))
    assert gone.first().deleted_at == at("2024-02-01")
    batch = samples(spark, [{"hk_uuid": "a", "ts": at("2024-01-01")}]).withColumn("ordinal", F.lit(1))
    assert G.merge_samples(gone, batch).first().deleted_at is None


def test_bucket_without_samples_disappears(spark):
    rows = samples(spark, [{"hk_uuid": "a", "ts": at("2024-01-01T10:30:00"), "deleted_at": at("2024-02-01")}])
    old = R.rollup(samples(spark, [{"hk_uuid": "a", "ts": at("2024-01-01T10:30:00")}]), "hour")
    window = spark.createDataFrame([("u", at("2024-01-01T10:30:00"), at("2024-01-01T10:30:00"))],
                                   "user_id string, t_min timestamp, t_max timestamp")
    assert old.count() == 1
    assert G.refresh_rollup(old, rows, window, "hour").count() == 0


def test_delete_only_upload_counts_back_from_now(spark):
    rows = spark.createDataFrame([("u", None, "DELETE"), ("v", None, None)], "user_id string, ts timestamp, op string")
    kept = O.retention_filter(rows, 60, F.lit("2024-03-01").cast("timestamp")).collect()
    assert [r.user_id for r in kept] == ["u"]


def test_window_is_widened_by_deleted_rows(spark):
    batch = samples(spark, [{"hk_uuid": "n", "ts": at("2024-01-10")}])
    stored = samples(spark, [{"hk_uuid": "d", "ts": at("2024-01-02")}])
    ids = spark.createDataFrame([("u", "d")], "user_id string, hk_uuid string")
    (w,) = G.affected_window(batch, stored, ids).collect()
    assert (w.t_min, w.t_max) == (at("2024-01-02"), at("2024-01-10"))


def test_upsert_without_id_fails_the_batch(spark):
    rows = spark.createDataFrame([("upsert", " ")], "op string, hk_uuid string")
    with pytest.raises(PySparkException):
        O.identity_guard(rows).collect()


# --- files --------------------------------------------------------------------------

def test_wide_delete_rows_keep_their_columns(spark, tmp_path):
    header = ",".join(S.MIRROR_COLUMNS)
    good = 'u,2024-01-01T00:00:00Z,heart_rate,60.0000,bpm,Watch,UTC,0,,,,2024-01-01T00:01:00Z,upsert,A,,,Watch,1,"{""a"":""x, y""}"'
    wide = "u,,,,,,,,,,,2024-01-01T00:01:00Z,delete,B" + "," * 7
    (tmp_path / "m.csv").write_text("\n".join([header, good, wide]) + "\n")
    rows = mirror_csv.read_mirror_csv(spark, str(tmp_path))
    by_id = {r.hk_uuid: r for r in O.parse_mirror(rows).collect()}
    assert by_id["A"].hk_metadata == '{"a":"x, y"}' and by_id["A"].metric_value == 60.0
    assert by_id["B"].op == "delete" and by_id["B"].metric_type is None
    flagged = {r.hk_uuid: r[S.CORRUPT_COLUMN] is not None for r in rows.collect()}
    assert flagged == {"A": False, "B": True}


def test_deletes_reach_both_tables(spark):
    rows = spark.createDataFrame([("u", "W|workout_distance_km"), ("u", "W"), ("u", " ")], "user_id string, hk_uuid string")
    ids = G.deleted_ids(rows)
    assert ids.count() == 2
    assert [r.workout_uuid for r in G.deleted_workouts(ids).collect()] == ["W"]


# --- metadata and zones ----------------------------------------------------------------

def test_metadata_merge(spark):
    df = spark.createDataFrame([("not json",), ('{"a":null,"tz_name":"old"}',), (None,)], "t string")
    meta = M.context_struct(F.lit("Asia/Kolkata"), F.lit(330))
    out = [r[0] for r in df.select(M.merge_metadata(F.col("t"), meta)).collect()]
    assert out == [
        '{"_raw_hk_metadata":"not json","tz_name":"Asia/Kolkata","utc_offset_min":330}',
        '{"a":null,"tz_name":"Asia/Kolkata","utc_offset_min":330}',
        '{"tz_name":"Asia/Kolkata","utc_offset_min":330}',
    ]


def test_invalid_zone_falls_back_to_the_request_zone(spark):
    rows = spark.createDataFrame(
        [("u", at("2024-01-01T05:00:00"), "No/Where"), ("u", at("2024-07-01T05:00:00"), "Asia/Kolkata")],
        "user_id string, start_ts timestamp, row_tz string",
    )
    out = N.localise(rows, ["start_ts"], "America/New_York", "event_tz").collect()
    assert [(r.start_ts, r.event_tz) for r in out] == [
        ("2024-01-01 12:00 AM", None), ("2024-07-01 10:30 AM", "Asia/Kolkata"),
    ]


def test_day_window_follows_daylight_saving(spark):
    anchor = F.lit("2024-03-10 18:00:00").cast("timestamp")
    lo, hi = Z.day_window(anchor, "America/New_York")
    (row,) = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (row.lo, row.hi) == (at("2024-03-10T05:00:00"), at("2024-03-11T04:00:00"))


def test_utc_day_bucket_is_relabelled_and_absent_values_count_as_zero(spark):
    rows = samples(spark, [{"hk_uuid": "a", "ts": at("2024-01-02T12:00:00"), "metric_value": 60.0}])
    (r,) = R.rebucket_tz(R.rollup(rows, "day"), "day", "America/New_York").collect()
    assert r.bucket_ts == at("2024-01-01T05:00:00")
    assert (r.avg_value, r.sum_value) == (60.0, 0.0)


# --- sleep ----------------------------------------------------------------------------

@pytest.mark.parametrize("start, sessions", [("2024-01-01T04:00:00", 1), ("2024-01-01T04:00:00.000001", 2)])
def test_gap_must_exceed_two_hours(spark, start, sessions):
    rows = samples(spark, [
        stage("a", "2024-01-01T01:00:00", "2024-01-01T02:00:00"), stage("b", start, "2024-01-01T05:00:00"),
    ])
    assert L.session_bounds(L.sleep_sessions_of(L.sleep_rows(rows))).count() == sessions


def test_gap_counts_from_the_previous_row_not_the_latest_end(spark):
    rows = samples(spark, [
        stage("bed", "2024-01-01T00:00:00", "2024-01-01T08:00:00", "in_bed"),
        stage("a", "2024-01-01T00:30:00", "2024-01-01T01:00:00"),
        stage("b", "2024-01-01T04:00:00", "2024-01-01T05:00:00"),
    ])
    assert L.session_bounds(L.sleep_sessions_of(L.sleep_rows(rows))).count() == 2


def test_time_in_bed_widens_the_night_only(spark):
    (night,) = nights(spark, [
        stage("bed", "2024-01-01T00:00:00", "2024-01-01T03:00:00", "in_bed"),
        stage("a", "2024-01-01T01:00:00", "2024-01-01T02:00:00"),
    ]).values()
    assert night.asleep_minutes == 60.0
    assert (night.sleep_start_ts, night.sleep_end_ts) == (at("2024-01-01T00:00:00"), at("2024-01-01T03:00:00"))


@pytest.mark.parametrize("zone, date", [("Asia/Kolkata", "2024-01-02"), ("America/New_York", "2024-01-01")])
def test_night_is_the_local_date_of_waking(spark, zone, date):
    rows = [
        stage("a", "2024-01-01T17:00:00", "2024-01-01T18:00:00"),
        stage("b", "2024-01-01T18:00:00", "2024-01-01T19:00:00", meta=(zone, None)),
    ]
    assert list(nights(spark, rows)) == [("u", date)]


def test_nights_from_segments_agree(spark):
    rows = samples(spark, [
        stage("a", "2024-01-01T01:00:00", "2024-01-01T02:00:00", "rem", hk_source_name="Watch"),
        stage("b", "2024-01-01T02:00:00", "2024-01-01T03:00:00", "awake", hk_source_name="Phone"),
    ])
    direct = L.sleep_daily(L.sleep_sessions_of(L.sleep_rows(rows)))
    again = L.sleep_daily_from_segments(L.sleep_segments(L.label_sleep(rows)))
    assert direct.collect() == again.select(*direct.columns).collect()


# --- splits -----------------------------------------------------------------------------

def workout(spark, kind="running", km=1000.0, start="2024-01-01T00:00:00", end="2024-01-02T00:00:00"):
    return spark.createDataFrame([("u", "W", kind, at(start), at(end), None, km, None, [], None)], S.WORKOUTS)


def distance(uuid, start, end, km):
    return {"hk_uuid": uuid, "ts": at(start), "end_ts": at(end) if end else None,
            "metric_type": "distance_walking_running_km", "metric_value": km}


def split_rows(spark, rows, units=("km",), **kw):
    stream = P.distance_stream(samples(spark, rows), workout(spark, **kw))
    return P.splits(stream, units).orderBy("segment_unit", "segment_index").collect()


def test_ten_tenths_make_one_kilometre(spark):
    rows = [distance(str(i), f"2024-01-01T01:{2 * i:02d}:00", f"2024-01-01T01:{2 * i + 1:02d}:00", 0.1) for i in range(10)]
    rows.append(distance("z", "2024-01-01T05:00:00", "2024-01-01T05:01:00", 0.5))
    (only,) = split_rows(spark, rows)
    assert (only.start_ts, only.end_ts) == (at("2024-01-01T01:00:00"), at("2024-01-01T01:19:00"))


def test_one_long_sample_gives_all_its_splits(spark):
    rows = split_rows(spark, [distance("a", "2024-01-01T01:00:00", "2024-01-01T08:00:00", 700.0)], ("km", "mi"))
    km = [r for r in rows if r.segment_unit == "km"]
    assert len(km) == 700 and len(rows) == 700 + 434
    assert (km[1].start_ts, km[1].end_ts) == (at("2024-01-01T01:00:36"), at("2024-01-01T01:01:12"))


def test_instant_sample_has_no_length(spark):
    (a, b) = split_rows(spark, [distance("a", "2024-01-01T01:00:00", None, 2.5)])
    assert a.end_ts == b.end_ts == at("2024-01-01T01:00:00")


@pytest.mark.parametrize("kind, splits", [("cycling", 0), ("strength", 0), ("walking", 2)])
def test_only_distance_activities_are_split(spark, kind, splits):
    rows = [distance("a", "2024-01-01T01:00:00", "2024-01-01T02:00:00", 2.5)]
    assert len(split_rows(spark, rows, kind=kind)) == splits


def test_split_measures(spark):
    rows = samples(spark, [
        distance("a", "2024-01-01T00:10:00", "2024-01-01T00:20:00", 2.0),
        {"hk_uuid": "h", "ts": at("2024-01-01T00:12:00"), "metric_value": 100.0},
        {"hk_uuid": "i", "ts": at("2024-01-01T00:15:00"), "metric_value": 200.0},
    ])
    parts = P.splits(P.distance_stream(rows, workout(spark)), ("km",))
    a, b = P.split_measures(parts, rows).orderBy("segment_index").collect()
    assert (a.avg_hr_bpm, b.avg_hr_bpm) == (100.0, 200.0)
    assert (a.start_offset_min, a.end_offset_min, a.duration_min, a.pace_s_per_unit) == (10.0, 15.0, 5.0, 300.0)


# --- chat and text ------------------------------------------------------------------------

def test_equal_times_give_one_latest_message(spark):
    rows = spark.createDataFrame([("u", 1, 1, at("2024-01-01")), ("u", 1, 2, at("2024-01-01"))],
                                 "user_id string, conversation_id int, id int, timestamp timestamp")
    assert [r.id for r in chat.latest_message(rows).collect()] == [2]


def test_titles(spark):
    df = spark.createDataFrame([('"Title: Sleep trends."',), ("x" * 80,), ("  ",), (None,)], "t string")
    out = [r[0] for r in df.select(C.clean_title(F.col("t"))).collect()]
    assert out == ["Sleep trends", "x" * 57 + "...", "New Chat", "New Chat"]


def test_minutes_phrasing(spark):
    df = spark.createDataFrame([(405.0,), (59.0,), (60.0,), (None,)], "m double")
    assert [r[0] for r in df.select(C.format_minutes(F.col("m"))).collect()] == ["6 hr 45 min", "59 min", "1 hr 0 min", None]


def test_source_without_version_keeps_its_null(spark):
    rows = samples(spark, [{"hk_uuid": "a", "ts": at("2024-01-01"), "hk_source_name": "Watch"}])
    out = R.rollup(rows, "day").select(M.sources_json(F.col("hk_sources"))).first()[0]
    assert out == '[{"name":"Watch","version":null}]'
