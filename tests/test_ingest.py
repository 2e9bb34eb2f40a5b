"""Batches applied one after the other give what one full computation gives."""

import pytest
from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.operators import rollup as R, sleep as L
from pulseframe.plans.ingest import Store, apply_batch
from pulseframe.sources import mirror_csv

HEADER = ",".join(S.MIRROR_COLUMNS)


def line(uuid, ts="", kind="", value="", end="", op="upsert", user="u", unit="", source="", zone="UTC", meta=""):
    cells = [user, ts, kind, value, unit, source, zone, "", "", "", "", "", op, uuid, end, "", "Watch", "1", meta]
    return ",".join(cells)


def apply(spark, store, folder, name, lines):
    path = folder / f"{name}.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    counts = apply_batch(store, mirror_csv.read_mirror_csv(spark, str(path)), name, F.lit("2024-03-01").cast("timestamp"))
    return {r.outcome: r.n for r in counts.collect()}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    first = [
        line("h1", "2024-01-10T10:05:00Z", "heart_rate", "60", unit="bpm"),
        line("h2", "2024-01-10T10:40:00Z", "heart_rate", "80", unit="bpm"),
        line("h3", "2024-01-11T09:00:00Z", "heart_rate", "70"),
        line("o1", "2024-01-10T10:10:00Z", "heart_rate", "99", user="other"),
        line("s1", "2024-01-10T23:00:00Z", "sleep_core_minutes", "120", "2024-01-11T01:00:00Z"),
        line("s2", "2024-01-11T01:30:00Z", "sleep_rem_minutes", "60", "2024-01-11T02:30:00Z"),
        line("d1", "2024-01-10T08:00:00Z", "distance_walking_running_km", "2.5", "2024-01-10T08:25:00Z"),
        line("W|workout_distance_km", "2024-01-10T08:00:00Z", "workout_distance_km", "2.5", source="running"),
        line("W|workout_duration_min", "2024-01-10T08:00:00Z", "workout_duration_min", "30", source="running"),
        line("W|workout_energy_kcal", "2024-01-10T08:00:00Z", "workout_energy_kcal", "200", source="running"),
        line("bad", "2024-01-10T08:00:00Z", "heart_rate", "n/a"),
    ]
    counts = [apply(spark, store, folder, "one", first)]
    late = [
        line("h2", op="delete"),
        line("h1", "2024-01-10T10:05:00Z", "heart_rate", "64"),
        line("s0", "2024-01-10T22:00:00Z", "sleep_deep_minutes", "60", "2024-01-10T23:00:00Z"),
        line("x1", "2024-01-10T08:10:00Z", "heart_rate", "150", unit="bpm"),
    ]
    counts.append(apply(spark, store, folder, "two", late))
    return store, counts


def test_counts_by_outcome(store):
    assert store[1][0] == {"metric": 7, "event": 3, "dropped": 1}
    assert store[1][1] == {"deleted": 1, "metric": 3}


def test_rollups_equal_a_full_computation(store):
    s = store[0]
    for name, unit in (("rollup_hourly", "hour"), ("rollup_daily", "day")):
        full = R.rollup(s.read("samples"), unit).select(*S.ROLLUP.fieldNames())
        kept = s.read(name).drop("day", "user_bucket")
        assert sorted(map(str, kept.collect())) == sorted(map(str, full.collect()))
    hour = s.read("rollup_hourly").filter("user_id = 'u' AND bucket_ts = '2024-01-10 10:00:00'").first()
    assert (hour.n, hour.avg_value, hour.unit) == (1, 64.0, "bpm")


def test_late_sleep_extends_the_night(store):
    s = store[0]
    (night,) = s.read("sleep_daily").collect()
    assert (str(night.sleep_date), night.asleep_minutes, night.deep_minutes) == ("2024-01-11", 240.0, 60.0)
    full = L.sleep_daily_from_segments(L.sleep_segments(L.label_sleep(s.read("samples"))))
    assert full.count() == 1 and s.read("sleep_segments").count() == 3


def test_late_heart_rate_reaches_the_splits(store):
    s = store[0]
    (workout,) = s.read("workouts").collect()
    assert (workout.workout_type, workout.duration_min) == ("running", 30.0)
    km = {r.segment_index: r for r in s.read("workout_splits").filter("segment_unit = 'km'").collect()}
    assert len(km) == 2 and km[1].duration_min == 10.0
    assert km[1].avg_hr_bpm is None and km[2].avg_hr_bpm == 150.0


def test_replay_changes_nothing(spark, store, tmp_path):
    s = store[0]
    before = {n: sorted(map(str, s.read(n).collect())) for n in ("samples", "rollup_daily", "sleep_daily", "workout_splits")}
    again = [line("x1", "2024-01-10T08:10:00Z", "heart_rate", "150", unit="bpm")]
    apply(spark, s, tmp_path, "again", again)
    assert before == {n: sorted(map(str, s.read(n).collect())) for n in before}


def test_workout_delete_cascades(spark, store, tmp_path):
    s = store[0]
    ids = [f"W|{a}" for a in S.WORKOUT_ATTRIBUTES] + ["W"]
    apply(spark, s, tmp_path, "gone", [line(i, op="delete") for i in ids])
    assert s.read("workouts").count() == 0 and s.read("workout_splits").count() == 0
    assert s.read("events").filter("deleted_at IS NULL").count() == 0
    assert s.read("samples").filter("hk_uuid = 'd1'").count() == 1


def test_last_deleted_segment_removes_the_night(spark, store, tmp_path):
    s = store[0]
    apply(spark, s, tmp_path, "nosleep", [line(i, op="delete") for i in ("s0", "s1", "s2")])
    assert s.read("sleep_daily").count() == 0 and s.read("sleep_segments").count() == 0


def test_old_rows_are_pruned(spark, store, tmp_path):
    s = store[0]
    counts = apply(spark, s, tmp_path, "new", [
        line("n1", "2024-03-11T12:00:00Z", "heart_rate", "61"), line("n0", "2023-12-01T00:00:00Z", "heart_rate", "61"),
    ])
    assert counts == {"metric": 1, "expired": 1}
    left = {r.hk_uuid for r in s.read("samples").filter("user_id = 'u'").collect()}
    assert left == {"n1"}
    assert s.read("samples").filter("user_id = 'other'").count() == 1


def full(store):
    """Derived tables computed from all stored samples, to compare with the maintained ones."""
    live = store.read("samples").drop("day", "user_bucket")
    night = L.sleep_daily_from_segments(L.sleep_segments(L.label_sleep(live)))
    return {
        "rollup_hourly": R.rollup(live, "hour").select(*S.ROLLUP.fieldNames()),
        "rollup_daily": R.rollup(live, "day").select(*S.ROLLUP.fieldNames()),
        "sleep_daily": night.select(*S.NIGHTS.fieldNames()),
    }


def same(store):
    for name, want in full(store).items():
        got = store.read(name).drop("day", "user_bucket")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name


def test_a_moved_sample_leaves_its_old_bucket(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    apply(spark, s, tmp_path, "one", [
        line("a", "2024-01-10T10:00:00Z", "heart_rate", "10"), line("b", "2024-01-11T10:00:00Z", "heart_rate", "20"),
        line("s", "2024-01-10T23:00:00Z", "sleep_core_minutes", "120", "2024-01-11T01:00:00Z"),
    ])
    apply(spark, s, tmp_path, "two", [
        line("a", "2024-01-13T10:00:00Z", "heart_rate", "10"),
        line("s", "2024-01-15T23:00:00Z", "sleep_core_minutes", "120", "2024-01-16T01:00:00Z"),
    ])
    same(s)
    days = {str(r.bucket_ts.date()) for r in s.read("rollup_daily").collect()}
    assert days == {"2024-01-11", "2024-01-13"}
    assert [str(r.sleep_date) for r in s.read("sleep_daily").collect()] == ["2024-01-16"]
    assert not (tmp_path / "store" / "_staging" / "two").exists()


def test_replay_after_a_failure_between_raw_and_derived(spark, tmp_path, monkeypatch):
    from pulseframe.plans import ingest

    s = Store(spark, str(tmp_path / "store"))
    apply(spark, s, tmp_path, "one", [line("a", "2024-01-10T10:00:00Z", "heart_rate", "10"), line("b", "2024-01-10T11:00:00Z", "heart_rate", "20")])
    second = [line("a", "2024-01-13T10:00:00Z", "heart_rate", "10"), line("b", op="delete")]
    monkeypatch.setattr(ingest, "_refresh_rollup", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        apply(spark, s, tmp_path, "two", second)
    monkeypatch.undo()
    apply(spark, s, tmp_path, "two", second)
    same(s)


def test_rollups_of_pruned_days_stay(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    apply(spark, s, tmp_path, "one", [line(str(i), f"{d}T10:00:00Z", "heart_rate", "10") for i, d in enumerate(("2023-12-31", "2024-01-01", "2024-01-02", "2024-01-10"))])
    apply(spark, s, tmp_path, "two", [line("9", "2024-03-05T10:00:00Z", "heart_rate", "10"), line("1", op="delete")])
    days = {str(r.bucket_ts.date()) for r in s.read("rollup_daily").collect()}
    assert days == {"2023-12-31", "2024-01-02", "2024-01-10", "2024-03-05"}
