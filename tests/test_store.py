"""A batch reads and writes the parts it has to, and no other."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.plans.ingest import Store
from pulseframe.sources import tables as T
from tests.test_ingest import apply, line


def files(root):
    return {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(root).rglob("*.parquet") if "_staging" not in str(p)}


def part(path):
    return tuple(x.split("=")[-1] for x in str(path.parent).split(os.sep)[-2:])


@pytest.fixture(scope="module")
def users(spark):
    """Two users of different buckets."""
    names = spark.createDataFrame([(f"u{i}",) for i in range(9)], "user_id string").select("user_id", T.bucket_of().alias("b")).collect()
    first = names[0]
    return (first.user_id, str(first.b)), next((r.user_id, str(r.b)) for r in names if r.b != first.b)


def test_a_late_row_touches_one_part_and_reads_no_other(spark, tmp_path, users):
    (a, bucket_a), (b, bucket_b) = users
    store = Store(spark, str(tmp_path / "store"))
    days = ("2024-01-02", "2024-01-10", "2024-01-20", "2024-02-10")
    rows = [line(f"{u}{d}{k}", f"{d}T1{k}:00:00Z", "heart_rate", "60", user=u) for u in (a, b) for d in days for k in range(3)]
    rows += [line(f"{u}W|{x}", "2024-01-10T12:00:00Z", x, "30", "2024-01-10T12:30:00Z", user=u, source="yoga") for u in (a, b) for x in S.WORKOUT_ATTRIBUTES]
    apply(spark, store, tmp_path, "one", rows)
    before = files(store.root)
    # whatever else is read fails: other buckets, other days of the raw samples and of the rollups
    for p in before:
        where = part(p)
        name = p.relative_to(store.root).parts[0]
        bucket = where[-1]
        if bucket != bucket_a or (name in ("samples", "rollup_hourly", "rollup_daily") and where[0] not in ("2024-01-10",)):
            p.write_bytes(b"not parquet")
            (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    spoiled = files(store.root)
    counts = apply(spark, store, tmp_path, "two", [line(f"{a}2024-01-100", "2024-01-10T10:30:00Z", "heart_rate", "90", user=a)])
    assert counts == {"metric": 1}
    after = files(store.root)
    changed = {(p.relative_to(store.root).parts[0], part(p)) for p in spoiled.keys() ^ after.keys()} | {
        (p.relative_to(store.root).parts[0], part(p)) for p in spoiled.keys() & after.keys() if spoiled[p] != after[p]}
    assert {c for c in changed if c[0] in ("samples", "rollup_hourly", "rollup_daily")} == {
        (n, ("2024-01-10", bucket_a)) for n in ("samples", "rollup_hourly", "rollup_daily")}
    assert {c[1][-1] for c in changed} == {bucket_a}
    got = store.read("rollup_daily").filter((F.col("day") == "2024-01-10") & (F.col("user_bucket") == int(bucket_a))).collect()
    assert [(r.user_id, r.n, r.max_value) for r in got] == [(a, 3, 90.0)]


def test_plan_of_a_look_up(spark, tmp_path, users):
    (a, bucket_a), _ = users
    locator = T.Locator(spark, str(tmp_path / "keys"))
    rows = spark.createDataFrame([(a, f"k{i}|x", f"2024-01-{1 + i % 28:02d}") for i in range(200)], "user_id string, hk_uuid string, d string")
    locator.add(rows, F.to_date("d"))
    keys = spark.createDataFrame([(a, "k3|y"), (a, "k3|y"), (a, "unknown")], "user_id string, hk_uuid string")
    assert locator.parts(keys) == {(__import__("datetime").date(2024, 1, 4), int(bucket_a))}
    plan = locator.near(keys)._jdf.queryExecution().executedPlan().toString()
    assert f"user_bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_locator_keeps_all_places_and_compacts(spark, tmp_path, users):
    (a, bucket), _ = users
    locator = T.Locator(spark, str(tmp_path / "keys"))
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        locator.add(spark.createDataFrame([(a, "k", day), (a, "other", day)], "user_id string, hk_uuid string, d string"), F.to_date("d"))
    keys = spark.createDataFrame([(a, "k")], "user_id string, hk_uuid string")
    assert len(locator.parts(keys)) == 2 and locator.entries().count() == 6
    locator.compact(1)
    assert len(locator.parts(keys)) == 2 and locator.entries().count() == 4
    assert [p.name for p in (tmp_path / "keys").iterdir() if p.is_dir()] == ["1"]
    locator.add(spark.createDataFrame([(a, "k", "2024-01-05")], "user_id string, hk_uuid string, d string"), F.to_date("d"))
    assert len(locator.parts(keys)) == 3
    assert T.Locator(spark, str(tmp_path / "none")).parts(keys) == set()


def test_pairs_of_days_and_buckets(spark, tmp_path):
    base = spark.range(400).select(
        F.concat(F.lit("u"), F.col("id") % 40).alias("user_id"), (F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 9_000)).alias("ts"))
    T.replace_slice(base, str(tmp_path / "t"), "ts", ("user_id",))
    table = T.read_table(spark, str(tmp_path / "t"), base.schema)
    wanted = set(sorted(T.parts_of(table))[3:40:7])
    got = T.on_parts(table, wanted)
    assert T.parts_of(got) == wanted
    for p in (tmp_path / "t").rglob("*.parquet"):
        if part(p) not in {(str(d), str(b)) for d, b in wanted}:
            p.write_bytes(b"not parquet")
            (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    assert len(got.collect()) >= len(wanted) and T.on_parts(table, set()).count() == 0


def test_ends_without_sense_are_cut(spark, tmp_path):
    """An end in the year 9999 costs nothing and reaches at most the longest span."""
    store = Store(spark, str(tmp_path / "store"))
    rows = [line(f"W|{x}", "2024-01-10T12:00:00Z", x, v, "9999-12-31T00:00:00Z", source="running") for x, v in zip(S.WORKOUT_ATTRIBUTES, ("5", "1e12", "9"))]
    rows += [line("D|workout_duration_min", "2024-01-11T12:00:00Z", "workout_duration_min", "1e12", source="yoga")]
    rows += [line("s", "2024-01-10T23:00:00Z", "sleep_core_minutes", "60", "9999-12-31T00:00:00Z"), line("h", "2024-01-10T12:10:00Z", "heart_rate", "60")]
    assert apply(spark, store, tmp_path, "one", rows) == {"cut": 4, "event": 1, "metric": 1}
    ends = {r.workout_uuid: str(r.end_ts) for r in store.read("workouts").collect()}
    assert ends == {"W": "2024-02-10 12:00:00", "D": "2024-02-11 12:00:00"}
