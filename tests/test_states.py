"""Rollups from mergeable parts, and from differences of changing samples."""

import datetime as dt

from pyspark.sql import functions as F

from pulseframe import schema as S
from pulseframe.catalog import streams
from pulseframe.functions import meta as M
from pulseframe.operators import rollup as R
from pulseframe.sources import adapter as A
from pulseframe.streaming import retract

DAY = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def _at(hour, minute=0):
    return DAY + dt.timedelta(hours=hour, minutes=minute)


def _samples(spark, rows):
    """``hk_uuid, ts, metric_type, value, unit, source`` as stored samples."""
    full = [{"user_id": "u", "hk_uuid": i, "ts": t, "metric_type": m, "metric_value": v, "unit": unit, "hk_source_name": s} for i, t, m, v, unit, s in rows]
    return spark.createDataFrame([tuple(r.get(f) for f in S.SAMPLES.fieldNames()) for r in full], S.SAMPLES)


def test_a_day_keeps_hours_whose_samples_expired(spark):
    average, total = S.AVERAGE_METRICS[0], S.SUM_METRICS[0]
    early = [("a", _at(2), average, 10.0, "x", "Watch"), ("b", _at(2), total, 5.0, None, None)]
    late = [("c", _at(20), average, 20.0, None, "Phone"), ("d", _at(20), total, 7.0, "y", None)]
    stored = R.states(_samples(spark, early + late))
    changed = [("c", _at(20), average, 40.0, None, "Phone"), late[1]]
    hours = spark.createDataFrame([("u", _at(20))], "user_id string, hour timestamp")
    fresh = R.refresh_states(stored, _samples(spark, changed), hours)  # the early ones are pruned
    day = {r.metric_type: r for r in R.finish(R.merge_states(fresh, "day")).collect()}
    assert (day[average].n, day[average].avg_value, day[average].min_value, day[average].unit) == (2, 25.0, 10.0, "x")
    assert [s.name for s in day[average].hk_sources] == ["Phone", "Watch"]
    assert (day[total].n, day[total].sum_value, day[total].avg_value, day[total].unit) == (2, 12.0, None, "y")


def test_states_merge_in_any_grouping(spark):
    samples = A.samples(spark, SF)
    part = F.xxhash64("hk_uuid") % 3 == 0
    two = R.states(samples.filter(part)).unionByName(R.states(samples.filter(~part)))
    cols = [c for c in S.ROLLUP.fieldNames() if c in R.finish(two).columns]
    exact = lambda df: sorted(map(repr, df.select(*(F.round(c, 6) if c in ("avg_value", "sum_value") else F.col(c) for c in cols)).collect()))
    for unit in ("hour", "day"):
        assert exact(R.finish(R.merge_states(two, unit))) == exact(R.rollup(samples, unit))
    assert R.finish(R.merge_states(R.states(samples.limit(0)), "day")).count() == 0


def test_metadata_is_parsed_once(spark):
    df = spark.createDataFrame([(t,) for t in ('{"a": 1}', ' {"b": "x"}', "[1]", "null", "3", "{broken", "", None)], "t string")
    got = [None if r.o is None else sorted(r.o) for r in df.select(M.json_object(F.col("t")).alias("o")).collect()]
    assert got == [["a"], ["b"], None, None, None, None, None, None]
    plan = df.select(M.json_object(F.col("t")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1


def test_differences_of_changing_samples(spark, tmp_path):
    """Changes of value, of hour and of metric, deletes, versions that come again or too late in order."""
    form = "user_id string, hk_uuid string, ts timestamp, metric_type string, metric_value double, deleted_at timestamp, ordinal long"
    v = lambda uuid, hour, metric, value, ordinal, dead=None: ("u", uuid, _at(hour), metric, value, dead, ordinal)
    loads = [
        [v("a", 1, "steps", 5.0, 1), v("b", 1, "steps", 7.0, 1), v("c", 2, "steps", 1.0, 3), v("z", 1, "sleep_state", 1.0, 1)],
        [v("a", 1, "steps", 6.0, 2), v("b", 3, "steps", 7.0, 2), v("c", 2, "steps", 9.0, 2), v("a", 1, "steps", 5.0, 1)],
        [v("b", 3, "energy", 7.0, 3), v("c", 2, "steps", 1.0, 4, _at(9)), v("a", 1, "steps", 6.0, 2), v("d", 1, "steps", None, 1)],
        [v("c", 2, "steps", 1.0, 3), v("e", 4, "steps", 2.0, 1), v("e", 4, "steps", 3.0, 2)],
        [v("tick", 48, "steps", 1.0, 1)], [v("tick", 48, "steps", 1.0, 1)],
        [v("a", 1, "steps", 100.0, 9)],  # past the lateness: dropped
    ]
    frames = [spark.createDataFrame(rows, form) for rows in loads]
    streams._landed_in_order(
        spark, "differences", frames,
        lambda stream: retract.retractable_rollup(stream, str(tmp_path), f"{tmp_path}/cp", "24 hours", shards=2))
    got = {(r.metric_type, r.bucket_ts): (r.n, r.total) for r in retract.read_rollup(spark, str(tmp_path)).collect()}
    assert got == {
        ("steps", _at(1)): (1, 6.0), ("energy", _at(3)): (1, 7.0), ("steps", _at(4)): (1, 3.0), ("steps", _at(48)): (1, 1.0)}
