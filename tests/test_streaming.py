"""Streams give what the batch form gives, however the rows are spread over micro-batches."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from pulseframe import catalog
from pulseframe.catalog import streams
from pulseframe.session import work_folder
from pulseframe.streaming import timeouts
from pulseframe.streaming.bursts import coalesce_bursts
from tests.compare import compare

START = dt.datetime(2024, 1, 1)


def _rows(spark, seconds):
    rows = [("u", i, START + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "user_id string, event_id bigint, ts timestamp")


def test_bursts_of_a_stream(spark, tmp_path):
    whole = _rows(spark, [0, 3, 8, 20, 21, 100, 400])
    for lo, hi in ((0, 4), (4, 6), (6, 99)):
        whole.filter(F.col("event_id").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = coalesce_bursts(stream, "5 seconds", "10 seconds").writeStream.format("parquet")
    out = out.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = coalesce_bursts(whole, "5 seconds")
    got = spark.read.schema(batch.schema).parquet(f"{tmp_path}/out").collect()
    # the last burst stays open until a later event closes it
    assert sorted(got) == sorted(batch.filter("burst_start < '2024-01-01 00:06:00'").collect())
    assert sorted(r.n for r in got) == [1, 2, 3]


def test_loads_are_written_by_all_tasks_and_read_in_order(spark):
    seen = []

    def start(stream):
        each = lambda batch, _: seen.append(([r.id for r in batch.collect()], batch.select(F.input_file_name()).distinct().count()))
        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    checkpoint = work_folder(spark, "loads-cp")
    streams._landed_in_order(spark, "loads", [spark.range(40, numPartitions=4), spark.range(40, 50, numPartitions=2)], start)
    assert [sorted(ids) for ids, _ in seen] == [list(range(40)), list(range(40, 50))]
    assert [files for _, files in seen] == [4, 2]


def test_timeouts_over_a_long_span(spark, tmp_path):
    """Uploads of several years: no end is late."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(60)
    days = F.pmod(F.xxhash64("event_id"), F.lit(1500)).cast("int")
    shifted = events.withColumn("ts", (F.col("ts") + F.make_dt_interval(days)).cast(events.schema["ts"].dataType))
    shifted.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    name = "stream_timeout"
    assert compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], str(tmp_path)) == ""


def test_one_outcome_an_upload(spark, tmp_path):
    """Reports are delivered again after the outcome, in the same and in later micro-batches."""
    at = lambda s: START + dt.timedelta(seconds=s)
    loads = [
        [("a", "pending", at(0)), ("b", "pending", at(1)), ("c", "completed", at(30)), ("d", "completed", at(5))],
        [("a", "completed", at(10)), ("a", "pending", at(0)), ("c", "pending", at(20)), ("e", "pending", at(2))],
        [("a", "pending", at(0)), ("a", "completed", at(10)), ("c", "failed", at(40)), ("c", "pending", at(20)), ("e", "completed", at(900))],
        [("tick", "completed", at(2_000))],  # passes the deadline of b, within the lateness of its reports
        [("tick", "completed", at(2_001))],
        [("b", "pending", at(1_500)), ("b", "completed", at(1_501)), ("e", "pending", at(1_400))],
        [("tick", "completed", at(9_000))],
        [("tick", "completed", at(9_001))],
    ]
    frames = [spark.createDataFrame(rows, "task_id string, status string, ts timestamp") for rows in loads]

    def start(stream):
        writer = timeouts.stream_timeout(stream, "1000 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out")
        return writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()

    streams._landed_in_order(spark, "again", frames, start)
    got = spark.read.schema(timeouts.OUTCOMES).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.task_id, r.status, r.age_s) for r in got) == [
        ("a", "completed", 10.0), ("b", "timeout", 300.0), ("c", "completed", 10.0), ("e", "timeout", 300.0)]
    assert {r.task_id: r.started_at for r in got}["c"] == at(20)
