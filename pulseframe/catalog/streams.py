"""Streaming operators, run over the whole event table with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.nights import GAP
from pulseframe.catalog.registry import query
from pulseframe.catalog.shape import rollup_out, rounded
from pulseframe.catalog.sql import ROLLUP_OUT, local, sessions, utc, with_parts
from pulseframe.operators import chunks as H, merge as G, rollup as R, sleep as L
from pulseframe.plans.ingest import Store, apply_batch
from pulseframe.session import configure, work_folder
from pulseframe.sources import adapter as A, mirror_csv as C
from pulseframe.streaming import ingest, late, retract, rollup, sessions as live, timeouts


#: buckets of users for tables of this size
FEW = 2


def _with_history(df, moved, dead):
    """Every row, each with an ``ordinal``; every fifth came first on another day and with another
    value, and every seventh of the rest came first as live and was deleted later."""
    k = F.abs(F.xxhash64("hk_uuid"))
    late = df.withColumn("ordinal", F.lit(2))
    before = moved(df.filter(k % 5 == 0)).withColumn("ordinal", F.lit(1))
    ghosts = df.filter((k % 5 != 0) & (k % 7 == 0)).withColumn("hk_uuid", F.concat("hk_uuid", F.lit("-gone")))
    return [before.unionByName(ghosts.withColumn("ordinal", F.lit(1))), late, dead(ghosts).withColumn("ordinal", F.lit(2))]


def _landed_in_order(spark, name, frames, start):
    """Each frame is written by all its tasks, and the query that ``start`` makes of the stream runs
    over what is new before the next one lands."""
    path = work_folder(spark, name)
    for frame in frames:
        frame.write.mode("append").parquet(path)
        start(spark.readStream.schema(frames[0].schema).parquet(path)).awaitTermination()


def _shards(n: int) -> int:
    """Groups of some thousand rows each, however many rows there are."""
    return max(64, n // 2_000)


def _shifted(*columns):
    return lambda df: df.withColumns({c: F.col(c) + F.expr("interval 3 days") for c in columns})


@query("stream_rollup", with_parts(f"SELECT {ROLLUP_OUT} FROM hourly"))
def stream_rollup(spark, sf):
    """Samples that arrive in three loads: first some on wrong days and some that will be deleted,
    then all, then the deletes."""
    folder = work_folder(spark, "rollup")
    configure(spark)
    samples = A.samples(spark, sf)
    frames = _with_history(
        samples, lambda df: _shifted("ts", "end_ts")(df).withColumn("metric_value", F.col("metric_value") + 1),
        lambda df: df.withColumn("deleted_at", F.lit("2024-03-01").cast("timestamp")),
    )
    _landed_in_order(spark, "samples", frames, lambda stream: rollup.stream_rollup(stream, folder, f"{folder}/cp", ("hour",), buckets=FEW))
    return rollup_out(Store(spark, folder).read("rollup_hourly").drop("day", "user_bucket"))


@query("stream_retract", with_parts("""SELECT user_id, metric_type, date_trunc('hour', ts) AS bucket_ts, count(*) AS n,
 round(sum(metric_value), 6) AS total, round(avg(metric_value), 6) AS avg_value
 FROM samples WHERE deleted_at IS NULL AND metric_type NOT LIKE 'sleep_%' GROUP BY 1, 2, 3"""))
def stream_retract(spark, sf):
    """As ``stream_rollup``, with the last versions in operator state; the middle load comes twice."""
    folder = work_folder(spark, "retract")
    configure(spark)
    samples = A.samples(spark, sf).select("user_id", "hk_uuid", "ts", "metric_type", "metric_value", "deleted_at")
    first, last, n = samples.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts")), F.count("*")).first()
    lateness = (last - first if first is not None else 0) + 4 * 86400  # of the rows' own span and the shift: none is late
    early, all_rows, dead = _with_history(
        samples, lambda df: _shifted("ts")(df).withColumn("metric_value", F.col("metric_value") + 1),
        lambda df: df.withColumn("deleted_at", F.lit("2024-03-01").cast("timestamp")),
    )
    _landed_in_order(spark, "versions", [early, all_rows, all_rows, dead],
                     lambda stream: retract.retractable_rollup(stream, folder, f"{folder}/cp", f"{lateness} seconds", shards=_shards(n)))
    return rounded(retract.read_rollup(spark, folder), "total", "avg_value")


@query("stream_sessions", with_parts("""SELECT user_id, min(segment_start_ts) AS session_start_ts, max(segment_end_ts) AS session_end_ts,
 arg_max(tz_name, segment_start_ts) AS session_tz FROM two GROUP BY user_id, session_id""", two=sessions("2 HOUR")))
def stream_sessions(spark, sf):
    """Sleep rows of which some move to another day and some are deleted again."""
    folder = work_folder(spark, "sessions")
    rows = L.sleep_rows(A.samples(spark, sf)).select(*live.ROWS.fieldNames()).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    frames = _with_history(
        rows, _shifted("segment_start_ts", "segment_end_ts"), lambda df: df.withColumn("deleted_at", F.col("segment_start_ts"))
    )
    _landed_in_order(spark, "sleep", frames, lambda stream: live.stream_sessions(stream, folder, f"{folder}/cp", buckets=FEW))
    return live.read_sessions(spark, folder).drop("session_id")


@query("stream_timeout", with_parts("""SELECT 't' || event_id AS task_id,
 CASE WHEN k % 4 <> 3 AND k * 5 < 300 THEN 'completed' ELSE 'timeout' END AS status, ts AS started_at FROM ev"""))
def stream_timeout(spark, sf):
    """Uploads that report completion after ``5k`` seconds, or never. Half of the ends arrive before
    all starts and half after; a much later report of another upload then closes what is open."""
    folder = work_folder(spark, "timeouts")
    e = A.events(spark, sf).withColumn("task_id", F.concat(F.lit("t"), "event_id"))
    starts = e.select("task_id", F.lit("pending").alias("status"), "ts")
    ends = e.filter("k % 4 <> 3").select(
        "task_id", F.lit("completed").alias("status"), (F.col("ts") + F.make_dt_interval(secs=F.col("k") * 5)).alias("ts")
    )
    early = F.col("ts").isNotNull() & (F.xxhash64("task_id") % 2 == 0)
    # no report is later than the reports' own span, and the tick comes when all are over
    first, last, n = starts.union(ends).agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts")), F.count("*")).first()
    lateness = (last - first if first is not None else 0) + 86400
    after = F.make_dt_interval(secs=F.lit(2 * lateness))
    tick = starts.agg(F.lit("tick").alias("task_id"), F.lit("completed").alias("status"), (F.max("ts") + after).alias("ts"))

    def start(stream):
        writer = timeouts.stream_timeout(stream, f"{lateness} seconds", shards=_shards(n)).writeStream.format("parquet").option("path", f"{folder}/out")
        return writer.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()

    _landed_in_order(spark, "reports", [ends.filter(early), starts, ends.filter(~early), tick], start)
    return spark.read.schema(timeouts.OUTCOMES).parquet(f"{folder}/out").drop("age_s")


INGESTED = """SELECT user_id, hk_uuid, date_trunc('second', ts) AS ts, metric_type,
 CAST(format('{:.4f}', metric_value) AS DOUBLE) AS metric_value FROM samples WHERE deleted_at IS NULL"""


@query("stream_ingest", with_parts("SELECT * FROM ing", ing=INGESTED))
def stream_ingest(spark, sf):
    """All live samples exported to mirror files, ingested by the stream, read from the store."""
    folder = work_folder(spark, "ingest")
    configure(spark)
    C.write_mirror_csv(C.export_mirror(R.live_rows(A.samples(spark, sf))), f"{folder}/in")
    ingest.stream_ingest(spark, f"{folder}/in", f"{folder}/store", f"{folder}/cp", buckets=FEW, sleep_gap_s=GAP).awaitTermination()
    return Store(spark, f"{folder}/store").read("samples").filter("deleted_at IS NULL").select(
        "user_id", "hk_uuid", "ts", "metric_type", "metric_value"
    )


@query("ingest_incremental", with_parts("""SELECT user_id, metric_type, date_trunc('day', ts) AS bucket_ts, count(*) AS n,
 min(metric_value) AS min_value, max(metric_value) AS max_value, round(sum(metric_value), 3) AS total
 FROM ing WHERE metric_type NOT LIKE 'sleep_%' GROUP BY 1, 2, 3""", ing=INGESTED))
def ingest_incremental(spark, sf):
    """Three delta files: some samples on wrong days and some that go again, then all, then the
    deletes. The daily rollups kept up to date are those of a full computation."""
    folder = work_folder(spark, "deltas")
    configure(spark)
    live = R.live_rows(A.samples(spark, sf))
    early, late, gone = _with_history(live, _shifted("ts", "end_ts"), lambda df: df)
    store = Store(spark, f"{folder}/store", FEW)
    at = F.lit("2024-03-01").cast("timestamp")
    texts = [C.export_mirror(early.drop("ordinal")), C.export_mirror(late.drop("ordinal")), C.export_deletes(gone)]
    for i, text in enumerate(texts):
        C.write_mirror_csv(text, f"{folder}/in{i}")
        apply_batch(store, C.read_mirror_csv(spark, f"{folder}/in{i}"), f"delta{i}", at, retention_days=3650, sleep_gap_s=GAP)
    total = F.coalesce("sum_value", F.col("avg_value") * F.col("n"))
    return store.read("rollup_daily").select(
        "user_id", "metric_type", "bucket_ts", "n", "min_value", "max_value", F.round(total, 3).alias("total"))


@query("late_stream", with_parts("""SELECT user_id, metric_type, date_trunc('hour', ts) AS bucket_ts, count(*) AS n, round(sum(metric_value), 6) AS total,
 min(metric_value) AS min_value, max(metric_value) AS max_value FROM samples GROUP BY 1, 2, 3
 UNION ALL SELECT 'too late', 'rows', NULL, (SELECT count(*) FROM samples WHERE event_id % 11 = 0), NULL, NULL, NULL"""))
def late_stream(spark, sf):
    """Samples in three loads: the later half, then all of them, so that late ones and repeats come,
    and after a row of another year old ones that are past the lateness."""
    folder = work_folder(spark, "late")
    configure(spark)
    samples = A.samples(spark, sf).select("user_id", "hk_uuid", "ts", "metric_type", "metric_value")
    days = lambda n: F.col("ts") + F.make_dt_interval(days=F.lit(n))
    middle = F.expr("timestamp '2024-01-15'")
    tick = samples.agg(F.lit("tick").alias("user_id"), F.lit("tick").alias("hk_uuid"), F.max(days(400)).alias("ts"),
                       F.lit("tick").alias("metric_type"), F.lit(0.0).alias("metric_value"))
    number = F.substring("hk_uuid", 3, 20).cast("long")
    old = samples.filter(number % 11 == 0).withColumn("ts", days(-30))
    dropped = []

    def start(stream):
        writer = late.late_rollup(stream).writeStream.format("parquet").option("path", f"{folder}/out")
        query = writer.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped.append(late.too_late(query))
        return query

    _landed_in_order(spark, "late", [samples.filter(F.col("ts") >= middle), samples, tick, old], start)
    schema = late.late_rollup(samples).schema
    found = spark.read.schema(schema).parquet(f"{folder}/out").withColumn("total", F.round("total", 6))
    return found.unionByName(spark.createDataFrame([("too late", "rows", None, sum(dropped), None, None, None)], schema))


@query("late_recompute", with_parts(f"SELECT {ROLLUP_OUT} FROM hourly"))
def late_recompute(spark, sf):
    """Every third sample arrives late; refreshing the touched buckets gives the full rollup."""
    samples = A.samples(spark, sf)
    late = F.xxhash64("hk_uuid") % 3 == 0
    before = R.rollup(samples.filter(~late), "hour")
    windows = G.affected_window(samples.filter(late), samples, samples.filter(late).select("user_id", "hk_uuid"))
    return rollup_out(G.refresh_rollup(before, samples, windows, "hour"))


ANCHORS = "SELECT user_id, max(ts) AS anchor FROM ev GROUP BY 1"
ZONE = "America/New_York"
MIDNIGHT = utc("d", f"'{ZONE}'")
CHUNKS = f"""SELECT user_id, anchor, i + 1 AS chunk_index, 5 AS chunk_total,
 {utc("CAST(first + i * 7 AS TIMESTAMP)", f"'{ZONE}'")} AS chunk_start,
 least({utc("CAST(first + (i + 1) * 7 AS TIMESTAMP)", f"'{ZONE}'")}, anchor) AS chunk_end
 FROM (SELECT *, CAST({local('anchor', f"'{ZONE}'")} AS DATE) - 30 AS first FROM anc),
 (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS i)"""


@query("backfill_chunks", with_parts("SELECT * FROM chunk WHERE chunk_start < anchor", chunk=CHUNKS, anc=ANCHORS))
def backfill_chunks(spark, sf):
    anchors = A.events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("anchor"))
    return H.backfill_chunks(anchors, ZONE, 30, 7)


@query("overlap_chunks", with_parts("""SELECT s.user_id, s.hk_uuid, c.chunk_index FROM samples s JOIN chunk c USING (user_id)
 WHERE s.ts < c.chunk_end AND coalesce(s.end_ts, s.ts) > c.chunk_start""", chunk=CHUNKS, anc=ANCHORS))
def overlap_chunks(spark, sf):
    anchors = A.events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("anchor"))
    return H.overlap_chunks(A.samples(spark, sf), anchors, ZONE, 30, 7).select("user_id", "hk_uuid", "chunk_index")
