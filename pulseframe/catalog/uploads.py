"""Uploads ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.registry import query
from pulseframe.catalog.sql import with_parts
from pulseframe.operators import ledger as L
from pulseframe.session import work_folder
from pulseframe.sources import adapter as A
from pulseframe.sources.ledger import StoredLedger

NOW = "2024-02-01 00:00:00"

# A ledger derived from the event stream: every event is one upload of its user.
LEDGER = """SELECT user_id, 'h' || event_id AS content_hash, 't' || event_id AS task_id,
 CASE k % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'timeout' END AS status,
 CASE WHEN k % 3 = 0 THEN 'delta' ELSE 'seed' END AS upload_mode,
 CASE WHEN k % 3 <> 0 THEN 'b' || event_id // 7 END AS seed_batch_id, k % 9 AS seed_chunk_index,
 CASE WHEN (event_id // 7) % 2 = 0 THEN 9 END AS seed_chunk_total,
 CASE WHEN k % 2 = 0 THEN ts ELSE TIMESTAMP '2024-02-01' - INTERVAL 1 MINUTE END AS created_at, event_id, k FROM ev"""
STATES = """SELECT 't' || event_id AS task_id,
 CASE k % 6 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILURE' WHEN 2 THEN 'PENDING' WHEN 3 THEN 'STARTED' WHEN 4 THEN 'RETRY' ELSE 'REVOKED' END AS state FROM ev"""


def _ledger(spark, sf):
    k, n = F.col("k"), F.col("event_id")
    batch = F.floor(n / 7)
    return A.events(spark, sf).select(
        "user_id", F.concat(F.lit("h"), n).alias("content_hash"), F.concat(F.lit("t"), n).alias("task_id"),
        F.get(F.array(*[F.lit(s) for s in ("pending", "processing", "completed", "failed", "timeout")]), k % 5).alias("status"),
        F.when(k % 3 == 0, "delta").otherwise("seed").alias("upload_mode"),
        F.when(k % 3 != 0, F.concat(F.lit("b"), batch)).alias("seed_batch_id"),
        (k % 9).alias("seed_chunk_index"),
        F.when(batch % 2 == 0, 9).alias("seed_chunk_total"),
        F.when(k % 2 == 0, F.col("ts")).otherwise(F.lit(NOW).cast("timestamp") - F.expr("interval 1 minute")).alias("created_at"),
        "event_id", "k",
    )


def _states(spark, sf):
    names = ("SUCCESS", "FAILURE", "PENDING", "STARTED", "RETRY", "REVOKED")
    return A.events(spark, sf).select(
        F.concat(F.lit("t"), "event_id").alias("task_id"),
        F.get(F.array(*[F.lit(s) for s in names]), F.col("k") % 6).alias("state"),
    )


def _now():
    return F.lit(NOW).cast("timestamp")


@query("dedupe_content", with_parts("""SELECT user_id, sha256(content) AS content_hash, count(*) AS request_count,
 CAST(max(octet_length(encode(content))) AS BIGINT) AS file_size FROM ups GROUP BY 1, 2"""))
def dedupe_content(spark, sf):
    return L.dedupe_content(A.uploads(spark, sf))


@query("size_gate", with_parts("SELECT doc_id, user_id FROM ups WHERE octet_length(encode(content)) <= 2000"))
def size_gate(spark, sf):
    # a small limit, so that the test texts fall on both sides of it
    return L.size_gate(A.uploads(spark, sf), 2_000).select("doc_id", "user_id")


@query("upload_decision", with_parts("""SELECT user_id, content_hash, ordinal, CASE WHEN ordinal > min(ordinal) OVER (PARTITION BY user_id, content_hash)
 AND decision IN ('new', 'reprocessing') THEN 'processing' ELSE decision END AS decision FROM (
 SELECT u.user_id, u.content_hash, u.ordinal, CASE WHEN l.status IS NULL THEN 'new'
 WHEN l.status IN ('pending', 'processing') AND epoch_us(TIMESTAMP '2024-02-01') - epoch_us(l.created_at) < 300000000 THEN 'processing'
 WHEN l.status = 'completed' THEN 'completed' ELSE 'reprocessing' END AS decision
 FROM (SELECT user_id, 'h' || event_id AS content_hash, event_id * 2 + r.i AS ordinal FROM ev, (VALUES (0), (1)) AS r(i) WHERE r.i = 0 OR event_id % 3 = 0) u
 LEFT JOIN (SELECT * FROM led WHERE event_id % 4 <> 0) l USING (user_id, content_hash))""", led=LEDGER))
def upload_decision(spark, sf):
    ledger = _ledger(spark, sf)
    # every third content is uploaded twice
    again = F.array(F.lit(0), F.when(F.col("event_id") % 3 == 0, 1))
    arrivals = ledger.select("user_id", "content_hash", "event_id", F.explode(F.array_compact(again)).alias("i"))
    arrivals = arrivals.select("user_id", "content_hash", (F.col("event_id") * 2 + F.col("i")).alias("ordinal"))
    return L.upload_decision(arrivals, ledger.filter("event_id % 4 <> 0"), _now())


@query("status_reconcile", with_parts("""SELECT task_id, CASE WHEN state = 'SUCCESS' THEN 'completed'
 WHEN state = 'FAILURE' AND status NOT IN ('failed', 'completed') THEN 'failed'
 WHEN state = 'PENDING' AND status = 'pending' AND epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at) > 300000000 THEN 'timeout'
 WHEN state IN ('STARTED', 'RETRY') AND status = 'pending' THEN 'processing' ELSE status END AS status
 FROM led JOIN states USING (task_id)""", led=LEDGER, states=STATES))
def status_reconcile(spark, sf):
    return L.status_reconcile(_ledger(spark, sf), _states(spark, sf), _now()).select("task_id", "status")


@query("latest_batch", with_parts("""SELECT user_id, seed_batch_id FROM (SELECT *, row_number() OVER (
 PARTITION BY user_id ORDER BY created_at DESC, content_hash DESC) AS rn FROM led WHERE upload_mode = 'seed') WHERE rn = 1""", led=LEDGER))
def latest_batch(spark, sf):
    return L.latest_batch(_ledger(spark, sf))


@query("list_batch", with_parts("""SELECT task_id, seed_chunk_index, status, created_at FROM led WHERE seed_batch_id = 'b3'
 AND user_id = (SELECT user_id FROM led WHERE seed_batch_id = 'b3' ORDER BY event_id LIMIT 1)
 ORDER BY created_at DESC, content_hash DESC""", led=LEDGER))
def list_batch(spark, sf):
    ledger = _ledger(spark, sf)
    user = ledger.filter("seed_batch_id = 'b3'").orderBy("event_id").first()["user_id"]
    return L.list_batch(ledger, user, "b3").select("task_id", "seed_chunk_index", "status", "created_at")


@query("seed_progress", with_parts("""SELECT user_id, seed_batch_id,
 CAST(coalesce(max(seed_chunk_total), nullif(count(DISTINCT seed_chunk_index), 0), count(*)) AS BIGINT) AS total,
 count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status IN ('failed', 'timeout')) AS failed,
 count(*) FILTER (WHERE status IN ('pending', 'processing')) AS processing
 FROM led WHERE upload_mode = 'seed' GROUP BY 1, 2""", led=LEDGER))
def seed_progress(spark, sf):
    return L.seed_progress(_ledger(spark, sf))


@query("coalesce_inflight", with_parts("""SELECT d.user_id, d.content_hash, r.task_id AS running_task,
 CASE WHEN r.task_id IS NOT NULL THEN 'processing' ELSE 'new' END AS decision
 FROM (SELECT user_id, content_hash FROM led WHERE upload_mode = 'delta') d LEFT JOIN (
  SELECT x.user_id, x.task_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, content_hash DESC) AS rn
   FROM led WHERE status IN ('pending', 'processing')) x JOIN states USING (task_id)
  WHERE rn = 1 AND state NOT IN ('SUCCESS', 'FAILURE', 'REVOKED')) r USING (user_id)""", led=LEDGER, states=STATES))
def coalesce_inflight(spark, sf):
    ledger = _ledger(spark, sf)
    deltas = ledger.filter("upload_mode = 'delta'").select("user_id", "content_hash")
    return L.coalesce_inflight(deltas, ledger, _states(spark, sf))


@query("ledger_upkeep", with_parts("""SELECT user_id, content_hash, CASE WHEN ask THEN CASE WHEN s2 = 'completed' THEN s2 ELSE 'pending' END
  WHEN s2 IN ('pending', 'processing') AND user_id IN (SELECT user_id FROM steps WHERE ask) THEN 'timeout' ELSE s2 END AS status,
 TIMESTAMP '2024-02-01' + to_seconds(CASE WHEN ask AND s2 IS DISTINCT FROM 'completed' THEN 600 WHEN n % 2 = 0 THEN 0 ELSE 200 END) AS created_at,
 CAST((n % 2 = 0) AS BIGINT) + CAST((n % 4 < 2) AS BIGINT) + CAST(ask AS BIGINT) AS request_count
 FROM steps WHERE s2 IS NOT NULL OR ask""", steps="""SELECT user_id, 'h' || event_id AS content_hash, event_id AS n, event_id % 7 < 4 AS ask,
 CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'completed' WHEN event_id % 5 = 0 THEN 'failed'
   WHEN event_id % 3 = 1 THEN 'processing' ELSE 'pending' END
  WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'pending' END END AS s2 FROM ev"""))
def ledger_upkeep(spark, sf):
    """Three sets of arrivals with task reports between them, every one of them applied twice."""
    ledger = StoredLedger(spark, work_folder(spark, "uploads"), 2)
    e = A.events(spark, sf)
    uploads = e.select("user_id", "event_id", F.concat(F.lit("h"), "event_id").alias("content_hash"), F.concat(F.lit("t"), "event_id").alias("task_id"), F.col("event_id").alias("ordinal"))
    n, at = F.col("event_id"), lambda s: F.lit("2024-02-01").cast("timestamp") + F.make_dt_interval(secs=F.lit(s))
    state = F.when(n % 3 == 0, "SUCCESS").when(n % 3 == 1, "STARTED")
    tasks = uploads.select("user_id", "task_id", "event_id")
    for _ in range(2):
        ledger.arrive(1, uploads.filter(n % 2 == 0).drop("event_id"), at(0))
    for _ in range(2):
        ledger.report(2, tasks.withColumn("state", state).filter("state IS NOT NULL"), at(100))
    for _ in range(2):
        ledger.arrive(3, uploads.filter(n % 4 < 2).drop("event_id"), at(200))
    for _ in range(2):
        ledger.report(4, tasks.filter(n % 5 == 0).withColumn("state", F.lit("FAILURE")), at(250))
    for _ in range(2):
        ledger.arrive(5, uploads.filter(n % 7 < 4).drop("event_id"), at(600))
    return ledger.read().select("user_id", "content_hash", "status", "created_at", "request_count")
