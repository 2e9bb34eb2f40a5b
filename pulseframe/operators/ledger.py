"""Uploads ledger: content identity, decisions and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe import schema as S
from pulseframe.operators.ranking import latest_per_key

OPEN = ("pending", "processing")


def content_hash(content: str = "content") -> Column:
    return F.sha2(F.col(content).cast("binary"), 256)


def size_gate(uploads: DataFrame, max_bytes: int = S.MAX_UPLOAD_BYTES, content: str = "content") -> DataFrame:
    return uploads.filter(F.octet_length(content) <= max_bytes)


def dedupe_content(uploads: DataFrame, content: str = "content") -> DataFrame:
    """One row per user and content; repeats raise the request count.

    The hash is taken before the shuffle, so contents do not travel.
    """
    return (
        uploads.select("user_id", content_hash(content).alias("content_hash"), F.octet_length(content).alias("size"))
        .groupBy("user_id", "content_hash")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.max("size").cast("long").alias("file_size"),
        )
    )


def _age_s(now: Column) -> Column:
    return F.coalesce((F.unix_micros(now) - F.unix_micros("created_at")) / 1_000_000, F.lit(0.0))


def upload_decision(
    uploads: DataFrame, ledger: DataFrame, now: Column, timeout_s: int = S.PROCESSING_TIMEOUT_S
) -> DataFrame:
    """What an arriving upload becomes: new, processing, completed or reprocessing.

    Of equal uploads in one set of arrivals the first by ``ordinal`` is decided by the ledger; it
    is then under way, so the others are processing unless it was completed already.
    """
    known = ledger.select("user_id", "content_hash", "status", "created_at", F.lit(True).alias("_known"))
    running = F.col("status").isin(*OPEN) & (_age_s(now) < timeout_s)
    decision = (
        F.when(F.col("_known").isNull(), "new")
        .when(running, "processing")
        .when(F.col("status") == "completed", "completed")
        .otherwise("reprocessing")
    )
    decided = uploads.join(known, ["user_id", "content_hash"], "left")
    if "ordinal" not in uploads.columns:
        return decided.select(*uploads.columns, decision.alias("decision"))
    # the smallest ordinal of a content travels, one row a task, not the arrivals
    first = uploads.groupBy("user_id", "content_hash").agg(F.min("ordinal").alias("_first"))
    repeat = (F.col("ordinal") > F.col("_first")) & decision.isin("new", "reprocessing")
    return decided.join(first, ["user_id", "content_hash"]).select(
        *uploads.columns, F.when(repeat, "processing").otherwise(decision).alias("decision")
    )


def write_back(ledger: DataFrame, decided: DataFrame, now: Column, timeout_s: int = S.PROCESSING_TIMEOUT_S) -> DataFrame:
    """The ledger after a set of decided uploads: repeats raise the request count, what is new
    or processed again becomes pending from ``now`` on, and overdue entries that were not asked
    for become ``timeout``. Seed fields that an upload does not give stay as they are."""
    given = [c for c in ledger.columns if c in decided.columns and c not in ("user_id", "content_hash", "status", "created_at", "request_count")]
    asked = decided.groupBy("user_id", "content_hash").agg(
        F.count(F.lit(1)).alias("_requests"), F.bool_or(F.col("decision").isin("new", "reprocessing")).alias("_starts"),
        *(F.max(c).alias(f"_{c}") for c in given),
    )
    overdue = F.col("status").isin(*OPEN) & (_age_s(now) >= timeout_s)
    change = {
        "status": F.when(F.col("_starts"), "pending").when(overdue, "timeout").otherwise(F.col("status")),
        "created_at": F.when(F.col("_starts"), now).otherwise(F.col("created_at")),
        "request_count": F.coalesce("request_count", F.lit(0)) + F.coalesce("_requests", F.lit(0)),
        **{c: F.coalesce(f"_{c}", c) for c in given},
    }
    return ledger.join(asked, ["user_id", "content_hash"], "full").select(*(change.get(c, F.col(c)).alias(c) for c in ledger.columns))


def status_reconcile(
    ledger: DataFrame, task_states: DataFrame, now: Column, timeout_s: int = S.PROCESSING_TIMEOUT_S
) -> DataFrame:
    """Ledger status brought in line with what the tasks report."""
    state, status = F.col("state"), F.col("status")
    fresh = (
        F.when(state == "SUCCESS", "completed")
        .when((state == "FAILURE") & ~status.isin("failed", "completed"), "failed")
        .when((state == "PENDING") & (status == "pending") & (_age_s(now) > timeout_s), "timeout")
        .when(state.isin("STARTED", "RETRY") & (status == "pending"), "processing")
        .otherwise(status)
    )
    return ledger.join(task_states.select("task_id", "state"), "task_id", "left").withColumn(
        "status", fresh
    ).select(*ledger.columns)


def lookup(ledger: DataFrame, user_id: str, content_hash: str | None = None, task_id: str | None = None) -> DataFrame:
    """Ledger rows of a user by content or by task; both filters reach the scan."""
    rows = ledger.filter(F.col("user_id") == user_id)
    if content_hash is not None:
        rows = rows.filter(F.col("content_hash") == content_hash)
    if task_id is not None:
        rows = rows.filter(F.col("task_id") == task_id)
    return rows


def latest_batch(ledger: DataFrame) -> DataFrame:
    """Most recent seed batch of every user."""
    seeds = ledger.filter((F.col("upload_mode") == "seed") & F.col("seed_batch_id").isNotNull())
    return latest_per_key(
        seeds, ["user_id"], [F.col("created_at").desc(), F.col("content_hash").desc()]
    ).select("user_id", "seed_batch_id")


def list_batch(ledger: DataFrame, user_id: str, batch_id: str, limit: int | None = None) -> DataFrame:
    """Chunks of one seed batch, newest first; all of them unless a limit is asked for."""
    rows = ledger.filter(
        (F.col("user_id") == user_id) & (F.col("upload_mode") == "seed") & (F.col("seed_batch_id") == batch_id)
    )
    rows = rows.orderBy(F.col("created_at").desc(), F.col("content_hash").desc())
    return rows if limit is None else rows.limit(limit)


def seed_progress(ledger: DataFrame) -> DataFrame:
    """Chunk counts per seed batch; without a stated total the distinct chunks count."""
    status = F.lower(F.coalesce("status", F.lit("")))

    def having(*names):
        return F.count_if(status.isin(*names))

    stated = F.nullif(F.max("seed_chunk_total").cast("long"), F.lit(0))
    distinct = F.nullif(F.count_distinct("seed_chunk_index"), F.lit(0))
    return (
        ledger.filter((F.col("upload_mode") == "seed") & F.col("seed_batch_id").isNotNull())
        .groupBy("user_id", "seed_batch_id")
        .agg(
            F.coalesce(stated, distinct, F.count(F.lit(1))).alias("total"),
            having("completed").alias("completed"),
            having("failed", "timeout").alias("failed"),
            having(*OPEN).alias("processing"),
        )
    )


def coalesce_inflight(deltas: DataFrame, ledger: DataFrame, task_states: DataFrame) -> DataFrame:
    """Delta uploads of users with an ingest still running are folded into it.

    A task that already ended no longer holds deltas back, even if the ledger lags.
    """
    ended = task_states.filter(F.col("state").isin("SUCCESS", "FAILURE", "REVOKED"))
    running = ledger.filter(F.col("status").isin(*OPEN) & F.col("task_id").isNotNull())
    running = latest_per_key(
        running, ["user_id"], [F.col("created_at").desc(), F.col("content_hash").desc()]
    ).join(ended.select("task_id"), "task_id", "left_anti")
    held = running.select("user_id", F.col("task_id").alias("running_task"))
    return deltas.join(held, "user_id", "left").withColumn(
        "decision", F.when(F.col("running_task").isNotNull(), "processing").otherwise("new")
    )
