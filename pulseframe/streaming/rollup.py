"""Rollups maintained by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pulseframe.plans.ingest import Store, apply_samples
from pulseframe.sources.tables import BUCKETS

TABLES = {"hour": "rollup_hourly", "day": "rollup_daily"}


def stream_rollup(
    stream: DataFrame, root: str, checkpoint: str, units: tuple[str, ...] = ("hour", "day"), available_now: bool = True,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the rollups under ``root`` equal to a full rollup of all samples seen.

    Rows are samples; one that was seen before replaces its earlier version wherever it lay, and
    one with ``deleted_at`` takes it away. Each micro-batch is merged into the stored samples and
    the buckets that it touches are computed again, so no state is kept between micro-batches,
    nothing is ever too late, and a replayed micro-batch gives the same tables.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_samples(Store(batch.sparkSession, root, buckets), batch, f"batch={batch_id}", {TABLES[u]: u for u in units})

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
