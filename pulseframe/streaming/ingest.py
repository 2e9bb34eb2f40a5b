"""Continuous ingest of a landing folder."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pulseframe.plans.ingest import Store, apply_batch
from pulseframe.sources.mirror_csv import read_mirror_csv, stream_mirror_files
from pulseframe.sources.tables import BUCKETS


def stream_ingest(
    spark: SparkSession, in_dir: str, root: str, checkpoint: str, at: Column | None = None,
    available_now: bool = True, max_files: int = 1_000, buckets: int = BUCKETS, **options,
) -> StreamingQuery:
    """Apply every new mirror file once, one micro-batch after the other.

    The single writer makes ingests of one user serial. The checkpoint remembers files
    already taken; a replayed batch writes under the same batch id and gives the same
    tables. Late rows recompute whatever they touch, as far back as the retention goes.
    """
    stream = stream_mirror_files(spark, in_dir, max_files)

    def each(batch, batch_id: int) -> None:
        files = [r.path for r in batch.collect()]  # names only, at most ``max_files``
        if files:
            apply_batch(Store(spark, root, buckets), read_mirror_csv(spark, files), f"batch={batch_id}", at, **options)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
