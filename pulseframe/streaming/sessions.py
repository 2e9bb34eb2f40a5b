"""Sleep sessions maintained by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseframe.operators import sleep as L
from pulseframe.schema import table
from pulseframe.session import measured_joins
from pulseframe.sources.tables import BUCKETS, Locator, Part, on_parts, parts_of, read_table, rewrite_parts

ROWS = table(
    "user_id string, hk_uuid string, metric_type string, metric_value double, "
    "segment_start_ts timestamp, segment_end_ts timestamp, tz_name string"
)


def stream_sessions(
    stream: DataFrame, root: str, checkpoint: str, available_now: bool = True, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the table of sleep rows current; sessions are derived from it on read.

    A row seen again replaces its earlier version, also on another day, and one with a
    ``deleted_at`` takes it away. Of several versions in a micro-batch the last by ``ordinal``
    counts, or else the one that starts last. Where a row lay is looked up in a locator; the part it
    leaves and the part it enters are read and rewritten, and no other.

    A session boundary depends on the row before in start order, and late rows may fall
    between rows seen long ago. Per-key operator state would have to hold a user's whole
    history in one task; merging rows into day partitions and cutting sessions with the
    sliced operators gives the same result for any arrival order.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        with measured_joins(batch.sparkSession):
            merge(batch, batch_id)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, path, keys = batch.sparkSession, f"{root}/sleep_rows", ["user_id", "hk_uuid"]
        gone = F.col("deleted_at").isNotNull() if "deleted_at" in batch.columns else F.lit(False)
        order = F.col("ordinal") if "ordinal" in batch.columns else F.struct("segment_start_ts", "segment_end_ts", "metric_value")
        last = F.max_by(F.struct(*ROWS.fieldNames(), gone.alias("gone")), order).alias("row")
        staged, names = f"{root}/_staging/batch={batch_id}/changes", [*ROWS.fieldNames(), "gone"]
        batch.groupBy(*keys).agg(last).select("row.*").select(*names).write.mode("overwrite").parquet(staged)
        changes = spark.read.parquet(staged)
        rows = changes.filter(~F.col("gone")).drop("gone")
        locator = Locator(spark, f"{root}/_keys/sleep_rows", buckets=buckets)
        parts = locator.parts(changes) | parts_of(rows, F.to_date("segment_start_ts"), buckets)
        locator.add(rows, "segment_start_ts")
        rewrite_parts(
            spark, path, ROWS, parts, "segment_start_ts", ("user_id", "hk_uuid"),
            lambda stored: stored.join(changes.select(*keys), keys, "left_anti").unionByName(rows), buckets,
        )
        locator.compact()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_sessions(spark: SparkSession, root: str, gap_s: float = L.GAP_S, parts: set[Part] | None = None) -> DataFrame:
    """Sessions of the rows stored so far, optionally of some parts only."""
    rows = read_table(spark, f"{root}/sleep_rows", ROWS)
    rows = rows if parts is None else on_parts(rows, parts)
    return L.session_bounds(L.sleep_sessions_of(rows.drop("day", "user_bucket"), gap_s))
