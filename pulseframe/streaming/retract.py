"""Rollups of a stream whose samples change, kept without a stored table of samples.

The last version of each sample is operator state. A change takes the version before it out of
its bucket and puts the new one into its own; what reaches the stored table are the sums of these
differences by bucket, one small folder a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pulseframe.functions.metrics import is_sleep
from pulseframe.schema import table
from pulseframe.streaming.columns import STATE, cells, pack, unpack
from pulseframe.streaming.timeouts import STATE_STORE

#: groups over which samples are dealt, as many as give a group some thousand samples at most
SHARDS = 4_096
#: milliseconds between two clearings of a group's state
CLEAR_MS = 3_600_000
DELTAS = table("user_id string, metric_type string, bucket_ts timestamp, n bigint, total double")
_CHANGE = "user_id string, metric_type string, at long, sign int, value double"


_SAMPLES = pa.schema([("user_id", pa.string()), ("hk_uuid", pa.string()), ("ordinal", pa.int64()), ("at", pa.int64()),
                      ("metric_type", pa.string()), ("value", pa.float64()), ("dead", pa.bool_())])
_OUT = ["user_id", "metric_type", "at", "sign", "value"]


class _Samples(StatefulProcessor):
    """The last versions of the samples of one shard; instants are microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[tuple, tuple] = {}  # of what came, one a sample
        for frame in rows:
            for user, uuid, *version in cells(frame, "user_id", "hk_uuid", "ordinal", "at", "metric_type", "value", "dead"):
                before = newest.get((user, uuid))
                if before is None or tuple(version[:2]) > before[:2]:
                    newest[user, uuid] = tuple(version)
        known, timer = self._read()
        changed, out = False, []
        for sample, version in newest.items():
            before = known.get(sample)
            if before is not None:
                if version[:2] <= before[:2]:  # delivered again, or overtaken
                    continue
                if not before[4]:
                    out.append((sample[0], before[2], before[1], -1, before[3]))
            known[sample], changed = version, True
            if not version[4]:
                out.append((sample[0], version[2], version[1], 1, version[3]))
        if changed and timer is None:
            timer = min(v[1] for v in newest.values()) // 1_000 + CLEAR_MS
            self.handle.registerTimer(timer)
        if changed:
            self._write(known, timer)
        if out:
            yield pd.DataFrame(out, columns=_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = {sample: v for sample, v in self._read()[0].items() if v[1] // 1_000 >= now}
        if known:
            timer = min(v[1] for v in known.values()) // 1_000 + CLEAR_MS
            self.handle.registerTimer(timer)
            self._write(known, timer)
        else:
            self.last.clear()
        return iter(())

    def _read(self) -> tuple[dict[tuple, tuple], int | None]:
        value = self.last.get()
        return ({}, None) if value is None else ({v[:2]: v[2:] for v in unpack(value[0])}, value[1])

    def _write(self, known: dict[tuple, tuple], timer: int | None) -> None:
        self.last.update((pack([(*sample, *v) for sample, v in known.items()], _SAMPLES), timer))

    def close(self) -> None:
        pass


def changes(stream: DataFrame, lateness: str, shards: int = SHARDS) -> DataFrame:
    """``user_id, metric_type, at, sign, value``: what each change takes out (-1) and puts in (1).

    Input are sample versions with ``user_id, hk_uuid, ts, metric_type, metric_value, deleted_at,
    ordinal``; of several versions of a sample the greatest ``ordinal``, then the latest instant
    counts, in whatever order they come, and a version that comes again changes nothing. Sleep rows
    and rows without id, instant or value are left out. Versions further back than ``lateness``
    from the newest instant are forgotten and what is older is dropped: they stand as counted, and
    a sample that moves after its version was forgotten counts in both places. Samples are dealt by
    their ids over ``shards``, fixed for the life of the stream.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    usable = F.col("user_id").isNotNull() & F.col("hk_uuid").isNotNull() & F.col("ts").isNotNull() & F.col("metric_value").isNotNull()
    rows = stream.filter(usable & ~is_sleep(F.col("metric_type"))).withWatermark("ts", lateness).select(
        "user_id", F.pmod(F.xxhash64("user_id", "hk_uuid"), F.lit(shards)).alias("shard"), "hk_uuid", "ts", F.unix_micros("ts").alias("at"),
        "metric_type", F.col("metric_value").alias("value"), F.coalesce(F.col("ordinal").cast("long"), F.lit(-(2**63))).alias("ordinal"),
        F.col("deleted_at").isNotNull().alias("dead"),
    )
    return rows.groupBy("shard").transformWithStateInPandas(_Samples(), _CHANGE, "update", "eventTime")


def retractable_rollup(
    stream: DataFrame, root: str, checkpoint: str, lateness: str, unit: str = "hour", available_now: bool = True, shards: int = SHARDS,
) -> StreamingQuery:
    """Keep count and sum by bucket under ``root``; :func:`read_rollup` has them.

    A micro-batch that is replayed writes its own folder again. Least and greatest values cannot be
    taken back from a difference; :func:`pulseframe.streaming.rollup.stream_rollup` has them.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        bucket = F.date_trunc(unit, F.timestamp_micros("at")).alias("bucket_ts")
        sums = batch.groupBy("user_id", "metric_type", bucket).agg(
            F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("value")).alias("total"))
        sums.write.mode("overwrite").parquet(f"{root}/deltas/batch={batch_id}")

    writer = changes(stream, lateness, shards).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_rollup(spark: SparkSession, root: str) -> DataFrame:
    """``user_id, metric_type, bucket_ts, n, total, avg_value`` of the buckets that hold samples."""
    deltas = spark.read.schema(DELTAS).parquet(f"{root}/deltas")
    sums = deltas.groupBy("user_id", "metric_type", "bucket_ts").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return sums.filter("n > 0").withColumn("avg_value", F.col("total") / F.col("n"))
