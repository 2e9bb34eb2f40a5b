"""Uploads that do not finish in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulseframe import schema as S
from pulseframe.streaming.columns import STATE, cells, pack, unpack

OUTCOMES = "task_id string, status string, started_at timestamp, age_s double"
#: the store that this kind of state needs
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FOUND = "task_id string, status string, started long, age long"


#: groups over which uploads are dealt, as many as give a group some thousand open uploads at most
SHARDS = 4_096
_UPLOADS = pa.schema([("task_id", pa.string()), ("started", pa.int64()), ("ended", pa.int64()), ("status", pa.string()),
                      ("decided", pa.bool_()), ("due", pa.int64())])
_OUT = ["task_id", "status", "started", "age"]


class _Uploads(StatefulProcessor):
    """The uploads of one shard: of each its first start, its first end, and whether its outcome is out.

    Their timer is that of the earliest one due. Instants are microseconds, dues milliseconds. A
    decided upload stays known for ``keep`` milliseconds after its outcome, so that a report that is
    delivered again gives no second one.
    """

    def __init__(self, limit: int, keep: int):
        self.limit, self.keep = limit * 1_000_000, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uploads = handle.getValueState("uploads", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self._read()
        now, touched, out = timerValues.getCurrentWatermarkInMs(), {}, []
        for frame in rows:
            for task_id, status, at in cells(frame, "task_id", "status", "at"):  # in whatever order they come
                upload = touched.get(task_id)
                if upload is None:
                    upload = known.get(task_id, (None, None, None, False, None))
                    if upload[3]:
                        continue
                    upload = touched[task_id] = list(upload)
                if status == "pending":
                    upload[0] = at if upload[0] is None else min(upload[0], at)
                elif status in ("completed", "failed") and (upload[1] is None or at < upload[1]):
                    upload[1], upload[2] = at, status
        for task_id, (started, ended, status, _, _) in touched.items():
            if started is None and ended is None:
                continue
            deadline = (ended if started is None else started) // 1_000 + self.limit // 1_000
            if started is not None and ended is not None:
                age = ended - started
                out.append(self._decide(known, task_id, status if age < self.limit else "timeout", started, min(age, self.limit), now))
            elif deadline > now:
                known[task_id] = (started, ended, status, False, deadline)
            elif started is not None:
                out.append(self._decide(known, task_id, "timeout", started, self.limit, now))
            else:
                known.pop(task_id, None)
        if touched:
            self._write(known, timer)
        if out:
            yield pd.DataFrame(out, columns=_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, _ = self._read()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for task_id, (started, _, _, decided, due) in list(known.items()):
            if due > now:
                continue
            if decided or started is None:  # remembered long enough, or an end whose start did not come
                del known[task_id]
            else:
                out.append(self._decide(known, task_id, "timeout", started, self.limit, now))
        self._write(known, None)
        if out:
            yield pd.DataFrame(out, columns=_OUT)

    def _read(self) -> tuple[dict[str, tuple], int | None]:
        value = self.uploads.get()
        return ({}, None) if value is None else ({u[0]: u[1:] for u in unpack(value[0])}, value[1])

    def _write(self, known: dict[str, tuple], timer: int | None) -> None:
        due = min((u[4] for u in known.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if known:
            self.uploads.update((pack([(i, *u) for i, u in known.items()], _UPLOADS), due))
        else:
            self.uploads.clear()

    def _decide(self, known: dict[str, tuple], task_id: str, status: str, started: int, age: int, now: int) -> tuple:
        known[task_id] = (started, None, status, True, max(now, (started + age) // 1_000) + self.keep)
        return task_id, status, started, age

    def close(self) -> None:
        pass


def stream_timeout(
    reports: DataFrame, watermark: str, seconds: int = S.PROCESSING_TIMEOUT_S, shards: int = SHARDS,
) -> DataFrame:
    """Exactly one outcome per upload: completed, failed, or timeout when nothing came in time.

    Input are status reports ``(task_id, status, ts)``; an upload starts with its ``pending``
    report. Time is event time, so reruns decide alike. ``watermark`` is how late a report may
    come: reports may come in any order within it, and more than once. Uploads are dealt by their
    ids over ``shards``, fixed for the life of the stream; a group holds the open and the lately
    decided uploads of its shard, each two instants and a status. An end whose start does not come
    within the lateness is given up.
    """
    spark = reports.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keep = spark.range(1).select(F.expr(f"unix_millis(timestamp '1970-01-01 00:00:00' + interval {watermark})")).first()[0]
    found = (
        reports.filter("ts IS NOT NULL").select(
            F.pmod(F.xxhash64("task_id"), F.lit(shards)).alias("shard"), "task_id", "status", "ts", F.unix_micros("ts").alias("at"))
        .withWatermark("ts", watermark)
        .groupBy("shard")
        .transformWithStateInPandas(_Uploads(seconds, keep), _FOUND, "append", "eventTime")
    )
    return found.select("task_id", "status", F.timestamp_micros("started").alias("started_at"), (F.col("age") / 1e6).alias("age_s"))
