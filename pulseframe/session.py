"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results depend on.

    Instants are stored as UTC; every zone conversion is explicit, so the session
    zone must be UTC or ``date_trunc`` would cut buckets at the wrong instants.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # hash aggregation with set and latest-value buffers gives way to sorting only after
    # this many groups per task (a few ten MB); the built-in value is 128
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "10000")
    return spark


_BY_FILES, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that are run within send a side to all tasks only if its rows, once shuffled, are measured
    to be few.

    Files are compressed, so by their sizes a side may seem small that is many times larger, and a
    plan that was made to send it, through the driver, keeps to that whatever is measured later.
    """
    before = {k: spark.conf.get(k, None) for k in (_BY_FILES, _MEASURED)}
    spark.conf.set(_MEASURED, before[_MEASURED] or spark.conf.get(_BY_FILES))
    spark.conf.set(_BY_FILES, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables and stream checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``. A folder of this machine
    serves only when it is unset and driver and executors are one process (local tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return configured or tempfile.mkdtemp(prefix="pulseframe-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, under the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pulseframe")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)
