"""Written intermediate tables and sizes, shared by the operators."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.session import work_folder

#: text bytes that one group of a grouped function holds at most, on average
GROUP_BYTES = 4 << 20


def stored(df: DataFrame, name: str, *partitions: str, files: int | None = None) -> DataFrame:
    """The rows written to a new folder of the shared checkpoint folder and read from there: made
    once, and still there when executors are lost. ``files``: how many tasks write, if that is
    to follow a measured number of rows and not the number of shuffle partitions."""
    path = work_folder(df.sparkSession, name)
    df = df if files is None else df.coalesce(files)
    (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_partition(spark: SparkSession, df: DataFrame, partition: str) -> None:
    """Remove one partition of a stored table that nothing reads any more."""
    at = next((f for f in df.inputFiles() if f"/{partition}/" in f), None)
    if at is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(at.split(f"/{partition}/")[0] + f"/{partition}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now: it does so for those that the
    driver's garbage collector finds unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def groups_for(docs: DataFrame) -> int:
    """Groups into which the texts are dealt, so that one of them fits a task at any size."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // GROUP_BYTES))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """Only the named columns, so that extra ones can clash with nothing."""
    return docs.select("doc_id", "text", *more)


def normalised(text: Column | str = "text") -> Column:
    """Null as empty, A-Z in lower case."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns.values(), schema)], schema=schema
    )


def ids(column: pa.Array) -> np.ndarray:
    """doc_id as numbers, a missing one as the least."""
    return np.array(column.fill_null(np.iinfo(np.int64).min), np.int64)
