"""Stored tables as parquet folders partitioned by day and user bucket, with a locator of keys.

A part is one day of one bucket of users: the unit that is read, pruned and replaced, so a late row
rewrites one part and not the day of all users. Where a key lies is found in a locator, a narrow
table of key hashes and days that is partitioned by user bucket, without opening the facts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from pulseframe.operators.merge import merge_by_policy

DAY, BUCKET = "day", "user_bucket"
#: buckets of users in a table, fixed for its life: as many as make a day of one bucket some GB at most
BUCKETS = 16
_PARTS = [T.StructField(DAY, T.DateType()), T.StructField(BUCKET, T.IntegerType())]
Part = tuple  # (day, bucket)


def bucket_of(user: Column | str = "user_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty one if nothing is stored yet."""
    full = T.StructType([*schema.fields, *_PARTS])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def scan_samples(
    df: DataFrame, user_id: str, t0: Column, t1: Column, types: Sequence[str] | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Samples of one user in ``[t0, t1)``; every filter is on a stored column, and of a stored table
    only the days and the bucket of the user are read."""
    rows = df.filter((F.col("user_id") == user_id) & (F.col("ts") >= t0) & (F.col("ts") < t1))
    if DAY in df.columns:
        rows = rows.filter((F.col(DAY) >= F.to_date(t0)) & (F.col(DAY) <= F.to_date(t1)))
    if BUCKET in df.columns:
        rows = rows.filter(F.col(BUCKET) == bucket_of(F.lit(user_id), buckets))
    return rows.filter(F.col("metric_type").isin(*types)) if types else rows


def parts_of(df: DataFrame, day: Column | str = DAY, buckets: int = BUCKETS) -> set[Part]:
    """Distinct parts of a set of rows with a ``user_id``: days of the retained span times buckets
    at most, whatever the number of rows."""
    day = F.col(day) if isinstance(day, str) else day
    found = df.select(day.alias("d"), bucket_of(buckets=buckets).alias("b")).filter("d IS NOT NULL").distinct().collect()
    return {(r.d, r.b) for r in found}


def on_parts(df: DataFrame, parts: set[Part]) -> DataFrame:
    """Rows of the listed parts; only their folders are read. No parts: no rows."""
    if not parts:
        return df.filter(F.lit(False))
    # both plain lists prune as well, and the pairs then leave out the other combinations
    days, buckets = ({p[i] for p in parts} for i in (0, 1))
    pair = F.concat_ws("/", F.col(DAY).cast("string"), F.col(BUCKET).cast("string"))
    near = df.filter(F.col(DAY).isin(*sorted(days)) & F.col(BUCKET).isin(*sorted(buckets)))
    return near if len(parts) == len(days) * len(buckets) else near.filter(pair.isin(*sorted(f"{d}/{b}" for d, b in parts)))


def write_parts(df: DataFrame, path: str, sort: Sequence[str]) -> None:
    """Write rows over the parts they belong to.

    The rows of a part are brought together, and Spark splits a part into as many tasks as its
    measured size needs (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), so a crowded part
    or user is written by many; inside a file rows are sorted for min/max pruning.
    """
    (
        df.hint("rebalance", DAY, BUCKET)
        .sortWithinPartitions(DAY, BUCKET, *sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY, BUCKET)
        .parquet(path)
    )


def in_parts(df: DataFrame, day_col: str, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn(DAY, F.to_date(day_col)).withColumn(BUCKET, bucket_of(buckets=buckets))


def rewrite_parts(
    spark: SparkSession, path: str, schema: T.StructType, parts: set[Part], day_col: str,
    sort: Sequence[str], change: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS,
) -> None:
    """Replace whole parts of a stored table by what ``change`` makes of them.

    A dynamic overwrite keeps what its tasks write aside and replaces parts when all tasks are done,
    so nothing is overwritten while it is still being read, a lost executor only repeats its tasks,
    and the rows are written once. Parts that end up without rows take no part in it; their folders,
    which still hold their old files, are removed.
    """
    if not parts:
        return
    stored = on_parts(read_table(spark, path, schema), parts)
    fresh = change(stored.drop(DAY, BUCKET)).select(*schema.fieldNames())
    old = _files(spark, path, parts)
    write_parts(in_parts(fresh, day_col, buckets), path, sort)
    for part, names in _files(spark, path, set(old)).items():
        if names & old[part]:
            remove(spark, _folder_of(path, part))


def _folder_of(path: str, part: Part) -> str:
    return f"{path}/{DAY}={part[0]}/{BUCKET}={part[1]}"


def _files(spark: SparkSession, path: str, parts: set[Part]) -> dict[Part, set[str]]:
    """Names of the files of each part that has a folder: a folder operation a part, no job."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = ((part, spark._jvm.org.apache.hadoop.fs.Path(_folder_of(path, part))) for part in parts)
    return {part: {f.getPath().getName() for f in files.listStatus(folder)} for part, folder in folders if files.exists(folder)}


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Locator:
    """Days on which the rows of a key may lie.

    Entries are appended before the rows themselves are written and are never taken back, so one
    may be out of date but none is missing; what is out of date costs a part read for nothing.
    :meth:`compact` leaves one entry a key and day. Keys of the attributes of one workout
    (``id|attribute``) are one key. Equal hashes of different keys do no harm.
    """

    SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField(DAY, T.DateType()), _PARTS[1]])

    def __init__(self, spark: SparkSession, path: str, key: str = "hk_uuid", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.select(F.xxhash64("user_id", F.substring_index(self.key, "|", 1)).alias("key"), bucket_of(buckets=self.buckets).alias(BUCKET), *(
            c for c in (DAY,) if c in df.columns))

    def add(self, rows: DataFrame, day_col: str) -> None:
        """Note where rows will be written."""
        self._write(self._keyed(rows.select("user_id", self.key, F.to_date(day_col).alias(DAY))), "append", f"{self.path}/{self._generation()}")

    def _write(self, entries: DataFrame, mode: str, path: str) -> None:
        entries.distinct().hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "key").write.mode(mode).partitionBy(BUCKET).parquet(path)

    def _folder(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generation(self) -> int:
        """The latest complete generation of entries; a number each, since compacting makes a new one."""
        at, files = self._folder()
        names = [str(f.getPath().getName()) for f in files.listStatus(at)] if files.exists(at) else []
        done = [n for n in names if n.isdigit() and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(map(int, done), default=0)

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{self._generation()}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def near(self, keys: DataFrame) -> DataFrame:
        """Entries of the keys; only the buckets of their users are read."""
        wanted = self._keyed(keys.select("user_id", self.key)).distinct()
        buckets = sorted(r[0] for r in wanted.select(BUCKET).distinct().collect())  # few, a number each
        mine = self.entries().filter(F.col(BUCKET).isin(*buckets)) if buckets else self.entries().filter(F.lit(False))
        return mine.join(wanted, [BUCKET, "key"], "left_semi")

    def parts(self, keys: DataFrame) -> set[Part]:
        """Parts that may hold rows of the keys."""
        return {(r[0], r[1]) for r in self.near(keys).select(DAY, BUCKET).distinct().collect()}

    def compact(self, most_files: int = 4_000) -> None:
        """Rewrite the entries once there are many small files of them."""
        at, files = self._folder()
        if not files.exists(at) or files.getContentSummary(at).getFileCount() <= most_files:
            return
        old = self._generation()
        self._write(self.entries(), "overwrite", f"{self.path}/{old + 1}")
        remove(self.spark, f"{self.path}/{old}")


def write_upsert(
    spark: SparkSession, batch: DataFrame, path: str, schema: T.StructType, keys: Sequence[str],
    overwrite: Sequence[str], keep: Sequence[str], locator: Locator,
) -> set[Part]:
    """Merge a batch into a stored table; only parts that hold touched rows are read and rewritten.

    A row may move to another day, so both the part it leaves and the part it enters are
    affected. Returns the affected parts.
    """
    parts = locator.parts(batch) | parts_of(batch, F.to_date("ts"), locator.buckets)
    locator.add(batch, "ts")
    rewrite_parts(
        spark, path, schema, parts, "ts", keys,
        lambda stored: merge_by_policy(stored, batch, keys, overwrite, keep, whole=True), locator.buckets,
    )
    return parts


def replace_slice(new: DataFrame, path: str, day_col: str, sort: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write derived rows over the parts they belong to."""
    write_parts(in_parts(new, day_col, buckets), path, sort)


def read_uploads(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """Uploads ledger, optionally of one user (the filter reaches the scan)."""
    rows = spark.read.parquet(path)
    return rows if user_id is None else rows.filter(F.col("user_id") == user_id)
