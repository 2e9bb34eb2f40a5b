"""The uploads ledger as a stored table that is changed a set of arrivals or reports at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulseframe import schema as S
from pulseframe.operators import ledger as L
from pulseframe.sources.tables import BUCKET, BUCKETS, bucket_of

APPLIED = "applied"
_KEY = ["user_id", "content_hash"]


class StoredLedger:
    """Uploads by user bucket; a change reads and rewrites the buckets of its users only.

    Changes carry rising numbers, and every row knows the last one applied to it. A change that is
    replayed, also after it was written in part, leaves rows alone that it reached before, and its
    decisions are those of the first time.
    """

    SCHEMA = T.StructType([*S.LEDGER.fields, T.StructField(APPLIED, T.LongType()), T.StructField(BUCKET, T.IntegerType())])

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/uploads")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def _of(self, users: DataFrame) -> DataFrame:
        buckets = sorted(r[0] for r in users.select(bucket_of(buckets=self.buckets)).distinct().collect())  # few, a number each
        return self.read().filter(F.col(BUCKET).isin(*buckets)) if buckets else self.read().filter(F.lit(False))

    def _once(self, df: DataFrame, name: str) -> DataFrame:
        """Written the first time, read from there at every later one."""
        path = f"{self.root}/_changes/{name}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _replace(self, rows: DataFrame, number: int) -> None:
        """Write whole buckets; each is swapped in one step after all are staged."""
        staging = f"{self.root}/_staging/{number}"
        rows.select(*self.SCHEMA.fieldNames()[:-1]).write.mode("overwrite").parquet(staging)
        staged = self.spark.read.parquet(staging).withColumn(BUCKET, bucket_of(buckets=self.buckets))
        (staged.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *_KEY).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.root}/uploads"))

    def arrive(self, number: int, uploads: DataFrame, now: Column, timeout_s: int = S.PROCESSING_TIMEOUT_S) -> DataFrame:
        """Decide uploads ``(user_id, content_hash, ordinal, ...)`` and write what becomes of them;
        returns the uploads with their ``decision``. Overdue entries of their users become ``timeout``."""
        mine = self._of(uploads).drop(BUCKET)
        decided = self._once(L.upload_decision(uploads, mine, now, timeout_s), f"arrivals-{number}")
        users = uploads.select("user_id").distinct()
        open_ = mine.filter(F.col(APPLIED) < number).join(users, "user_id", "left_semi")
        others = mine.filter(F.col(APPLIED) >= number).unionByName(mine.filter(F.col(APPLIED) < number).join(users, "user_id", "left_anti"))
        fresh = decided.join(others.select(*_KEY), _KEY, "left_anti")
        changed = L.write_back(open_.drop(APPLIED), fresh, now, timeout_s).withColumn(APPLIED, F.lit(number).cast("long"))
        self._replace(others.unionByName(changed.select(*others.columns)), number)
        return decided

    def report(self, number: int, states: DataFrame, now: Column, timeout_s: int = S.PROCESSING_TIMEOUT_S) -> None:
        """Bring statuses in line with task reports ``(user_id, task_id, state)``."""
        mine = self._of(states).drop(BUCKET)
        open_ = mine.filter(F.col(APPLIED) < number).withColumn(APPLIED, F.lit(number).cast("long"))
        changed = L.status_reconcile(open_, states, now, timeout_s)
        self._replace(mine.filter(F.col(APPLIED) >= number).unionByName(changed), number)
