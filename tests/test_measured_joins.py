"""What goes through the driver does not depend on how well files are compressed."""

from pyspark.sql import functions as F

from pulseframe.plans.ingest import Store, apply_samples
from pulseframe.session import measured_joins
from pulseframe.sources import adapter as A

SF = "/root/testdata/sf0.001"
KEY = "spark.sql.autoBroadcastJoinThreshold"


def _kinds(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BroadcastHashJoin" in plan.split("== Initial Plan ==")[0]


def test_a_well_compressed_side_is_not_sent_by_its_file_size(spark, tmp_path):
    """200,000 equal names are a few KB of file and some MB of rows."""
    n = 200_000
    spark.range(n, numPartitions=1).select((F.col("id") % 7).alias("k"), F.lit("x" * 40).alias("name")).write.parquet(f"{tmp_path}/a")
    spark.range(10 * n, numPartitions=4).select((F.col("id") % 1_000_003).alias("k")).write.parquet(f"{tmp_path}/b")
    joined = lambda: spark.read.parquet(f"{tmp_path}/b").join(spark.read.parquet(f"{tmp_path}/a").filter("k = 3"), "k", "left_semi").select("k")
    many = lambda: spark.read.parquet(f"{tmp_path}/b").join(spark.read.parquet(f"{tmp_path}/a"), "k", "left_semi").select("k")
    try:
        spark.conf.set(KEY, "2m")
        assert _kinds(many())  # by the size of its file
        with measured_joins(spark):
            assert not _kinds(many())
        assert spark.conf.get(KEY) == "2m"
    finally:
        spark.conf.unset(KEY)
    with measured_joins(spark):
        assert _kinds(joined())  # few rows are sent still


def test_changes_are_merged_with_measured_joins(spark, tmp_path, monkeypatch):
    from pulseframe.plans import ingest

    seen, merge = [], ingest._merge_raw
    monkeypatch.setattr(ingest, "_merge_raw", lambda store, *rest: (seen.append(store.spark.conf.get(KEY)), merge(store, *rest))[1])
    spark.conf.unset(KEY)  # as in most sessions
    before = spark.conf.get(KEY)
    apply_samples(Store(spark, str(tmp_path), 2), A.samples(spark, SF).limit(50), "one")
    assert seen == ["-1"] and spark.conf.get(KEY) == before
