"""Driver tables read as mirror data.

Maps the generic ``events``, ``documents`` and ``conversations`` tables to samples,
workouts, uploads and messages by fixed rules, so that all operators can run on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.session import configure

EVENT_COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with instants as timestamps and ``k`` taken out of the props."""
    configure(spark)
    return spark.read.schema(EVENT_COLUMNS).parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id",
        "cast(ts AS timestamp) AS ts",
        "cast(user_id AS string) AS user_id",
        "event_type",
        "value",
        # props is always {"k": n}; cut as text, because pushed-down filters repeat the expression
        "cast(substring_index(substring_index(props, ':', -1), '}', 1) AS int) AS k",
    )


# context columns of a mirror row, by k
CONTEXT = (
    "CASE k % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Kolkata' END AS timezone",
    "CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN -300 WHEN 2 THEN 330 END AS utc_offset_min",
    """CASE k % 4 WHEN 0 THEN named_struct('tz_name', 'UTC', 'utc_offset_min', 0)
        WHEN 1 THEN named_struct('tz_name', 'America/New_York', 'utc_offset_min', -300)
        WHEN 2 THEN named_struct('tz_name', 'Asia/Kolkata', 'utc_offset_min', 330) END AS meta""",
    """CASE k % 5 WHEN 0 THEN '{"HKTimeZone":"Europe/Paris"}' WHEN 1 THEN '{"tz_name":"Asia/Tokyo","x":1}' END
        AS hk_metadata""",
    "CASE k % 3 WHEN 0 THEN 'Watch' WHEN 1 THEN 'Phone' END AS hk_source_name",
    "CASE WHEN k % 3 < 2 THEN cast(k % 2 AS string) END AS hk_source_version",
    "ts + interval 1 minute AS created_at",
    "CASE WHEN event_id % 37 = 0 THEN 'delete' ELSE 'upsert' END AS op",
    "event_id AS ordinal",
)


def mirror_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sample rows of the mirror, deletes included, typed."""
    return events(spark, sf_dir).filter("event_type <> 'signup'").selectExpr(
        "user_id", "concat('S-', event_id) AS hk_uuid", "ts",
        "CASE WHEN event_type IN ('click', 'purchase') THEN ts + make_dt_interval(0, 0, k) END AS end_ts",
        """CASE event_type WHEN 'view' THEN 'heart_rate' WHEN 'purchase' THEN 'distance_walking_running_km'
            WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'steps' ELSE 'body_mass' END
            ELSE CASE k % 6 WHEN 0 THEN 'sleep_awake_minutes' WHEN 1 THEN 'sleep_in_bed_minutes'
             WHEN 2 THEN 'sleep_rem_minutes' WHEN 3 THEN 'sleep_core_minutes' WHEN 4 THEN 'sleep_deep_minutes'
             ELSE 'sleep_asleep_unspecified_minutes' END END AS metric_type""",
        """CASE event_type WHEN 'click' THEN cast(k AS double) WHEN 'purchase' THEN round(value / 10, 4)
            ELSE value END AS metric_value""",
        """CASE WHEN k % 10 <> 9 THEN CASE event_type WHEN 'view' THEN 'bpm' WHEN 'purchase' THEN 'km'
            WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'count' ELSE 'kg' END ELSE 'min' END END AS unit""",
        *CONTEXT, "event_id", "k",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored samples: mirror rows after ingest, deleted ones with a tombstone."""
    return mirror_samples(spark, sf_dir).selectExpr(
        "user_id", "hk_uuid", "ts", "end_ts", "metric_type", "metric_value", "unit", "created_at", "meta",
        "hk_source_name", "hk_source_version", "hk_metadata",
        "CASE WHEN op = 'delete' THEN ts + interval 1 day END AS deleted_at",
    )


def workout_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recorded workout, before it is taken apart into attributes."""
    return events(spark, sf_dir).filter("event_type = 'signup'").selectExpr(
        "user_id", "concat('W-', event_id) AS workout_uuid", "ts",
        "CASE WHEN k % 3 <> 0 THEN ts + make_dt_interval(0, 0, 1440 * (1 + k % 5)) END AS end_ts",
        "CASE k % 4 WHEN 0 THEN 37 WHEN 1 THEN 52 WHEN 2 THEN 13 ELSE 50 END AS activity_code",
        "value AS distance_km",
        "cast(1440 * (1 + k % 5) AS double) AS duration_min",
        "value * 2 AS energy_kcal",
        *CONTEXT,
    )


def workout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored attribute rows of all workouts, deleted ones with a tombstone."""
    from pulseframe.functions.metrics import activity_label
    from pulseframe.operators.workouts import unpivot_workout

    facts = workout_facts(spark, sf_dir).withColumn("source", activity_label(F.col("activity_code")))
    rows = unpivot_workout(facts)
    return rows.selectExpr(
        "user_id", "hk_uuid", "event_type", "ts", "end_ts", "value", "unit", "source", "created_at",
        "hk_source_name", "hk_source_version", "hk_metadata",
        "CASE WHEN op = 'delete' THEN ts + interval 1 day END AS deleted_at",
    )


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirror rows as an upload carries them: text cells, some of them junk or blank."""
    m = mirror_samples(spark, sf_dir)
    k = F.col("k")

    def text(c: str) -> Column:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    return m.select(
        "event_id", "ordinal",
        F.when(k % 9 == 0, F.concat(F.lit(" u"), "user_id")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(k % 11 == 0, "not a time").when(k % 11 == 1, "").otherwise(text("ts")).alias("timestamp"),
        F.when(k % 13 == 0, "").otherwise(F.col("metric_type")).alias("metric_type"),
        F.when(k % 7 == 0, "n/a").when(k % 7 == 1, " \t").when(k % 7 == 2, "NaN")
        .otherwise(F.concat(F.lit(" "), F.format_string("%.4f", "metric_value"))).alias("metric_value"),
        F.when(k % 8 == 0, " \n\r").otherwise(F.concat(F.lit("\t"), "unit", F.lit("\n"))).alias("unit"),
        F.lit(None).cast("string").alias("source"),
        F.coalesce("timezone", F.lit(" ")).alias("timezone"),
        F.when(k % 4 == 1, "-300.0").otherwise(F.col("utc_offset_min").cast("string")).alias("utc_offset_min"),
        text("created_at").alias("created_at"),
        F.when(F.col("op") == "delete", "DELETE").when(k % 2 == 0, "upsert").alias("op"),
        F.when(k % 17 == 0, "\x0b").otherwise(F.col("hk_uuid")).alias("hk_uuid"),
        text("end_ts").alias("end_ts"),
        "hk_source_name", "hk_source_version",
        F.when(k % 6 == 0, "not json").otherwise(F.col("hk_metadata")).alias("hk_metadata"),
    )


def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later batch that repeats every fifth sample with changed values."""
    again = mirror_samples(spark, sf_dir).filter("event_id % 5 = 0")
    return again.withColumns(
        {
            "metric_value": F.col("metric_value") + 1,
            "unit": F.when(F.col("event_id") % 10 != 0, F.col("unit")),
        }
    )


def zone_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Geocoded and device zone history per user."""
    users = events(spark, sf_dir).select("user_id").distinct()

    def entries(rows) -> DataFrame:
        items = F.array(
            *[
                F.struct(
                    F.lit(at).cast("timestamp").alias("effective_at"), F.lit(tz).alias("tz"), F.lit(src).alias("src")
                )
                for at, tz, src in rows
            ]
        )
        return users.select("user_id", F.inline(items))

    geo = entries(
        [
            ("2024-01-05", "Europe/Paris", "geocode"),
            ("2024-01-10", "Asia/Kolkata", "seed_device_tz"),
            ("2024-01-20", "America/New_York", "geocode"),
        ]
    )
    device = entries(
        [
            ("2024-01-03", "UTC", "device"),
            ("2024-01-08", "Asia/Kolkata", "device"),
            ("2024-01-12", "Not/AZone", "device"),
        ]
    )
    return geo, device


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload contents: the documents table, with the source as the uploading user."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.col("source").alias("user_id"), F.col("text").alias("content")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: the conversations table, with the turn as message order and clock."""
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        (F.col("conv_id") % 7).cast("string").alias("user_id"),
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("id"),
        # pairs of turns share a time, so that ties occur
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 60 + F.floor(F.col("turn") / 2)).alias("timestamp"),
        "role",
        F.col("text").alias("content"),
    )


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows with a title for two out of three conversations."""
    conv = messages(spark, sf_dir).select("user_id", "conversation_id").distinct()
    title = F.when(F.col("conversation_id") % 3 != 0, F.concat(F.lit("Chat "), "conversation_id"))
    return conv.withColumn("title", title)
