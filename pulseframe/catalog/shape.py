"""Output shaping shared by registered queries: rounded doubles, nested values as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseframe.functions import meta as M


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def nested_as_json(df: DataFrame) -> DataFrame:
    out = {}
    if "meta" in df.columns:
        out["meta"] = M.context_json(F.col("meta"))
    if "hk_sources" in df.columns:
        out["hk_sources"] = M.sources_json(F.col("hk_sources"))
    return df.withColumns(out) if out else df


def rollup_out(df: DataFrame) -> DataFrame:
    return nested_as_json(rounded(df, "avg_value", "sum_value")).select(
        "user_id", "metric_type", "bucket_ts", "unit", "avg_value", "sum_value", "min_value",
        "max_value", "n", "meta", "hk_sources",
    )


MINUTES = ("asleep_minutes", "rem_minutes", "core_minutes", "deep_minutes", "awake_minutes")


def night_out(df: DataFrame) -> DataFrame:
    return nested_as_json(rounded(df, *MINUTES)).select(
        "user_id", "sleep_date", "sleep_start_ts", "sleep_end_ts", *MINUTES, "meta", "hk_sources"
    )
