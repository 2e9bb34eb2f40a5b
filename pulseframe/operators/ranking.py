"""Latest-per-key, top-k, semi joins and distinct keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order.

    Spark limits each group before the shuffle already (WindowGroupLimit), so a large
    group sends one row per map task.
    """
    return _first_n(df, keys, order, 1)


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    return _first_n(df, keys, order, n)


def _first_n(df, keys, order, n):
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def latest_sleep(nights: DataFrame) -> DataFrame:
    """Most recent night of every user."""
    return latest_per_key(nights, ["user_id"], [F.col("sleep_date").desc()])


def semi_ids(df: DataFrame, ids: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*cols).distinct(), list(cols), "left_semi")


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()
