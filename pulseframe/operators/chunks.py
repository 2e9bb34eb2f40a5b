"""Backfill chunks: a span cut into pieces at local midnights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.functions import zones as Z


def backfill_chunks(anchors: DataFrame, zone: str, span_days: int = 60, days: int = 7) -> DataFrame:
    """Chunks per user for the span that ends at ``anchor``: index, total, start and end.

    The span starts at the local midnight of its first day; the last chunk ends at the anchor.
    """
    first = F.date_add(Z.local_date(F.col("anchor"), zone), -span_days)
    index = F.explode(F.sequence(F.lit(0), F.lit(span_days // days)))
    return (
        anchors.withColumn("_first", first)
        .withColumn("_i", index)
        .select(
            *anchors.columns,
            (F.col("_i") + 1).alias("chunk_index"),
            F.lit(-(-span_days // days)).alias("chunk_total"),
            _midnight(F.date_add("_first", F.col("_i") * days), zone).alias("chunk_start"),
            F.least(_midnight(F.date_add("_first", (F.col("_i") + 1) * days), zone), F.col("anchor")).alias("chunk_end"),
        )
        .filter(F.col("chunk_start") < F.col("anchor"))
    )


def _midnight(date: Column, zone: str) -> Column:
    return F.to_utc_timestamp(date.cast("timestamp"), F.lit(zone))


def overlap_chunks(samples: DataFrame, anchors: DataFrame, zone: str, span_days: int = 60, days: int = 7) -> DataFrame:
    """Samples with every chunk they overlap (``start < chunk end`` and ``end > chunk start``).

    Chunks are evenly spaced local days, so the chunks of a sample follow from its own
    first and last day; no comparison against the list of chunks is needed. Anchors hold
    one row per user.
    """
    end = F.coalesce("end_ts", "ts")
    last_us = F.timestamp_micros(F.greatest(F.unix_micros(end) - 1, F.unix_micros("ts") - 1))
    first = F.date_add(Z.local_date(F.col("anchor"), zone), -span_days)

    def index(ts: Column) -> Column:
        return F.floor(F.datediff(Z.local_date(ts, zone), first) / days).cast("int")

    joined = samples.join(anchors.select("user_id", "anchor"), "user_id")
    first_us = _midnight(first, zone)
    lo, hi = F.greatest(index(F.col("ts")), F.lit(0)), F.least(index(last_us), F.lit(span_days // days))
    return (
        joined.filter((F.col("ts") < F.col("anchor")) & (end > first_us) & (hi >= lo))
        .withColumn("chunk_index", F.explode(F.sequence(lo, hi)) )
        .withColumn("chunk_index", F.col("chunk_index") + 1)
        .drop("anchor")
    )
