"""Column expressions for tolerant parsing of text input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulseframe import schema as S

#: fixed values: blank, tab, line feed, vertical tab, form feed, carriage return
WHITE = " \t\n\x0b\f\r"


def strip(col: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(col.cast("string"), F.lit(WHITE))


def blank_to_null(col: Column) -> Column:
    """Stripped text; empty or blank text is NULL."""
    return F.nullif(strip(col), F.lit(""))


def to_instant(col: Column) -> Column:
    """Instant from ISO text, UTC where the text carries no zone; junk is NULL."""
    return F.try_to_timestamp(strip(col))


def to_number(col: Column) -> Column:
    """Double from text; junk is NULL, and so is text that says NaN."""
    return F.nullif(strip(col).try_cast("double"), F.lit(float("nan")))


def to_offset_minutes(col: Column) -> Column:
    """Whole minutes from text that may carry a fraction (cut towards zero)."""
    return to_number(col).try_cast("int")


def latest_end(start: Column | str) -> Column:
    return (F.col(start) if isinstance(start, str) else start) + F.make_dt_interval(days=F.lit(S.MAX_SPAN_DAYS))


def within_span(start: Column | str, end: Column | str) -> Column:
    """An end that no interval join has to lay onto more days than a span may have."""
    end = F.col(end) if isinstance(end, str) else end
    return F.when(end > latest_end(start), latest_end(start)).otherwise(end)


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


def is_delete(op: Column) -> Column:
    """An operation cell means delete in any case; everything else is an upsert."""
    return F.lower(F.coalesce(op, F.lit("upsert"))) == "delete"


def clean_title(col: Column) -> Column:
    """Conversation title: outer quotes and dots off, label prefix off, cut at 60 characters."""
    bare = F.regexp_replace(strip(col), r"""^["'.:]+|["'.:]+$""", "")
    bare = F.regexp_replace(bare, r"^(?i:title:)\s*", "")
    short = F.when(F.length(bare) > 60, F.concat(F.substring(bare, 1, 57), F.lit("..."))).otherwise(bare)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("New Chat"))


def format_minutes(col: Column) -> Column:
    """``6 hr 45 min`` from sixty minutes on, ``45 min`` below."""
    whole = F.round(col).cast("long")
    return F.when(
        whole >= 60, F.format_string("%d hr %d min", F.floor(whole / 60), whole % 60)
    ).when(whole.isNotNull(), F.format_string("%d min", whole))


def four_decimals(col: Column) -> Column:
    """Fixed four-decimal text used in mirror rows; non-finite values are blank."""
    return F.when(is_finite(col), F.format_string("%.4f", col)).otherwise(F.lit(""))


def one_line(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), "[\n\r]", " ")
