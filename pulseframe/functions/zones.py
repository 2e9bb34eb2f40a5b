"""Column expressions for time zones. All instants are UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulseframe.functions.clean import blank_to_null, strip

DISPLAY_FORMAT = "yyyy-MM-dd hh:mm a"


def _col(zone: Column | str) -> Column:
    return F.lit(zone) if isinstance(zone, str) else zone


def known_zone(zone: Column | str) -> Column:
    """The zone name if the runtime knows it, else NULL (never an error)."""
    zone = _col(zone)
    parsed = F.try_to_timestamp(
        F.concat(F.lit("2000-01-01 00:00:00 "), strip(zone)), F.lit("yyyy-MM-dd HH:mm:ss VV")
    )
    # fixed values: short names the runtime accepts although they are no region ids
    return F.when(parsed.isNotNull() | strip(zone).isin("EST", "MST", "HST"), strip(zone))


def safe_zone(*zones: Column | str) -> Column:
    """First usable zone of the list, UTC at the end."""
    return F.coalesce(*[known_zone(z) for z in zones], F.lit("UTC"))


def local_time(ts: Column, zone: Column | str) -> Column:
    """Wall-clock time in a valid zone."""
    return F.from_utc_timestamp(ts, _col(zone))


def local_date(ts: Column, zone: Column | str) -> Column:
    return F.to_date(local_time(ts, zone))


def local_trunc(ts: Column, unit: str, zone: Column | str) -> Column:
    """Instant at which the local hour or day of ``ts`` starts."""
    return F.to_utc_timestamp(F.date_trunc(unit, local_time(ts, zone)), _col(zone))


def offset_minutes(ts: Column, zone: Column | str) -> Column:
    """UTC offset of a zone at an instant, in whole minutes."""
    shifted = F.unix_micros(local_time(ts, zone)) - F.unix_micros(ts)
    return (shifted / 60_000_000).cast("int")


ZONE_KEYS = ("HKTimeZone", "tz_name", "timezone")


def zone_from_json(metadata: Column) -> Column:
    """Zone stated in provider metadata, in order of trust; blank text counts as not stated."""
    return F.coalesce(*[blank_to_null(F.get_json_object(metadata, f"$.{k}")) for k in ZONE_KEYS])


def stated_zone(meta: Column, metadata: Column) -> Column:
    """Zone of a sample: context first, then provider metadata; NULL when unknown.

    Metadata is parsed only for rows whose context has no zone.
    """
    return F.coalesce(meta["tz_name"], *[F.get_json_object(metadata, f"$.{k}") for k in ZONE_KEYS])


def effective_zone(meta: Column, metadata: Column) -> Column:
    return F.coalesce(stated_zone(meta, metadata), F.lit("UTC"))


def display(ts: Column, zone: Column) -> Column:
    return F.date_format(local_time(ts, zone), DISPLAY_FORMAT)


def day_window(anchor: Column, zone: str, days: int = 1, ending: int = 0) -> tuple[Column, Column]:
    """Half-open instants covering ``days`` local days that end ``ending`` days before today.

    Today is ``days=1``; yesterday ``days=1, ending=1``; the last seven days ``days=7``.
    The bounds are local midnights turned back into instants, so they stay right
    across daylight-saving changes.
    """
    today = local_date(anchor, zone)
    first = F.date_add(today, 1 - days - ending)
    after = F.date_add(today, 1 - ending)
    return (
        F.to_utc_timestamp(first.cast("timestamp"), F.lit(zone)),
        F.to_utc_timestamp(after.cast("timestamp"), F.lit(zone)),
    )
