"""Column expressions for context objects, provider metadata and provenance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulseframe.functions.clean import blank_to_null, to_offset_minutes
from pulseframe.schema import META, SOURCES

RAW_KEY = "_raw_hk_metadata"


def tz_context(zone: Column, offset: Column) -> Column:
    """Zone context of a row; NULL when neither part is known."""
    return context_struct(blank_to_null(zone), to_offset_minutes(offset))


def context_struct(zone: Column, offset: Column) -> Column:
    return F.when(
        zone.isNotNull() | offset.isNotNull(),
        F.struct(zone.alias("tz_name"), offset.cast("int").alias("utc_offset_min")),
    )


def context_json(meta: Column) -> Column:
    """JSON text of a context, absent parts left out."""
    return F.to_json(meta)


def json_object(text: Column) -> Column:
    """Open JSON object as a map of raw JSON values; NULL when the text is no object."""
    return F.try_parse_json(text).try_cast("map<string,variant>")


def merge_metadata(text: Column, meta: Column) -> Column:
    """Provider metadata with the row's zone context laid over it.

    Text that is no JSON object is kept whole under its own key.
    """
    context = F.map_filter(
        F.create_map(
            F.lit("tz_name"), F.to_variant_object(F.struct(meta["tz_name"].alias("v")))
            .try_cast("map<string,variant>")["v"],
            F.lit("utc_offset_min"), F.to_variant_object(F.struct(meta["utc_offset_min"].alias("v")))
            .try_cast("map<string,variant>")["v"],
        ),
        lambda _, v: ~F.is_variant_null(v),
    )
    raw = F.to_variant_object(F.struct(text.alias("v"))).try_cast("map<string,variant>")
    base = F.when(F.coalesce(text, F.lit("")) == "", None).otherwise(
        F.coalesce(
            json_object(text), F.transform_keys(raw, lambda k, v: F.lit(RAW_KEY))
        )
    )
    merged = F.when(base.isNull(), context).otherwise(
        F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(context, k)), context)
    )
    # as one object the keys come out sorted, so equal contents give equal text
    return F.when(meta.isNull(), text).otherwise(F.to_json(F.to_variant_object(merged)))


def json_safe(text: Column) -> Column:
    """Metadata with only string and number values kept; NULL when nothing is left.

    Dates arrive as ISO strings in JSON and therefore stay.
    """
    kept = F.map_filter(
        json_object(text),
        lambda _, v: F.schema_of_variant(v).isin("STRING", "BIGINT", "DOUBLE", "BOOLEAN")
        | F.schema_of_variant(v).startswith("DECIMAL"),
    )
    return F.when(F.size(kept) > 0, F.to_json(kept))


def json_number(text: Column, path: str) -> Column:
    """Number at a JSON path, read as a double so that fractions survive."""
    return F.get_json_object(text, path).try_cast("double")


def source_list(name: Column, version: Column) -> Column:
    """One-element source array, empty when the source has no name."""
    return F.when(
        name.isNotNull(), F.array(F.struct(name.alias("name"), version.alias("version")))
    ).otherwise(F.array().cast(SOURCES))


def sources_json(col: Column) -> Column:
    return F.to_json(col, {"ignoreNullFields": "false"})


def no_sources() -> Column:
    return F.array().cast(SOURCES)
