"""What a viewer of recordings decides per row: what is drawn, at which time a pose or a stimulus is shown, what was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import bids


def draw_options(channels: DataFrame, colours: DataFrame) -> DataFrame:
    """channels (..., type) with the upper-cased type and the colour of colours (type, colour); no type counts as MISC."""
    shown = channels.withColumn("type", F.upper(F.coalesce("type", F.lit(""))))
    return shown.join(colours.withColumnsRenamed({"type": "__type"}), F.when(F.col("type") == "", "MISC").otherwise(F.col("type")) == F.col("__type"), "left").drop("__type")


def shown_time(cursor: Column, cursor_at: Column, now: Column, start: Column, length: Column, ttl: float) -> Column:
    """The cursor's time while it is fresh, else the centre of the window."""
    return F.when(cursor.isNotNull() & (now - cursor_at < ttl), cursor).otherwise(start + length / 2)


def shown_event(cursor_active: Column, cursor_event: Column, window_event: Column) -> Column:
    """The cursor's event while there is a cursor, even if it has none; else the window's."""
    return F.when(cursor_active, cursor_event).otherwise(window_event)


def picked(files: DataFrame, drop: str, name: str, ordinal: str) -> DataFrame:
    """(drop, picked, only_tables): of each drop of files the first that is a recording; whether, without one, there is a table."""
    first = F.min_by(F.when(bids.is_recording_name(F.col(name)), F.col(name)), F.when(bids.is_recording_name(F.col(name)), F.col(ordinal)))
    tables = F.bool_or(F.lower(F.col(name)).endswith(".tsv"))
    return files.groupBy(drop).agg(first.alias("picked"), tables.alias("__t")).select(drop, "picked", (F.col("picked").isNull() & F.col("__t")).alias("only_tables"))


def bundle(recordings: DataFrame, by: str, **hits: DataFrame) -> DataFrame:
    """recordings with a struct of each kind of sidecar (by, url, ...) found for them, null where there is none, and `sources`,
    a map from kind to URL."""
    out = recordings
    for kind, found in hits.items():
        out = out.join(found.select(by, F.struct(*[c for c in found.columns if c != by]).alias(kind)), by, "left")
    return out.withColumn("sources", F.map_from_arrays(F.array(*map(F.lit, hits)), F.array(*[F.col(k)["url"] for k in hits])))
