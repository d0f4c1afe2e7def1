"""Sinks and small decisions: reports, default windows, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Window lengths on offer, in seconds, and the bytes that a window may take. Fixed values.
PRESETS, BUDGET = [2, 5, 10, 20, 30], 1.5 * 1024 * 1024


def default_window(n_channels: Column, fs: Column, sample_bytes: Column) -> Column:
    """The longest preset within the byte budget, the shortest if none is, 10 if the rate isn't known."""
    rate = n_channels * fs * F.coalesce(sample_bytes, F.lit(4))
    out = F.when(rate.isNull() | F.isnan(rate.cast("double")) | (rate <= 0), 10)
    for p in reversed(PRESETS):
        out = out.when(rate * p <= BUDGET, p)
    return out.otherwise(PRESETS[0])


def overlaid(flags: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Flags (keys, bad) with the last edit (keys, at, bad) of each key on top."""
    last = edits.groupBy(*keys).agg(F.max_by("bad", "at").alias("__edit"))
    return flags.join(last, keys, "left").withColumn("bad", F.coalesce("__edit", "bad")).drop("__edit")


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").json(path)


def markdown(frame: DataFrame, rows: int = 1_000) -> str:
    """A table in Markdown of a report: at most so many rows, as a report is for reading."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [" | ".join(frame.columns), " | ".join("-" * 3 for _ in frame.columns)]
    lines += [" | ".join(cell(v) for v in r) for r in frame.limit(rows).collect()]
    return "\n".join(f"| {x} |" for x in lines) + "\n"
