"""Texts that hold tables: annotation lists, marker files, INI sections. Built-in operations on (path, text); annotation lists and marker
files may come in parts, (path, part, text), cut after an entry or a line, with part ascending in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotations(files: DataFrame) -> DataFrame:
    """(path, onset, duration, label) of time-stamped annotation lists: entries end with NUL; onset and texts are set
    apart by 0x14, onset and duration by 0x15. An entry without a text only marks time."""
    entries = files.select("path", F.explode(F.split("text", "\x00")).alias("e")).where(F.contains("e", F.lit("\x14")))
    stamp = F.split(F.substring_index("e", "\x14", 1), "\x15")
    rest = F.filter(F.split(F.substring("e", F.instr("e", "\x14") + 1, F.length("e")), "\x14"), lambda x: x != "")
    made = entries.select("path", F.get(stamp, F.lit(0)).try_cast("double").alias("onset"), F.coalesce(F.get(stamp, F.lit(1)).try_cast("double"), F.lit(0.0)).alias("duration"), F.explode(rest).alias("label"))
    return made.where(F.col("onset").isNotNull())


def markers(files: DataFrame) -> DataFrame:
    """(path, label, trial, onset) of marker files: sections of NAME:, each with a list of trial and time."""
    pieces = files.select("path", *(["part"] if "part" in files.columns else []), F.posexplode(F.split("text", r"(?mi)^\s*NAME:\s*$")).alias("k", "s"))
    label, has = F.trim(F.regexp_extract("s", r"^\s*([^\r\n]*)", 1)), F.contains("s", F.lit("LIST OF SAMPLES"))
    if "part" in files.columns:
        sections = _continued(pieces, label, has)
    else:
        sections = pieces.where((F.col("k") > 0) & has).select("path", "s", label.alias("label"))
    listed = F.substring_index("s", "LIST OF SAMPLES", -1)
    rows = sections.select("path", "label", F.explode(F.regexp_extract_all(listed, F.lit(r"(?m)^\s*([+-]?\d+)(?:\.\d*)?\s+[+-]?\d+(?:\.\d*)?\s*$"), F.lit(0))).alias("row"))
    part = F.split(F.trim("row"), r"\s+")
    return rows.select("path", "label", F.get(part, F.lit(0)).cast("double").cast("int").alias("trial"), F.get(part, F.lit(1)).cast("double").alias("onset"))


def _continued(pieces: DataFrame, label: Column, has: Column) -> DataFrame:
    """(path, s, label): the pieces of parts (path, part, k, s) that hold a section's list, with the section's label. A section begins with
    a piece that isn't its part's first (k > 0) and goes on over the first pieces of later parts; its list is what follows the last
    title. Sections are put together from one small row of each piece, never from texts."""
    own = Window.partitionBy("path").orderBy("part", "k")
    marks = pieces.select("path", "part", "k", F.nullif(label, F.lit("")).alias("label"), F.when(has, F.struct("part", "k")).alias("title"))
    marks = marks.withColumn("section", F.sum((F.col("k") > 0).cast("long")).over(own))
    whole = Window.partitionBy("path", "section").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marks = marks.withColumns({"label": F.coalesce(F.first("label", True).over(whole), F.lit("")), "title": F.max("title").over(whole)})
    marks = marks.where((F.col("section") > 0) & (F.struct("part", "k") >= F.col("title"))).select(F.col("path").alias("__path"), F.col("part").alias("__part"), F.col("k").alias("__k"), "label")
    same = F.col("path").eqNullSafe(F.col("__path")) & (F.col("part") == F.col("__part")) & (F.col("k") == F.col("__k"))
    return pieces.join(marks, same).select("path", "s", "label")


def ini(files: DataFrame) -> DataFrame:
    """(path, section, key, value) of INI texts; lines that begin with ; are left out, and \\1 stands for a comma."""
    parts = F.filter(F.split("text", r"(?m)^(?=\[[^\]\n]+\]\s*$)"), lambda x: F.startswith(x, F.lit("[")))
    sections = files.select("path", F.explode(parts).alias("s")).select("path", F.regexp_extract("s", r"^\[([^\]]+)\]", 1).alias("section"), F.explode(F.split("s", r"\r?\n")).alias("line"))
    lines = sections.where(F.contains("line", F.lit("=")) & ~F.startswith(F.ltrim("line"), F.lit(";")) & ~F.startswith(F.ltrim("line"), F.lit("[")))
    value = F.replace(F.substring("line", F.instr("line", "=") + 1, F.length("line")), F.lit("\\1"), F.lit(","))
    return lines.select("path", "section", F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(value).alias("value"))
