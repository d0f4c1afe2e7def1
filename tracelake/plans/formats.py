"""Queries for texts and tables beside recordings. The texts are made from rows of `events`: of each user, files of
LINES lines, or one file of any length, which comes in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import texts as T
from tracelake.operators import folds
from tracelake.plans.registry import query, table
from tracelake.sources import sidecars


LINES = 40
SQL = f"e AS (SELECT *, 'u' || user_id || '-' || ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // {LINES}) AS path FROM events)"


def _files(spark, sf_dir: str, line, head: str, sep: str):
    """(path, text): a line for each event of a user, in order of event_id, LINES to a file."""
    e = folds.numbered(table(spark, sf_dir, "events"), "user_id", ["event_id"], "place").withColumn("file", F.floor(F.col("place") / LINES))
    e = e.groupBy("user_id", "file").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("rows"))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.col("file").cast("string")).alias("path"), F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), sep), F.lit(sep)).alias("text"))


#: Lines in a part of a file.
PART = 1000


def _parts(spark, sf_dir: str, line, head: str, sep: str):
    """(path, part, text): a file for each user, with a line for each of the user's events, in order of event_id. A file comes in parts of
    PART lines, whatever its length; the head stands in the first."""
    e = folds.numbered(table(spark, sf_dir, "events"), "user_id", ["event_id"], "place").withColumn("part", F.floor(F.col("place") / PART))
    e = e.groupBy("user_id", "part").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("rows"))
    head = F.when(F.col("part") == 0, head).otherwise("")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "part", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), sep), F.lit(sep)).alias("text"))


@query(f"WITH {SQL} SELECT path, event_type AS name, CASE WHEN event_id % 4 = 0 THEN 'bad' ELSE 'good' END AS status, CASE WHEN event_id % 3 <> 0 THEN event_id::DOUBLE END AS low_cutoff FROM e")
def channels_table(spark, sf_dir):
    line = F.concat_ws("\t", "event_type", F.when(F.col("event_id") % 4 == 0, "BAD").when(F.col("event_id") % 4 == 1, "n/a").otherwise("good"), F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).otherwise("n/a"))
    return sidecars.channels(_files(spark, sf_dir, line, "name\tstatus\tlow_cutoff\n# a note\n", "\n")).select("path", "name", "status", "low_cutoff")


@query(f"WITH {SQL} SELECT path, event_id::DOUBLE AS onset, event_type AS label, CASE WHEN event_id % 2 = 0 THEN 's' || event_id END AS stimulus_id FROM e WHERE event_id % 5 <> 0")
def events_table(spark, sf_dir):
    line = F.concat_ws("\t", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("event_id").cast("string")), "event_type", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("dir/s"), F.col("event_id").cast("string"), F.lit(".png"))).otherwise("n/a"))
    return sidecars.events(_files(spark, sf_dir, line, "onset\ttrial_type\tstim_file\n", "\n")).select("path", "onset", "label", "stimulus_id")


@query("SELECT 'u' || user_id AS path, event_id::DOUBLE AS onset, (event_id % 3)::DOUBLE AS duration, event_type AS label FROM events UNION ALL SELECT 'u' || user_id, event_id, event_id % 3, 'second' FROM events WHERE event_id % 2 = 0")
def annotation_lists(spark, sf_dir):
    stamp = F.concat(F.lit("+"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("\x15"), (F.col("event_id") % 3).cast("string"))).otherwise(""))
    line = F.concat(stamp, F.lit("\x14"), "event_type", F.lit("\x14"), F.when(F.col("event_id") % 2 == 0, "second\x14").otherwise(""))
    return T.annotations(_parts(spark, sf_dir, line, "+0\x14\x14\x00", "\x00"))


@query("SELECT 'u' || user_id AS path, 'Trigger' AS label, (event_id % 4)::INT AS trial, event_id + 0.5::DOUBLE AS onset FROM events")
def marker_files(spark, sf_dir):
    line = F.concat(F.lit("  +"), (F.col("event_id") % 4).cast("string"), F.lit("\t+"), F.col("event_id").cast("string"), F.lit(".5"))
    head = "NUMBER OF MARKERS:\n1\n\nNAME:\nTrigger\nNUMBER OF SAMPLES:\n9\nLIST OF SAMPLES:\nTRIAL NUMBER\tTIME\n"
    return T.markers(_parts(spark, sf_dir, line, head, "\n"))


@query(f"WITH {SQL} SELECT path, 'Channel Infos' AS section, 'Ch' || event_id AS key, event_type || ',,0.5' AS value FROM e UNION ALL SELECT DISTINCT path, 'Common Infos', 'DataFile', 'a.eeg' FROM e")
def ini_sections(spark, sf_dir):
    line = F.concat(F.lit("Ch"), F.col("event_id").cast("string"), F.lit("="), "event_type", F.lit("\\1,0.5"))
    return T.ini(_files(spark, sf_dir, line, "Header Version 1.0\n; a note = none\n[Common Infos]\nDataFile=a.eeg\n\n[Channel Infos]\n; more\n", "\n"))
