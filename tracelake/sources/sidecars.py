"""Metadata beside recordings: tab-separated tables, JSON files, manifests, and their inheritance.

Files come as DataFrames (path, text), as `spark.read.text(..., wholetext=True)` with the input file's name gives them,
so any store that Spark reads will do, and each function is a plan of built-in operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import scalars as X
from tracelake.operators import joins as J


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def rows(files: DataFrame) -> DataFrame:
    """(path, row, cells): a map from lower-cased column name to cell for each line of a table. Cells are set apart by
    tabs if the header has any, else by white space; lines that start with # and blank ones are left out; quotes go.
    A file may come in parts, (path, part, text), cut after a line: the header is the first line of the first that has any."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.ltrim(x), F.lit("#")))
    parts = ["part"] if "part" in files.columns else []
    listed = files.select("path", *parts, lines.alias("lines")).where(F.size("lines") > 0)
    if parts:
        own = Window.partitionBy("path").orderBy("part")
        heads = listed.select("path", "part", F.get("lines", F.lit(0)).alias("line"), F.size("lines").cast("long").alias("n"))
        heads = heads.select(F.col("path").alias("__path"), F.col("part").alias("__part"), F.first("line").over(own).alias("head"), (F.sum("n").over(own) - F.col("n")).alias("before"))
        listed = listed.join(heads, F.col("path").eqNullSafe(F.col("__path")) & (F.col("part") == F.col("__part")))
    else:
        listed = listed.withColumns({"head": F.get("lines", F.lit(0)), "before": F.lit(0)})
    listed = listed.select("path", "lines", "head", "before", F.contains("head", F.lit("\t")).alias("tabs"))
    strip = lambda x: F.regexp_replace(F.trim(x), '^"(.*)"$', "$1")
    cells = lambda line: F.transform(F.when(F.col("tabs"), F.split(line, "\t")).otherwise(F.split(F.trim(line), r"\s+")), strip)
    names = F.transform(cells(F.col("head")), F.lower)
    body = listed.select("path", "tabs", names.alias("names"), "before", F.posexplode("lines").alias("at", "line"))
    body = body.withColumn("row", F.col("before") + F.col("at") - 1).where("row >= 0")
    return body.select("path", "row", F.map_from_entries(F.arrays_zip("names", F.slice(F.concat(cells(F.col("line")), F.array_repeat(F.lit(""), F.size("names"))), 1, F.size("names")))).alias("cells"))


def _cell(name: str) -> Column:
    return X.bids_cell(F.col("cells")[name])


def channels(files: DataFrame) -> DataFrame:
    """Rows of _channels.tsv in file order; a missing status is `good`, rows without a name go."""
    number = lambda name: X.float_prefix(_cell(name)).alias(name)
    made = rows(files).select("path", "row", _cell("name").alias("name"), _cell("type").alias("type"), _cell("units").alias("units"), F.coalesce(F.lower(_cell("status")), F.lit("good")).alias("status"), number("low_cutoff"), number("high_cutoff"), number("sampling_frequency"))
    return made.where(F.col("name").isNotNull())


def events(files: DataFrame) -> DataFrame:
    """Rows of _events.tsv with a finite onset. trial_type names an event before value does; a stimulus is the image id,
    else the stem of its file, else what the label holds."""
    onset = X.float_prefix(_cell("onset"))
    stem = F.regexp_replace(F.substring_index(_cell("stim_file"), "/", -1), r"\.[^.]*$", "")
    label = F.coalesce(_cell("trial_type"), _cell("value"))
    from_label = F.regexp_extract(label, r"stim_(train|test),(\d+),", 2)
    made = rows(files).select("path", "row", onset.alias("onset"), F.coalesce(X.float_prefix(_cell("duration")), F.lit(0.0)).alias("duration"), label.alias("label"), X.float_prefix(_cell("sample")).alias("sample"), F.coalesce(_cell("image_id"), stem, F.when(from_label != "", from_label)).alias("stimulus_id"))
    return made.where(F.col("onset").isNotNull() & ~F.isnan("onset"))


def electrodes(files: DataFrame) -> DataFrame:
    """Rows of _electrodes.tsv with strictly numeric positions; `skipped` counts a file's rows without them, and
    `duplicate` marks names that a file has more than once."""
    number = lambda name: F.when(_cell(name).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), _cell(name).try_cast("double"))
    parsed = rows(files).select("path", "row", _cell("name").alias("name"), *[number(c).alias(c) for c in "xyz"], *[_cell(c).alias(c) for c in ("type", "material", "coordinate_system")])
    good = F.col("name").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    bad = parsed.groupBy("path").agg(F.sum((~good).cast("long")).alias("skipped"))
    twice = parsed.where(good).groupBy("path", "name").agg((F.count("*") > 1).alias("duplicate"))
    return parsed.where(good).join(twice, ["path", "name"]).join(bad, "path")


def coordinate_system(files: DataFrame, modality: str) -> DataFrame:
    """(path, system, units) of _coordsystem.json: the modality's own fields first, else those of any other."""
    field = lambda kind: F.coalesce(*[F.get_json_object("text", f"$.{m}Coordinate{kind}") for m in dict.fromkeys([modality, "EEG", "iEEG", "MEG", "NIRS", "EMG"])])
    return files.select("path", F.coalesce(field("System"), F.lit("Other")).alias("system"), F.coalesce(field("Units"), F.lit("n/a")).alias("units"))


def recording_json(files: DataFrame) -> DataFrame:
    """(path, fs, duration, reference, line_frequency, extra) of _eeg.json and its like; an impossible rate is null, and
    the whole object passes through as a variant."""
    number = lambda k: F.get_json_object("text", f"$.{k}").try_cast("double")
    return files.select("path", F.when(number("SamplingFrequency") > 0, number("SamplingFrequency")).alias("fs"), number("RecordingDuration").alias("duration"), F.get_json_object("text", "$.EEGReference").alias("reference"), number("PowerLineFrequency").alias("line_frequency"), F.try_parse_json("text").alias("extra"))


def candidates(path: Column, suffix: str, levels: int = 4) -> Column:
    """Paths where a recording's sidecar may lie: its own folder, then its parents, four levels at most. In each folder
    the names with most entities come first, with or without the leading subject, then the bare suffix."""
    folders = F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/")
    parts = F.split(F.regexp_replace(F.substring_index(path, "/", -1), r"_[^_]*$", ""), "_")

    def names(parts: Column) -> Column:
        n = F.size(parts)
        named = lambda start, size: F.concat(F.array_join(F.slice(parts, start, size), "_"), F.lit(f"_{suffix}"))
        without = lambda size: F.when((size < n) & F.startswith(F.get(parts, F.lit(0)), F.lit("sub-")), named(2, size))
        found = F.array_compact(F.flatten(F.transform(F.sequence(n, F.lit(1)), lambda size: F.array(named(1, size), without(size)))))
        return F.concat(found, F.array(F.lit(suffix)))

    def listed(v: Column) -> Column:
        folders = v["folders"]
        ups = F.transform(F.sequence(F.lit(0), F.least(F.size(folders), F.lit(levels)) - 1), lambda k: F.array_join(F.slice(folders, 1, F.size(folders) - k), "/"))
        return F.flatten(F.transform(ups, lambda d: F.transform(v["names"], lambda x: F.concat(d, F.lit("/"), x))))

    return X.once(F.struct(folders.alias("folders"), X.once(parts, names).alias("names")), listed)


def inherited(recordings: DataFrame, files: DataFrame, suffix: str) -> DataFrame:
    """Each recording (path) with the nearest sidecar that files (path, ...) has."""
    return J.first_match(recordings, candidates(F.col("path"), suffix), files.withColumnRenamed("path", "sidecar"), "sidecar")


def manifest(files: DataFrame, dataset: str) -> DataFrame:
    """(path, size, checksum, url) of a manifest in JSON; entries whose URL names another dataset are left out."""
    listed = files.select(F.explode(F.from_json("text", "array<struct<path:string,size:long,checksum:string,checksum_algorithm:string,url:string>>")).alias("e")).select("e.*")
    named = F.regexp_extract("url", r"/((?:ds|nm|on|xx)\d{6})(?:/|$)", 1)
    return listed.where((named == "") | (named == dataset))
