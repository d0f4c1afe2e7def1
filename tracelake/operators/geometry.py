"""Positions of sensors: frames, template positions, coordinate sets of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(name: str | Column) -> Column:
    """What names of sensors and channels are compared by."""
    return F.lower(F.trim(F.col(name) if isinstance(name, str) else name))


def template_positions(channels: DataFrame, montage: DataFrame, supplied: DataFrame, by: str) -> DataFrame:
    """(by, name, x, y, z): positions of a montage (name, x, y, z) for channels (by, name, type) of those names. Only channels of
    type EEG or of no type have one, and only where the recording has no positions of its own (`supplied`, by)."""
    eeg = channels.where(F.col("type").isNull() | (F.upper("type") == "EEG")).join(supplied.select(by).distinct(), by, "left_anti")
    places = montage.select(key("name").alias("__key"), "x", "y", "z").dropDuplicates(["__key"])
    return eeg.withColumn("__key", key("name")).join(places, "__key").select(by, "name", "x", "y", "z")


def montage_1020(spark, radius: float = 0.095) -> DataFrame:
    """(name, x, y, z) of the classical 10-20 positions on a sphere, in metres: x right, y ahead, z up. By the system's own rule:
    rows of sites stand every 45 degrees from nasion to inion, the outer ring 72 degrees or more off the vertex."""
    ring = {"Fpz": 0, "Fp2": 18, "F8": 54, "T8": 90, "P8": 126, "O2": 162, "Oz": 180, "O1": 198, "P7": 234, "T7": 270, "F7": 306, "Fp1": 342}
    inner = {"Cz": (0, 0), "Fz": (36, 0), "C4": (36, 90), "Pz": (36, 180), "C3": (36, 270), "F4": (48.5, 39), "P4": (48.5, 141), "P3": (48.5, 219), "F3": (48.5, 321)}
    sites = [(n, 72.0, float(a)) for n, a in ring.items()] + [(n, float(t), float(a)) for n, (t, a) in inner.items()]
    made = spark.createDataFrame(sites, "name string, theta double, azimuth double")
    t, a = F.radians("theta"), F.radians("azimuth")
    return made.select("name", (radius * F.sin(t) * F.sin(a)).alias("x"), (radius * F.sin(t) * F.cos(a)).alias("y"), (radius * F.cos(t)).alias("z"))


def by_frame(points: DataFrame, table: str, own: str, named: str) -> DataFrame:
    """(table, frame, n, names): the points of a table by coordinate frame: the point's own, else that of the table's name, else
    none. A table holds the sensors of one head."""
    frame = F.coalesce(F.when(F.col(own) != "", F.col(own)), F.col(named), F.lit(""))
    return points.groupBy(table, frame.alias("frame")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def attached(recordings: DataFrame, sets: DataFrame, errors: DataFrame, by: str) -> DataFrame:
    """Recordings with their coordinate sets: `supplied` where tables were found or tried, `n_sets`, `source` of the first set by
    ordinal, `error`. An error leaves no sets, and no template takes their place."""
    found = sets.groupBy(by).agg(F.count("*").alias("n"), F.min_by("source", "ordinal").alias("first"))
    wrong = errors.groupBy(by).agg(F.min("message").alias("error"))
    both = recordings.join(found, by, "left").join(wrong, by, "left")
    ok = F.col("error").isNull()
    return both.select(*recordings.columns, (F.col("n").isNotNull() | ~ok).alias("supplied"), F.when(ok, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_sets"), F.when(ok, F.col("first")).alias("source"), "error")


def fitted(points: DataFrame, by: str, width: float, height: float, margin: float) -> DataFrame:
    """points (by, px, py, ...) with their places (u, v) in a picture: each group as large as fits within the margin, centred, up
    being up. A group without extent in one direction has no scale and is left out."""
    box = points.groupBy(by).agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")).where("x1 > x0 AND y1 > y0")
    scaled = box.withColumn("s", F.least((width - 2 * margin) / (F.col("x1") - F.col("x0")), (height - 2 * margin) / (F.col("y1") - F.col("y0"))))
    u = width / 2 + (F.col("px") - (F.col("x0") + F.col("x1")) / 2) * F.col("s")
    v = height / 2 - (F.col("py") - (F.col("y0") + F.col("y1")) / 2) * F.col("s")
    return points.join(scaled, by).withColumns({"u": u, "v": v}).drop("x0", "x1", "y0", "y1", "s")
