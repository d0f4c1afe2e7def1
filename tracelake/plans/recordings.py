"""Queries for the sources of recordings: files of each format are made from `events`, in tasks, and read back by window.

Events of a type in order of (ts, event_id) are dealt over the channels of recordings, PER of them to each: value number j of a
recording, rounded down, is sample j // CHANNELS of channel j % CHANNELS. Recordings are filled up with zeros to whole seconds.
"""

from __future__ import annotations

import functools
import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import samples as S
from tracelake.operators.shared import fixed, folder
from tracelake.plans.registry import query, table
from tracelake.sources import datasource, encoders
from tracelake.streaming import chunks as C

CHANNELS, PER, SECOND, START, N = 3, 3000, 100, 13, 700
SQL = f"""s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, floor(value)::INT AS v FROM events),
f AS (SELECT event_type || '-' || (k // {PER}) AS recording, k % {PER} AS j, v FROM s),
n AS (SELECT recording, (count(*) + {CHANNELS * SECOND - 1}) // {CHANNELS * SECOND} * {SECOND} AS frames FROM f GROUP BY recording),
g AS (SELECT recording, frames, i, unnest(range({CHANNELS})) AS c FROM (SELECT recording, frames, unnest(range(frames)) AS i FROM n)),
w AS (SELECT g.recording, frames, c, i, coalesce(v, 0) AS v FROM g LEFT JOIN f ON f.recording = g.recording AND j = {CHANNELS} * i + c)"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, j, v): the values of each recording in order."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.floor("value").cast("int").alias("value"))
    s = S.numbered(events, "event_type", ["ts", "event_id"], "value")
    return s.select(F.concat("channel", F.lit("-"), F.floor(F.col("sample_idx") / PER).cast("string")).alias("recording"), (F.col("sample_idx") % PER).alias("j"), F.col("value").alias("v"))


def _notes(x: np.ndarray) -> list[tuple[float, str]]:
    """An annotation in each second, which names the second's first value."""
    return [(r + 0.25, f"v{int(x[0, r * SECOND])}") for r in range(x.shape[1] // SECOND)]


#: Format: file, how it is written, what of a value comes back, and the channels' names.
FORMATS = {
    "edf": ("a.edf", lambda p, x: encoders.edf(p, x, SECOND, annotations=_notes(x), physical=1000), "v", "'EEG' || c"),
    "bdf": ("a.bdf", lambda p, x: encoders.edf(p, x, SECOND, bdf=True, physical=1000), "v", "'EEG' || c"),
    "brainvision": ("a.vhdr", lambda p, x: encoders.brainvision(p, x, SECOND), "v", "'E' || c || ',x'"),
    "brainvision_vectorized": ("a.vhdr", lambda p, x: encoders.brainvision(p, x, SECOND, True), "v", "'E' || c || ',x'"),
    "eeglab_split": ("a.set", lambda p, x: encoders.eeglab(p, x, SECOND, True), "v", "'Ch' || c + 1"),
    "eeglab_inline": ("a.set", lambda p, x: encoders.eeglab(p, x, SECOND, False), "v", "'Ch' || c + 1"),
    "eeglab_packed": ("a.set", lambda p, x: encoders.eeglab(p, x, SECOND, False, True), "v", "'Ch' || c + 1"),
    "fiff": ("a.fif", lambda p, x: encoders.fiff(p, x.astype(int), 100.0, 130), "v", "'MEG000' || c"),
    "fiff_walked": ("a.fif", lambda p, x: encoders.fiff(p, x.astype(int), 100.0, 130, directory=False), "v", "'MEG000' || c"),
    "ctf": ("a.ds", lambda p, x: encoders.ctf(p, x.astype(int), SECOND), "(v - 3) / 2.0", None),
    "kit": ("a.con", lambda p, x: encoders.kit(p, x.astype(int), 1000.0), "v / 4096.0", None),
    "bti": ("c,rfDC", lambda p, x: encoders.bti(p, x, SECOND), "v", None),
    "itab": ("a.raw", lambda p, x: encoders.itab(p, x, 1000.0), "v / 2.0", None),
}


def written(spark: SparkSession, sf_dir: str, kinds: list[str]) -> tuple[str, DataFrame]:
    """A folder with the recordings in each format, as kind/recording/file, and (kind, recording, path) of the files. Each
    recording is written by a task, beside its place, and moved there whole."""
    datasource.register(spark)
    where = folder(spark, "recordings")

    def write(part: pa.Table) -> pa.Table:
        recording = part.column("recording")[0].as_py()
        j, v = part.column("j").to_numpy(), part.column("v").to_numpy()
        x = np.zeros((CHANNELS, -(-len(j) // (CHANNELS * SECOND)) * SECOND))
        x[j % CHANNELS, j // CHANNELS] = v
        paths = []
        for kind in kinds:
            place, own = f"{where}/{kind}/{recording}", f"{where}/.{uuid.uuid4().hex}"
            os.makedirs(own)
            os.makedirs(os.path.dirname(place), exist_ok=True)
            FORMATS[kind][1](os.path.join(own, FORMATS[kind][0]), x)
            try:
                os.rename(own, place)
            except OSError:  # the task has run before
                shutil.rmtree(own)
            paths.append(os.path.join(place, FORMATS[kind][0]))
        return pa.table({"kind": kinds, "recording": [recording] * len(kinds), "path": paths})

    # as many tasks as there are, though a recording's rows are few bytes: the work is in its files
    dealt = values(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "recording")
    return where, fixed(dealt.groupBy("recording").applyInArrow(write, "kind string, recording string, path string"))


def _above(levels: int) -> Column:
    """The name of a folder so many levels above a recording's file. Every sample has its path, and patterns would try it from each of
    its characters."""
    return F.substring_index(F.substring_index("recording", "/", -1 - levels), "/", 1)


def _named(df: DataFrame) -> DataFrame:
    """Recordings by their names instead of their paths."""
    return df.withColumn("recording", _above(1))


def _window(df: DataFrame, named: bool) -> DataFrame:
    """Values to six digits; those of a format with a coarser scale are whole numbers."""
    return _named(df).select("recording", "channel_idx", *(["channel"] if named else []), "sample_idx", F.round("value", 6 if not named else 0).cast("double").alias("value"))


def _register(kind: str) -> None:
    value, name = FORMATS[kind][2:]

    def read(spark, sf_dir):
        where, _ = written(spark, sf_dir, [kind])
        return _window(spark.read.format("recording").option("start", START).option("n", N).option("blockSamples", 270).load(f"{where}/{kind}/*/{FORMATS[kind][0]}"), name is not None)

    read.__name__, read.__doc__ = f"source_{kind}", f"A window of each recording, of format {kind}, read in blocks."
    query(f"WITH {SQL} SELECT recording, c::INT AS channel_idx, {f'{name} AS channel, ' if name else ''}i::BIGINT AS sample_idx, round(({value})::FLOAT, 6)::DOUBLE AS value FROM w WHERE i >= {START} AND i < {START + N}")(read)


for _kind in FORMATS:
    _register(_kind)


@query(f"WITH {SQL} SELECT kind, recording, {CHANNELS}::INT AS n_channels, fs::DOUBLE AS fs, frames::BIGINT AS n_samples, false AS failed FROM n, (VALUES " + ", ".join(f"('{k}', {1000 if k in ('kit', 'itab') else 100})" for k in FORMATS) + ") t(kind, fs) UNION ALL SELECT 'broken', 'broken', NULL, NULL, NULL, true")
def recording_headers(spark, sf_dir):
    """What the headers of recordings of all formats say; one that can't be read tells why."""
    where, paths = written(spark, sf_dir, list(FORMATS))
    os.makedirs(f"{where}/broken/broken")
    with open(f"{where}/broken/broken/a.edf", "wb") as f:
        f.write(b"nothing")
    patterns = [f"{where}/{k}/*/{x[0].replace(',', '?')}" for k, x in FORMATS.items()] + [f"{where}/broken/*/a.edf"]
    heads = spark.read.format("recording_headers").load(",".join(patterns))
    return _named(heads.withColumn("kind", _above(2))).select("kind", "recording", "n_channels", F.round("fs", 3).alias("fs"), "n_samples", F.col("error").isNotNull().alias("failed"))


@query(f"WITH {SQL} SELECT recording, (i // {SECOND} + 0.25)::DOUBLE AS onset, 0::DOUBLE AS duration, 'v' || v AS label FROM w WHERE c = 0 AND i % {SECOND} = 0")
def recording_events(spark, sf_dir):
    """Annotations that lie between the samples of EDF+ recordings."""
    where, _ = written(spark, sf_dir, ["edf"])
    return _named(spark.read.format("recording_events").load(f"{where}/edf/*/a.edf")).select("recording", "onset", "duration", "label")


@query(f"WITH {SQL} SELECT kind, recording, c::INT AS channel_idx, count(*) AS n, sum(v)::DOUBLE AS total FROM w, (VALUES ('edf'), ('fiff'), ('eeglab_split')) t(kind) WHERE i >= 50 AND i < 950 GROUP BY ALL")
def recordings_in_tasks(spark, sf_dir):
    """Recordings of several formats, planned in tasks; one of the paths leads nowhere."""
    _, paths = written(spark, sf_dir, ["edf", "fiff", "eeglab_split"])
    files = paths.unionByName(spark.createDataFrame([("none", "none", "/nowhere/a.edf")], "kind string, recording string, path string"))
    made = datasource.read(files, 50, 900, block_samples=200).withColumnRenamed("recording", "path").join(files, "path")
    return made.groupBy("kind", "recording", "channel_idx").agg(F.count("*").alias("n"), F.sum(F.round("value")).cast("double").alias("total"))


@query(f"WITH {SQL} SELECT recording, c::INT AS channel_idx, i::BIGINT AS sample_idx, v::DOUBLE AS value FROM w")
def written_recordings(spark, sf_dir):
    """Samples written by df.write as recordings, by tasks that each hold some samples of many files, and read back whole."""
    datasource.register(spark)
    where = folder(spark, "recordings")
    v = values(spark, sf_dir).withColumns({"channel": F.concat(F.lit("EEG"), F.col("j") % CHANNELS), "sample_idx": F.floor(F.col("j") / CHANNELS), "channel_idx": (F.col("j") % CHANNELS).cast("int")})
    rows = v.select("recording", "channel_idx", "channel", "sample_idx", F.col("v").cast("float").alias("value"))
    rows.write.format("recording").option("channels", ",".join(f"EEG{c}" for c in range(CHANNELS))).option("fs", SECOND).mode("append").save(where)
    read = spark.read.format("recording").load(f"{where}/*.edf")
    return read.select(F.regexp_extract("recording", "([^/]+)[.]edf$", 1).alias("recording"), "channel_idx", "sample_idx", F.round("value").cast("double").alias("value"))


def _streamed(spark: SparkSession, paths: DataFrame, kind: str) -> DataFrame:
    """The samples of recordings that grow while a stream reads them, which stops and starts again in between. Headers with a file of
    their own are there from the start."""
    paths, where, file = paths.where(F.col("kind") == kind), folder(spark, "streamed"), FORMATS[kind][0]
    headers = (".vhdr", ".set")

    def grow(share: float) -> None:
        def copy(rows) -> None:
            for row in rows:
                own = os.path.dirname(row["path"])
                os.makedirs(f"{where}/{row['recording']}", exist_ok=True)
                for name in sorted(os.listdir(own), reverse=True):  # data before the header that names it
                    with open(os.path.join(own, name), "rb") as f:
                        raw = f.read()
                    with open(f"{where}/{row['recording']}/{name}", "wb") as f:
                        f.write(raw if name.endswith(headers) else raw[: int(len(raw) * share)])

        paths.foreachPartition(copy)

    stream = spark.readStream.format("recording").load(f"{where}/*/{file}")
    for share in (0.66, 1.0):
        grow(share)
        stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return _named(spark.read.parquet(f"{where}/out")).select("recording", "channel_idx", "sample_idx", F.round("value").cast("double").alias("value"))


@query(f"WITH {SQL} SELECT recording, c::INT AS channel_idx, i::BIGINT AS sample_idx, v::DOUBLE AS value FROM w")
def streamed_recording(spark, sf_dir):
    """EDF recordings that grow."""
    return _streamed(spark, written(spark, sf_dir, ["edf"])[1], "edf")


@query(f"WITH {SQL} SELECT kind, recording, c::INT AS channel_idx, i::BIGINT AS sample_idx, v::DOUBLE AS value FROM w, (VALUES ('brainvision'), ('eeglab_split'), ('fiff_walked')) t(kind)")
def streamed_formats(spark, sf_dir):
    """Recordings that grow in a file beside their header, and in buffers without a directory."""
    kinds = ["brainvision", "eeglab_split", "fiff_walked"]
    _, paths = written(spark, sf_dir, kinds)
    made = [_streamed(spark, paths, k).select(F.lit(k).alias("kind"), "recording", "channel_idx", "sample_idx", "value") for k in kinds]
    return functools.reduce(DataFrame.unionByName, made)


@query("""SELECT conv_id AS request, bool_or(last) AS complete, max(n)::BIGINT AS n FROM (SELECT conv_id, turn = max(turn) OVER (PARTITION BY conv_id) AS last, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations)) GROUP BY conv_id""")
def streamed_assembly(spark, sf_dir):
    """Windows that arrive in chunks, put together by a stream with state: of each the last that was emitted."""
    where = folder(spark)
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    last = c.groupBy("conv_id").agg(F.max("turn").alias("m"), F.min("turn").alias("first"))
    made = c.join(last, "conv_id").select(F.col("conv_id").alias("request"), F.lit(1).alias("epoch"), (F.col("turn") - F.col("first")).cast("int").alias("chunk_seq"), (F.col("turn") == F.col("m")).alias("last"), F.array(F.col("turn").cast("double")).alias("values"))
    for k in (0, 1):
        made.where(F.col("chunk_seq") % 2 == k).write.mode("append").parquet(f"{where}/in")
        stream = C.assembled_stream(spark.readStream.schema(made.schema).parquet(f"{where}/in"))
        stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{where}/out")
    return out.groupBy("request").agg(F.max_by("complete", F.struct(F.size("values"), "complete")).alias("complete"), F.max(F.size("values")).cast("long").alias("n"))
