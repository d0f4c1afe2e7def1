"""Recordings as Spark data sources.

    spark.dataSource.register(RecordingSource)
    spark.read.format("recording").option("start", 0).option("n", 1000).load("/data/*.edf")
    spark.readStream.format("recording").load("/data/*.edf")
    read(spark.createDataFrame([(path,), ...], "path string"), start=0, n=1000)

Each file is planned as blocks of samples; a block that the wanted range doesn't touch is never planned, and a block
reads no more bytes than its samples. The range and channels are options, not pushed filters: filters pushed to Python
sources proved unreliable in this Spark version. The source opens each header on the driver, to plan; :func:`read` opens
them in tasks, for any number of files, and leaves out those that can't be read.
"""

from __future__ import annotations

import os
import pickle
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from tracelake.sources import encoders, formats
from tracelake.sources.layout import Layout, matching, size_local, window

#: Bytes that one task reads, headers that are opened at once, files of one task at most, and tasks that a few files are dealt to.
BLOCK_BYTES, OPEN_AT_ONCE, FILES, TASKS = 32 << 20, 16, 64, 32


def _paths(options: dict) -> list[str]:
    """Files of option `paths`, one on a line and taken as they are, or of the path: patterns set apart by commas, or one file."""
    if "paths" in options:
        return [p for p in options["paths"].split("\n") if p]
    whole = options["path"]
    parts = [whole] if matching(whole) else whole.split(",")
    return [p for part in parts for p in (matching(part) or [part])]


@dataclass
class Block(InputPartition):
    """Samples [start, start + n) of a recording, with what its header says of where they are."""

    recording: str
    start: int
    n: int
    layout: Layout | None = None


def _step(layout: Layout, asked: int | None) -> int:
    """Samples of a block: about BLOCK_BYTES, or as many as asked; whole records, as then no byte is read twice."""
    step = asked or max(1, BLOCK_BYTES // max(1, layout.sample_bytes))
    if layout.order == "whole":
        return max(1, layout.n_samples)
    return -(-step // layout.record_samples) * layout.record_samples if layout.order == "records" else step


def _blocks(recording: str, layout: Layout, low: int, high: int, asked: int | None) -> list[Block]:
    step = _step(layout, asked)
    edges = [low, *range((low // step + 1) * step, high, step), high] if low < high else []
    return [Block(recording, a, b - a, layout.part(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


@dataclass
class Several(InputPartition):
    """What one task reads: blocks, or the paths of headers."""

    items: list


def _several(items: list, sizes: list[int]) -> list[InputPartition]:
    """Items in order, dealt to tasks: no more than FILES, nor than BLOCK_BYTES unless it is a single one; few items to TASKS tasks."""
    most, out, held = min(FILES, -(-len(items) // TASKS)), [], 0
    for item, size in zip(items, sizes, strict=True):
        if not out or len(out[-1].items) >= most or held + size > BLOCK_BYTES:
            out.append(Several([]))
            held = 0
        out[-1].items.append(item)
        held += size
    return out


def _dealt(blocks: list[Block]) -> list[InputPartition]:
    return _several(blocks, [b.n * max(1, b.layout.sample_bytes) for b in blocks]) or [Several([])]


#: Rows of a batch.
BATCH_ROWS = 1 << 16


def _samples(block: Block, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(recording, channel_idx, channel, sample_idx, value) of a block, in batches of BATCH_ROWS at most. The header isn't read again."""
    layout = block.layout
    own = [i for i, x in enumerate(layout.labels) if not names or x in names]
    if not own or not block.n:
        return
    if layout.order == "whole":
        x = formats.eeglab_whole(block.recording)[1][own, block.start : block.start + block.n]
    else:
        x = window(layout, block.start, block.n, own)
    for row, c in zip(x, own, strict=True):
        for first in range(0, len(row), BATCH_ROWS):
            part = row[first : first + BATCH_ROWS]
            n, start = len(part), block.start + first
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(block.recording), n), pa.repeat(pa.scalar(c, pa.int32()), n), pa.repeat(pa.scalar(layout.labels[c]), n), pa.array(np.arange(start, start + n)), pa.array(part.astype(np.float32))],
                ["recording", "channel_idx", "channel", "sample_idx", "value"],
            )


class _Samples(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.names = [c for c in options.get("channels", "").split(",") if c]
        self.asked = int(options["blocksamples"]) if "blocksamples" in options else None

    def partitions(self) -> list[InputPartition]:
        start, n = int(self.options.get("start", 0)), int(self.options.get("n", 1 << 62))
        out, paths = [], _paths(self.options)
        with ThreadPoolExecutor(OPEN_AT_ONCE) as pool:  # headers are short reads, each of which waits for its store
            for path, layout in zip(paths, pool.map(formats.open_recording, paths), strict=True):
                out += _blocks(path, layout, max(0, start), min(start + n, layout.n_samples), self.asked)
        return _dealt(out)

    def read(self, partition: Several) -> Iterator[pa.RecordBatch]:
        for block in partition.items:
            yield from _samples(block, self.names)


class _Growing(DataSourceStreamReader):
    """Samples as files grow and as new ones come. The offset says how many samples of each file are done; a recording that can't
    be read yet, because its header isn't complete, waits."""

    def __init__(self, options: dict):
        self.options, self.reader = options, _Samples(options)
        self.seen: dict[str, tuple[int, Layout]] = {}  # of each recording its data file's size, and the layout then

    def _length(self, path: str) -> int | None:
        """Samples of a recording; its header is opened again only if its data file has grown. None if it can't be read."""
        try:
            if path in self.seen and size_local(self.seen[path][1].path) == self.seen[path][0]:
                return self.seen[path][1].n_samples
            layout = formats.open_recording(path)
            self.seen[path] = (size_local(layout.path), layout)
        except (formats.FormatError, OSError, ValueError, KeyError):
            return None
        return layout.n_samples

    def _layout(self, path: str, high: int) -> Layout:
        """A layout that knows of the samples before high."""
        if path in self.seen and self.seen[path][1].n_samples >= high:
            return self.seen[path][1]
        return formats.open_recording(path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        paths = _paths(self.options)
        with ThreadPoolExecutor(OPEN_AT_ONCE) as pool:
            return {path: n for path, n in zip(paths, pool.map(self._length, paths), strict=True) if n is not None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, grown = [], [p for p, high in end.items() if high > start.get(p, 0)]
        with ThreadPoolExecutor(OPEN_AT_ONCE) as pool:
            for path, layout in zip(grown, pool.map(lambda p: self._layout(p, end[p]), grown), strict=True):
                out += _blocks(path, layout, start.get(path, 0), end[path], self.reader.asked)
        return _dealt(out)

    def read(self, partition: Several) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


_SAMPLES = "recording string, channel_idx int, channel string, sample_idx long, value float"


def read(files: DataFrame, start: int = 0, n: int = 1 << 62, channels: list[str] | None = None, block_samples: int | None = None) -> DataFrame:
    """Samples of the recordings whose paths are in column `path`, planned by a first distributed pass over their headers: one
    row for each block goes on, dealt over the tasks of a second pass."""
    names = channels or []

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[Block] = []
            for path in batch.column(0).to_pylist():
                try:
                    layout = formats.open_recording(path)
                except (formats.FormatError, OSError, ValueError, KeyError):
                    continue
                found += _blocks(path, layout, max(0, start), min(start + n, layout.n_samples), block_samples)
            columns = [pa.array([b.recording for b in found], pa.string()), pa.array([b.start for b in found], pa.int64()), pa.array([b.n for b in found], pa.int64()), pa.array([pickle.dumps(b.layout) for b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["recording", "start", "n", "layout"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for recording, first, count, layout in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _samples(Block(recording, first, count, pickle.loads(layout)), names)  # noqa: S301 - made by plan()

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planned = files.select("path").where(F.col("path").isNotNull()).mapInArrow(plan, "recording string, start long, n long, layout binary")
    return planned.repartition(parts, "recording", "start").mapInArrow(load, _SAMPLES)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: the number of samples of each recording, as far as it knows."""

    samples: dict[str, int]


class _Files(DataSourceArrowWriter):
    """Samples (recording, channel, sample_idx, value) as EDF files of a folder, one for each recording.

    A record of EDF has its place in the file from the start, so every task writes what it has where it belongs, in a folder
    beside the files; a task that is run again writes the same bytes. The commit puts the headers in front, now that lengths are
    known, and moves the files to their names; an abort takes the folder away. Samples that nobody writes are 0, to half a step.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/").removeprefix("file://"), overwrite
        self.names = [c for c in options.get("channels", "").split(",") if c]
        if not self.names or "fs" not in options:
            raise ValueError("options channels and fs are needed to write recordings")
        self.fs, self.physical = int(options["fs"]), float(options.get("physical", 1000))
        self.own = f"{self.folder}/_writing-{uuid.uuid4().hex}"
        os.makedirs(self.own, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        per, n, base = self.fs, len(self.names), 256 * (len(self.names) + 1)
        index, samples = {c: i for i, c in enumerate(self.names)}, {}
        for batch in iterator:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            recording, channel = (batch.column(at[c]).dictionary_encode() for c in ("recording", "channel"))
            names, labels = recording.dictionary.to_pylist(), channel.dictionary.to_pylist()
            if any(x not in index for x in labels) or recording.null_count or channel.null_count:
                raise ValueError(f"channels {sorted(set(map(str, labels)) - set(index))} aren't in the option channels, or a name is null")
            idx = batch.column(at["sample_idx"]).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = encoders.edf_numbers(batch.column(at["value"]).to_numpy(zero_copy_only=False), self.physical, 32767).astype("<i2")
            file, place = recording.indices.to_numpy(), np.array([index[x] for x in labels], np.int64)[channel.indices.to_numpy()] if labels else np.zeros(0, np.int64)
            offset = base + 2 * (idx // per * per * n + place * per + idx % per)
            order = np.lexsort((offset, file))
            cut = np.flatnonzero((np.diff(offset[order]) != 2) | (np.diff(file[order]) != 0)) + 1
            for run in np.split(order, cut):
                if len(run):
                    name = names[file[run[0]]]
                    with open(os.open(self._part(name), os.O_RDWR | os.O_CREAT), "r+b") as f:
                        os.pwrite(f.fileno(), raw[run].tobytes(), int(offset[run[0]]))
                    samples[name] = max(samples.get(name, 0), int(idx[run].max()) + 1)
        return Written(samples)

    def _part(self, name: str) -> str:
        if "/" in name or name in ("", ".", ".."):
            raise ValueError(f"{name!r} is no name of a recording")
        return f"{self.own}/{name}.edf"

    def commit(self, messages: list[Written | None]) -> None:
        samples: dict[str, int] = {}
        for m in messages:
            for name, n in (m.samples if m else {}).items():
                samples[name] = max(samples.get(name, 0), n)
        for name, n in samples.items():
            records = -(-n // self.fs)
            with open(self._part(name), "r+b") as f:
                f.write(encoders.edf_header(self.names, [self.fs] * len(self.names), records, 1.0, self.physical, 32767))
                f.truncate(256 * (len(self.names) + 1) + 2 * records * self.fs * len(self.names))
        if self.overwrite:
            for old in matching(f"{self.folder}/*.edf"):
                os.remove(old)
        for name in samples:
            os.replace(self._part(name), f"{self.folder}/{name}.edf")
        shutil.rmtree(self.own, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.own, ignore_errors=True)


class RecordingSource(DataSource):
    """Samples: (recording, channel_idx, channel, sample_idx, value). Options of reading: start, n, channels, blockSamples; of
    writing, to a mounted folder: channels (in order, of all recordings), fs (whole samples a second), physical (largest value)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return _SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return _Samples(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Growing(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Files(dict(self.options), overwrite)


class _Headers(DataSourceReader):
    def __init__(self, options: dict, events: bool):
        self.options, self.events = options, events

    def partitions(self) -> list[InputPartition]:
        paths = _paths(self.options)
        return _several(paths, [0] * len(paths)) or [Several([])]

    def read(self, partition: Several) -> Iterator[tuple]:
        with ThreadPoolExecutor(OPEN_AT_ONCE) as pool:
            for path, x in zip(partition.items, pool.map(self._opened, partition.items), strict=True):
                if not self.events:
                    yield self._row(path, x)
                elif isinstance(x, Layout):
                    yield from ((path, *e) for e in formats.events_of(x))

    @staticmethod
    def _opened(path: str) -> Layout | str:
        try:
            return formats.open_recording(path)
        except (formats.FormatError, OSError, ValueError, KeyError) as e:
            return str(e)

    @staticmethod
    def _row(path: str, x: Layout | str) -> tuple:
        if isinstance(x, str):
            return path, None, None, None, None, None, None, None, None, x
        return path, len(x.labels), x.fs, x.n_samples, x.n_samples / x.fs, x.labels, x.start_iso, x.warnings, x.bad, None


class HeaderSource(DataSource):
    """One row for each recording: what its header says, or why it can't be read. Reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "recording_headers"

    def schema(self) -> str:
        return "recording string, n_channels int, fs double, n_samples long, duration double, labels array<string>, start_iso string, warnings array<string>, bad array<string>, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Headers(dict(self.options), False)


class EventSource(DataSource):
    """Annotations of recordings: (recording, onset, duration, label)."""

    @classmethod
    def name(cls) -> str:
        return "recording_events"

    def schema(self) -> str:
        return "recording string, onset double, duration double, label string"

    def reader(self, schema) -> DataSourceReader:
        return _Headers(dict(self.options), True)


def register(spark) -> None:
    for source in (RecordingSource, HeaderSource, EventSource):
        spark.dataSource.register(source)
