"""Arrays stored as chunks of rows, as hierarchical containers keep them: a table of chunks, and windows cut out of them.

A table of chunks has (array, row, rows, bytes): the chunk's first row, how many rows a whole chunk has, and its bytes as they
are stored. A window joins the chunks that it overlaps; each chunk is decoded by itself, so a window's work is dealt over tasks.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import folds
from tracelake.operators.shared import fixed

#: Filters that chunks pass through, by their number. Fixed values.
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3


def fletcher32(data: bytes) -> int:
    """The checksum of 16-bit little-endian words, an odd last byte by itself; the second sum in the low half."""
    words = np.frombuffer(data[: len(data) // 2 * 2], "<u2").astype(np.uint64)
    if len(data) % 2:
        words = np.append(words, np.uint64(data[-1]))
    first = int(words.sum()) % 65535
    second = int((words * np.arange(len(words), 0, -1, dtype=np.uint64)).sum()) % 65535
    return first << 16 | second


def unfiltered(raw: bytes, filters: list[int], width: int) -> bytes:
    """A chunk's bytes with its filters undone, the last applied first."""
    for f in reversed(filters):
        if f == DEFLATE:
            raw = zlib.decompress(raw)
        elif f == SHUFFLE:
            n = len(raw) // width
            raw = np.frombuffer(raw[: n * width], np.uint8).reshape(width, n).T.tobytes() + raw[n * width :]
        elif f == FLETCHER:
            raw, sums = raw[:-4], int.from_bytes(raw[-4:], "big")
            if fletcher32(raw) != sums:
                raise ValueError("a chunk's checksum doesn't hold")
        else:
            raise ValueError(f"filter {f} isn't known")
    return raw


def filtered(raw: bytes, filters: list[int], width: int) -> bytes:
    """The reverse of :func:`unfiltered`."""
    for f in filters:
        if f == DEFLATE:
            raw = zlib.compress(raw)
        elif f == SHUFFLE:
            n = len(raw) // width
            raw = np.frombuffer(raw[: n * width], np.uint8).reshape(n, width).T.tobytes() + raw[n * width :]
        else:
            raw += fletcher32(raw).to_bytes(4, "big")
    return raw


def overlapping(chunks: DataFrame, windows: DataFrame, array: str = "array", run: int = 1 << 20) -> DataFrame:
    """Each window (array, window, start, stop) with the chunks of its array that it overlaps. Windows and chunks meet under the runs
    of rows that they touch, so the join is on equal keys."""
    runs = lambda a, b: F.explode(F.sequence(F.floor(a / run), F.floor((b - 1) / run)))
    own = chunks.where("rows > 0").withColumn("__run", runs(F.col("row"), F.col("row") + F.col("rows")))
    asked = windows.where("start < stop").withColumn("__run", runs(F.col("start"), F.col("stop")))
    pairs = asked.join(own, [array, "__run"]).where((F.col("row") + F.col("rows") > F.col("start")) & (F.col("row") < F.col("stop")))
    return pairs.where(F.floor(F.greatest("start", "row") / run) == F.col("__run")).drop("__run")


def values(pairs: DataFrame, dtype: str, columns: int, filters: list[int], scale: float = 1.0, offset: float = 0.0, keep: tuple[str, ...] = ("window",)) -> DataFrame:
    """(*keep, row, column, value) of the parts of the chunks that lie in their windows; pairs as :func:`overlapping` gives them,
    with `bytes`. Bytes beyond the end of an array, with which a last chunk is filled, are the window's bounds to leave out."""
    kind, n = np.dtype(dtype), len(keep)
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (start, stop, row, raw) in enumerate(zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True)):
                x = np.frombuffer(unfiltered(raw, filters, kind.itemsize), kind).reshape(-1, columns)
                low, high = max(start, row), min(stop, row + len(x))
                part = x[low - row : high - row].astype(np.float64) * scale + offset
                named = [pa.repeat(c[i], part.size) for c in batch.columns[:n]]
                yield pa.RecordBatch.from_arrays([*named, pa.array(np.repeat(np.arange(low, high), columns)), pa.array(np.tile(np.arange(columns, dtype=np.int32), len(part))), pa.array(part.ravel())], [*keep, "row", "column", "value"])

    bounds = [F.col(c).cast("long") for c in ("start", "stop", "row")]
    return pairs.select(*keep, *bounds, "bytes").mapInArrow(run, f"{kinds}, row long, column int, value double")


# The index of an array's chunks: a tree of nodes ---------------------------------------------------------------------

#: A node begins with its mark, kind and level, the number of entries, and its siblings; an entry's key holds the chunk's bytes, the
#: filters it skips, its first row, first column and element; keys and the addresses of what they lead to take turns, and a last
#: key bounds the node. Fixed values of the format.
_NODE, _KEY, _CHILD, _NOWHERE = struct.Struct("<4sBBHQQ"), struct.Struct("<IIQQQ"), struct.Struct("<Q"), (1 << 64) - 1
MARK, CHUNKS = b"TREE", 1


def node(level: int, entries: list[tuple[int, int, int]], upto: int) -> bytes:
    """The bytes of a node: entries are (row, bytes, address) in order; upto is the row at which the last one ends."""
    out = [_NODE.pack(MARK, CHUNKS, level, len(entries), _NOWHERE, _NOWHERE)]
    for row, size, address in entries:
        out += [_KEY.pack(size, 0, row, 0, 0), _CHILD.pack(address)]
    return b"".join([*out, _KEY.pack(0, 0, upto, 0, 0)])


def entries_of(raw: bytes) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(level, [(row, upto, bytes, address)]) of a node: each entry with the row at which the next one begins."""
    if len(raw) < _NODE.size or raw[:4] != MARK or raw[4] != CHUNKS:
        raise ValueError("no node of an index of chunks")
    _, _, level, n, _, _ = _NODE.unpack_from(raw)
    step = _KEY.size + _CHILD.size
    if len(raw) < _NODE.size + n * step + _KEY.size:
        raise ValueError("a node of an index of chunks is cut off")
    keys = [_KEY.unpack_from(raw, _NODE.size + i * step) for i in range(n + 1)]
    return level, [(keys[i][2], keys[i + 1][2], keys[i][0], _CHILD.unpack_from(raw, _NODE.size + i * step + _KEY.size)[0]) for i in range(n)]


def indexed(chunks: DataFrame, fanout: int = 64) -> tuple[DataFrame, DataFrame]:
    """The index of chunks (array, row, rows, bytes, address): its nodes (array, address, bytes), and (array, address) of the roots.

    A level's nodes are made from the entries of the one below, each by a task's group of `fanout` of them, until each array has one."""
    kind = chunks.schema["array"].dataType.simpleString()
    entries = folds.numbered(chunks.select("array", "row", (F.col("row") + F.col("rows")).alias("upto"), F.length("bytes").cast("long").alias("size"), "address"), "array", ["row"], "k")
    level, made = 0, []

    def packer(level: int) -> Callable[[pa.Table], pa.Table]:
        def pack(part: pa.Table) -> pa.Table:
            part = part.sort_by("k")
            own = list(zip(*(part.column(c).to_pylist() for c in ("row", "size", "address")), strict=True))
            n, upto = part.column("n")[0].as_py(), part.column("upto")[-1].as_py()
            return pa.Table.from_arrays([part.column("array").slice(0, 1).combine_chunks(), pa.array([n]), pa.array([(level + 1 << 48) + n]), pa.array([own[0][0]]), pa.array([upto]), pa.array([node(level, own, upto)])], ["array", "k", "address", "row", "upto", "bytes"])

        return pack

    while True:
        nodes = entries.withColumn("n", F.floor(F.col("k") / fanout).cast("long")).groupBy("array", "n")
        made.append(fixed(nodes.applyInArrow(packer(level), f"array {kind}, k long, address long, row long, upto long, bytes binary")))
        if not made[-1].where("k > 0").limit(1).count():
            break
        entries = made[-1].select("array", "k", "row", "upto", F.length("bytes").cast("long").alias("size"), "address")
        level += 1
    tops = made[-1].select("array", "address")
    nodes = functools.reduce(DataFrame.unionByName, [m.select("array", "address", "bytes") for m in made])
    return nodes, tops


def walked(windows: DataFrame, nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[int]]:
    """(array, window, start, stop, row, rows, address) of the chunks that windows (array, window, start, stop) overlap, and how
    many nodes each round has read.

    All windows go down together: a round joins the frontier with the nodes that it names, and keeps the entries that the windows
    overlap; no other node is read. There are as many rounds as the tree has levels."""
    kinds = ", ".join(f"{c} {windows.schema[c].dataType.simpleString() if c in ('array', 'window') else 'long'}" for c in ("array", "window", "start", "stop"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (start, stop, raw) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                level, entries = entries_of(raw)
                for row, upto, _, address in entries:
                    if row < stop and upto > start:
                        at.append(i)
                        out.append((level, row, upto - row, address))
            own = pa.RecordBatch.from_arrays(batch.columns[:4], batch.schema.names[:4]).take(pa.array(at, pa.int32()))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, pa.int64()) for c in columns)], ["array", "window", "start", "stop", "level", "row", "rows", "address"])

    frontier = windows.where("start < stop").select("array", "window", F.col("start").cast("long"), F.col("stop").cast("long")).join(roots, "array")
    found, read = [], []
    while True:
        met = frontier.join(nodes, ["array", "address"]).select("array", "window", "start", "stop", "bytes")
        step = fixed(met.mapInArrow(expand, f"{kinds}, level long, row long, rows long, address long"))
        read.append(frontier.select("array", "address").distinct().count())
        found.append(step.where("level = 0").drop("level"))
        frontier = step.where("level > 0").select("array", "window", "start", "stop", "address")
        if not frontier.limit(1).count():
            return functools.reduce(DataFrame.unionByName, found), read
