"""A recording file as a layout: where its samples lie and how they become numbers. Formats differ in their headers only;
one reader serves every layout, and touches no more bytes than a window needs."""

from __future__ import annotations

import fnmatch
import glob
import os
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

Fetch = Callable[[str, int, int], bytes]


class FormatError(ValueError):
    """A file that can't be read, with the reason."""


@dataclass
class Layout:
    path: str
    fs: float
    n_samples: int
    labels: list[str]
    dtype: str  # a NumPy type, or `i3` for 24-bit little-endian
    base: int = 0  # byte of the first sample
    # interleaved; `channels`: one run for each channel; `records`: stripes within records; `blocks`: interleaved, in blocks, zero
    # between them; `whole`: packed, to be decoded as a whole
    order: str = "interleaved"
    scale: np.ndarray | float = 1.0
    offset: np.ndarray | float = 0.0  # value = raw * scale + offset
    types: list[str] = field(default_factory=list)
    start_iso: str | None = None
    events: list[tuple[float, float, str]] = field(default_factory=list)  # onset, duration, label
    warnings: list[str] = field(default_factory=list)
    bad: list[str] = field(default_factory=list)  # channels that the recording itself marks as bad
    notes: list[tuple[int, int]] = field(default_factory=list)  # byte in a record and size of each run of annotations
    record_bytes: int = 0
    record_samples: int = 0
    stripes: list[int] = field(default_factory=list)  # byte of each channel's stripe in a record
    blocks: list[tuple[int, int, int]] = field(default_factory=list)  # order `blocks`: first sample, samples, byte

    @property
    def width(self) -> int:
        return 3 if self.dtype == "i3" else np.dtype(self.dtype).itemsize

    @property
    def sample_bytes(self) -> int:
        return self.width * len(self.labels)


    def part(self, low: int, high: int) -> Layout:
        """The layout with what samples [low, high) need of it: long recordings have as many blocks."""
        if self.order != "blocks":
            return replace(self, events=[])
        first = max(0, bisect_right(self.blocks, (low, 1 << 62, 0)) - 1)
        return replace(self, events=[], blocks=self.blocks[first : bisect_left(self.blocks, (high,))])


def _store(path: str):
    """The file system and path of an address with a scheme, such as hdfs:// or s3://."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def fetch_local(path: str, start: int, size: int) -> bytes:
    """Bytes of a file: a mounted one, or one in a store that Arrow knows by its address."""
    if "://" in path:
        store, at = _store(path)
        with store.open_input_file(at) as f:
            f.seek(start)
            return f.read(size)
    with open(path, "rb") as f:
        f.seek(start)
        return f.read(size)


def size_local(path: str) -> int:
    if "://" in path:
        store, at = _store(path)
        return store.get_file_info(at).size
    return os.path.getsize(path)


def exists(path: str) -> bool:
    """Whether there is such a file, mounted or in a store."""
    if "://" in path:
        from pyarrow import fs

        store, at = _store(path)
        return store.get_file_info(at).type == fs.FileType.File
    return os.path.isfile(path)


def listed(folder: str) -> list[str]:
    """Names in a folder, mounted or in a store, in order."""
    if "://" in folder:
        from pyarrow import fs

        store, at = _store(folder)
        return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)))
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def matching(pattern: str) -> list[str]:
    """Files that a pattern of names means, in order; of a store, patterns may stand in any part after the address."""
    if "://" not in pattern:
        return sorted(glob.glob(pattern))
    scheme, rest = pattern.split("://", 1)
    root, *parts = rest.split("/")
    found = [f"{scheme}://{root}"]
    for part in parts:
        if any(c in part for c in "*?["):
            found = [f"{f}/{name}" for f in found for name in listed(f) if fnmatch.fnmatchcase(name, part)]
        else:
            found = [f"{f}/{part}" for f in found]
    return found if found != [pattern] else []


def clamp(start: int, n: int, n_samples: int) -> tuple[int, int]:
    """[start, start + n) within the recording; an empty window is (0, 0)."""
    low, high = max(0, start), min(start + n, n_samples)
    return (low, high) if low < high else (0, 0)


def numbers(raw: bytes, dtype: str) -> np.ndarray:
    if dtype != "i3":
        return np.frombuffer(raw, dtype)
    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    value = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return value - ((value & 0x800000) << 1)


#: Ranges that lie no further apart than this many bytes are read at once, up to so many bytes together.
NEAR, MOST = 64 << 10, 32 << 20


def fetch_ranges(path: str, ranges: list[tuple[int, int]], fetch: Fetch = fetch_local) -> list[bytes]:
    """The bytes of each range (byte, size) of a file, in order; near ones are read together."""
    out: list[bytes] = [b""] * len(ranges)
    order = sorted(range(len(ranges)), key=lambda i: ranges[i])
    first = 0
    while first < len(order):
        start, end = ranges[order[first]][0], sum(ranges[order[first]])
        last = first + 1
        while last < len(order) and ranges[order[last]][0] - end <= NEAR and max(end, sum(ranges[order[last]])) - start <= MOST:
            end = max(end, sum(ranges[order[last]]))
            last += 1
        raw = fetch(path, start, end - start)
        for i in order[first:last]:
            at = ranges[i][0] - start
            out[i] = raw[at : at + ranges[i][1]]
        first = last
    return out


def window(layout: Layout, start: int, n: int, channels: list[int] | None = None, fetch: Fetch = fetch_local) -> np.ndarray:
    """Samples [start, start + n) of the channels, as float32, one row for each channel."""
    low, high = clamp(start, n, layout.n_samples)
    count, own, w = len(layout.labels), channels if channels is not None else list(range(len(layout.labels))), layout.width
    if low == high:
        return np.zeros((len(own), 0), np.float32)
    if layout.order == "interleaved":
        raw = fetch(layout.path, layout.base + low * count * w, (high - low) * count * w)
        x = numbers(raw, layout.dtype).reshape(-1, count).T[own]
    elif layout.order == "channels":
        ranges = [(layout.base + (c * layout.n_samples + low) * w, (high - low) * w) for c in own]
        x = np.stack([numbers(raw, layout.dtype) for raw in fetch_ranges(layout.path, ranges, fetch)])
    elif layout.order == "blocks":
        x = np.zeros((high - low, count), layout.dtype)
        parts = []
        for first, size, at in layout.blocks[max(0, bisect_right(layout.blocks, (low, 1 << 62, 0)) - 1) :]:
            a, b = max(low, first), min(high, first + size)
            if first >= high:
                break
            if a < b:
                parts.append((a, b, (at + (a - first) * count * w, (b - a) * count * w)))
        for (a, b, _), raw in zip(parts, fetch_ranges(layout.path, [p[2] for p in parts], fetch), strict=True):
            x[a - low : b - low] = numbers(raw, layout.dtype).reshape(-1, count)
        x = x.T[own]
    else:
        per = layout.record_samples
        first, last = low // per, -(-high // per)
        raw = fetch(layout.path, layout.base + first * layout.record_bytes, (last - first) * layout.record_bytes)
        records = np.frombuffer(raw, np.uint8).reshape(last - first, layout.record_bytes)
        x = np.stack([numbers(records[:, layout.stripes[c] : layout.stripes[c] + per * w].tobytes(), layout.dtype) for c in own])
        x = x[:, low - first * per : high - first * per]
    pick = lambda v: v if np.isscalar(v) else np.asarray(v)[own][:, None]
    return (x.astype(np.float64) * pick(layout.scale) + pick(layout.offset)).astype(np.float32)
