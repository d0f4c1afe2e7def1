"""Blocks of range-coded differences, many at a time.

A block holds 32-bit samples as differences of a byte each, with a mark and the sample itself where a difference is larger; the
bytes are range-coded by their counts, which the header carries, and the block has a checksum. Decoding is a loop over the
bytes of a block, but blocks don't depend on one another: the blocks of a batch are decoded in step, one row of NumPy arrays
a block, so that each step of the loop serves all of them. Checksums run the same way.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.functions.checksums import crcs_koopman

#: The header: checksum of all that follows it, flags, trend, scale, bytes of differences, samples, bytes of the block, start; then
#: how often each byte stands in the differences. Flags mark a gap before the block, and encryption. Fixed values of the format.
_HEAD = struct.Struct("<IB11xfffIIIq")
HEADER, COUNTS, GAP, ENCRYPTED, PAD = 304, 48, 1, 6, 0x7E
#: Bits of the coder's state, and the range at which it takes in the next byte. The mark before a whole sample.
BITS, LEAST, WHOLE = 31, 1 << 23, -128
#: Blocks decoded in step.
TOGETHER = 256


def _rounded(x: np.ndarray) -> np.ndarray:
    """Halves away from zero."""
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


def differences(samples: np.ndarray) -> np.ndarray:
    """Samples as bytes: the first whole, then differences, or a mark and the sample."""
    x = np.asarray(samples, np.int64)
    step = np.diff(x)
    large = np.append(True, np.abs(step) > 127)
    size = np.where(large, 5, 1)
    at = np.cumsum(size) - size
    out = np.zeros(size.sum(), np.uint8)
    out[at] = np.where(large, WHOLE & 0xFF, np.append(0, step) & 0xFF)
    whole = x[large].astype("<i4").view(np.uint8).reshape(-1, 4)
    out[at[large][:, None] + np.arange(1, 5)] = whole
    return out[1:]  # the first mark goes without saying


def encode(samples: np.ndarray, start: int = 0, scale: float = 1.0, gap: bool = False) -> bytes:
    """A block of samples; with a scale, of these in units of it."""
    flags = GAP if gap else 0
    if not len(samples):
        body, counts, n = b"", np.zeros(256, np.uint8), 0
    else:
        data = differences(_rounded(np.asarray(samples) / scale) if scale > 1 else samples)
        counts = np.bincount(data, minlength=256)
        if counts.max() > 255:
            counts = np.where(counts > 0, np.ceil(counts * (254.999999999 / counts.max())), 0).astype(np.int64)
        body, n = _range_coded(data, counts), len(data) + 1
    size = HEADER + len(body) + (-(HEADER + len(body)) % 8)
    rest = _HEAD.pack(0, flags, 0.0, 0.0, scale if n else 0.0, n, len(samples), size, start)[4:] + counts.astype(np.uint8).tobytes() + body
    rest = rest.ljust(size - 4, bytes([PAD])) if n else rest
    return struct.pack("<I", int(crcs_koopman([rest])[0])) + rest


def _range_coded(data: np.ndarray, counts: np.ndarray) -> bytes:
    """Each byte narrows an interval to its share; bytes that the interval has settled go out, and a carry runs back through them."""
    below = np.concatenate([[0], np.cumsum(counts)]).tolist()
    low, span, total, out = 0, 1 << BITS, below[-1], bytearray(1)

    def settle() -> None:
        nonlocal low, span
        while span <= LEAST:
            carry(low >> BITS)
            low &= (1 << BITS) - 1
            out.append(low >> BITS - 8)
            low = low << 8 & (1 << BITS) - 1
            span <<= 8

    def carry(one: int) -> None:
        at = len(out) - 1
        while one:
            one, out[at] = divmod(out[at] + 1, 256)
            at -= 1

    for byte in data.tolist():
        settle()
        share = span // total
        low += share * below[byte]
        span = share * (below[byte + 1] - below[byte]) if byte < 255 else span - share * below[byte]
    settle()
    last = (low >> BITS - 8) + 1  # above low, whatever follows
    carry(last >> 8)
    return bytes(out[1:]) + bytes([last & 255, 0])  # the first byte only took a carry that can't come


def decode(blocks: list[bytes]) -> list[np.ndarray | str]:
    """The samples of each block, or what is wrong with it."""
    out: list[np.ndarray | str] = [""] * len(blocks)
    heads = []
    for i, raw in enumerate(blocks):
        if raw is None or len(raw) < HEADER:
            out[i] = "cut off"
            continue
        crc, flags, slope, base, scale, n, samples, size, _ = _HEAD.unpack_from(raw)
        total = int(np.frombuffer(raw, np.uint8, 256, COUNTS).sum())
        if flags & ENCRYPTED:
            out[i] = "encrypted"
        elif size < HEADER or size > len(raw):
            out[i] = "cut off"
        else:
            heads.append((i, crc, slope, base, scale, n, samples, size, total))
    sums = crcs_koopman([blocks[h[0]][4 : h[7]] for h in heads])
    good = []
    for h, found in zip(heads, sums.tolist(), strict=True):
        if h[1] != found:
            out[h[0]] = "checksum"
        elif not h[6]:
            out[h[0]] = np.zeros(0, np.int64)
        elif not h[8] or h[7] == HEADER:
            out[h[0]] = "no counts" if not h[8] else "no samples"
        else:
            good.append(h)
    good.sort(key=lambda h: h[5])
    for first in range(0, len(good), TOGETHER):
        part = good[first : first + TOGETHER]
        for h, data in zip(part, _in_step([blocks[h[0]][: h[7]] for h in part], [h[5] for h in part]), strict=True):
            out[h[0]] = _samples(data, h[6], *h[2:5])
    return out


def _in_step(blocks: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The bytes of differences of each block."""
    n, most, long = len(blocks), max(sizes), max(map(len, blocks)) - HEADER + 5
    raw = np.zeros((n, max(long, max(sizes) + 5)), np.int64)
    counts = np.stack([np.frombuffer(b, np.uint8, 256, COUNTS) for b in blocks]).astype(np.int64)
    for i, b in enumerate(blocks):
        raw[i, : len(b) - HEADER] = np.frombuffer(b, np.uint8, -1, HEADER)
    # the state is 31 bits of the stream, so what it takes in begins a bit before a byte
    stream = (raw[:, :-1] & 1) << 7 | raw[:, 1:] >> 1
    low = (raw[:, 0] << 24 | raw[:, 1] << 16 | raw[:, 2] << 8 | raw[:, 3]) >> 1
    below = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(counts, 1)], 1)
    total, span = below[:, -1], np.full(n, 1 << BITS)
    at, rows, out = np.full(n, 3), np.arange(n), np.zeros((n, most), np.uint8)
    for k in range(most):
        while (small := span <= LEAST).any():
            taken = stream[rows, np.minimum(at, stream.shape[1] - 1)]
            low, span, at = np.where(small, low << 8 | taken, low), np.where(small, span << 8, span), at + small
        share = span // total
        place = np.minimum(low // share, total - 1)
        byte = (below[:, 1:] <= place[:, None]).sum(1)
        low -= share * below[rows, byte]
        span = np.where(byte < 255, share * counts[rows, byte], span - share * below[rows, byte])
        span = np.maximum(span, 1)
        out[:, k] = byte
    return [out[i, :size] for i, size in enumerate(sizes)]


def _samples(data: np.ndarray, n: int, slope: float, base: float, scale: float) -> np.ndarray | str:
    """Differences summed up, anew from each whole sample."""
    data = np.concatenate([[WHOLE & 0xFF], data]).astype(np.uint8)
    starts, free = [], 0
    for mark in np.flatnonzero(data == (WHOLE & 0xFF)).tolist():
        if mark >= free:  # not within a whole sample
            starts.append(mark)
            free = mark + 5
    value = data.view(np.int8).astype(np.int64)
    keep = np.ones(len(data), bool)
    restart = np.zeros(len(data), bool)
    for mark in starts:
        if mark + 5 > len(data):
            keep[mark:] = False
            break
        value[mark] = int.from_bytes(data[mark + 1 : mark + 5].tobytes(), "little", signed=True)
        keep[mark + 1 : mark + 5], restart[mark] = False, True
    value, restart = value[keep], restart[keep]
    if len(value) < n:
        return "too few differences"
    value, restart = value[:n], restart[:n]
    total = np.cumsum(value)
    first = np.flatnonzero(restart)
    x = total - np.repeat((total - value)[first], np.diff(np.append(first, n)))
    if scale > 1:
        x = _rounded(x * np.float64(scale))
    if slope or base:
        x = _rounded(x + np.float64(slope) * np.arange(1, n + 1) + base)
    return x


def decoded(blocks: DataFrame, name: str, data: str) -> DataFrame:
    """(name, sample_idx, value, error) of a table of blocks: a row for each sample; of a block that can't be read one row that says why."""
    kind = blocks.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(first, TOGETHER)
                found = decode(part.column(1).to_pylist())
                size = [1 if isinstance(x, str) else len(x) for x in found]
                names = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), size)))
                idx = np.concatenate([np.arange(s) for s in size]) if size else np.zeros(0, np.int64)
                bad = np.repeat([isinstance(x, str) for x in found], size).astype(bool)
                values = np.concatenate([np.zeros(1, np.int64) if isinstance(x, str) else x for x in found]) if found else np.zeros(0, np.int64)
                errors = pa.array([x if isinstance(x, str) else None for x in found], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), size)))
                yield pa.RecordBatch.from_arrays([names, pa.array(idx, pa.int64(), mask=bad), pa.array(values, pa.int64(), mask=bad), errors], [name, "sample_idx", "value", "error"])

    return blocks.select(name, data).mapInArrow(run, f"`{name}` {kind}, sample_idx long, value long, error string")
