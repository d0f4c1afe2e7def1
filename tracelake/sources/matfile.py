"""MAT files of version 5: numbers, characters, structures and compressed elements."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Data types by code. Fixed values of the format.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, OBJECT, CHARS, SPARSE = 1, 2, 3, 4, 5


@dataclass
class Place:
    """Where the numbers of a top-level matrix lie in the file; dtype is empty if they are compressed or no numbers."""

    dims: tuple[int, ...]
    dtype: str
    offset: int
    count: int


def elements(raw: bytes, at: int, end: int, order: str) -> Iterator[tuple[int, int, int]]:
    """(type, start, size) of the elements in a stretch of bytes; a last one that is cut off is shortened."""
    while at + 8 <= end:
        kind, size = struct.unpack(order + "2I", raw[at : at + 8])
        if kind >> 16:  # small element: type and size share a word
            yield kind & 0xFFFF, at + 4, kind >> 16
            at += 8
            continue
        yield kind, at + 8, min(size, end - at - 8)
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def _numbers(raw: bytes, kind: int, start: int, size: int, order: str) -> np.ndarray | str | None:
    if kind in TYPES:
        dtype = np.dtype(order + TYPES[kind])
        return np.frombuffer(raw, dtype, size // dtype.itemsize, start)
    if kind in TEXTS:
        name = TEXTS[kind] + ("" if kind == 16 else "-le" if order == "<" else "-be")
        return raw[start : start + size].decode(name, "replace")
    return None


def _matrix(raw: bytes, start: int, end: int, order: str) -> tuple[str, object, tuple[int, ...], tuple[int, int, int] | None]:
    """(name, value, dims, element of the real part). Values of classes that aren't read are None."""
    parts = list(elements(raw, start, end, order))
    flags = struct.unpack(order + "I", raw[parts[0][1] : parts[0][1] + 4])[0]
    kind = flags & 0xFF
    dims = tuple(int(x) for x in _numbers(raw, *parts[1], order))
    name = raw[parts[2][1] : parts[2][1] + parts[2][2]].decode("latin-1").rstrip("\0")
    if kind == STRUCT:
        width = int(_numbers(raw, *parts[3], order)[0])
        names = raw[parts[4][1] : parts[4][1] + parts[4][2]]
        keys = [names[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(names), width)] if width else []
        values = [_matrix(raw, s, s + n, order)[1] if n else None for k, s, n in parts[5:] if k == MATRIX]
        if int(np.prod(dims)) == 1:
            return name, dict(zip(keys, values, strict=False)), dims, None
        return name, {k: values[i :: len(keys)] for i, k in enumerate(keys)}, dims, None  # a structure array, by field
    if kind in (CELL, OBJECT, SPARSE) or flags & 0x800 or len(parts) < 4:
        return name, None, dims, None
    value = _numbers(raw, *parts[3], order)
    if kind == CHARS:
        text = value if isinstance(value, str) else "".join(map(chr, value)) if value is not None else ""
        return name, text if dims[0] <= 1 else ["".join(text[i :: dims[0]]).rstrip() for i in range(dims[0])], dims, None
    if isinstance(value, np.ndarray) and value.size == int(np.prod(dims)):
        value = value.reshape(dims, order="F")
    return name, value, dims, parts[3]


def _order(raw: bytes) -> str:
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of version 5" + (" but of version 7.3" if b"MATLAB 7.3" in raw[:128] else ""))
    return "<" if raw[126:128] == b"IM" else ">"


def parse(raw: bytes) -> dict[str, object]:
    """Variables by name: arrays, texts, and dictionaries for structures."""
    order, out = _order(raw), {}
    for kind, start, size in elements(raw, 128, len(raw), order):
        if kind == COMPRESSED:
            plain = zlib.decompressobj().decompress(raw[start : start + size])
            found = [(plain, k, s, n) for k, s, n in elements(plain, 0, len(plain), order)]
        else:
            found = [(raw, kind, start, size)]
        for body, k, s, n in found:
            if k == MATRIX and n:
                name, value, _, _ = _matrix(body, s, s + n, order)
                out[name] = value
    return out


def places(raw: bytes) -> dict[str, Place]:
    """Top-level matrices without their values."""
    order, out = _order(raw), {}
    for kind, start, size in elements(raw, 128, len(raw), order):
        if kind == MATRIX and size:
            name, _, dims, real = _matrix(raw, start, start + size, order)
            dtype = order + TYPES[real[0]] if real and real[0] in TYPES else ""
            out[name] = Place(dims, dtype, real[1] if real else 0, int(np.prod(dims)))
    return out


#: Bytes of an element, and of a structure, up to which all of it is read with its header; and bytes of a packed element that
#: are unpacked to see what it is.
SMALL, SMALL_STRUCT, PEEK = 1 << 12, 1 << 20, 1 << 12


@dataclass
class Packed:
    """A compressed matrix that is too large to unpack for its header alone."""

    dims: tuple[int, ...]
    kind: int


def _ranged(read: Callable[[int, int], bytes], at: int, end: int, order: str) -> Iterator[tuple[int, int, int]]:
    """elements(), of a file that is read only where an element begins."""
    while at + 8 <= end:
        kind, size = struct.unpack(order + "2I", read(at, 8))
        if kind >> 16:
            yield kind & 0xFFFF, at + 4, kind >> 16
            at += 8
            continue
        yield kind, at + 8, min(size, end - at - 8)
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def _outlined(read: Callable[[int, int], bytes], start: int, end: int, order: str) -> tuple[str, object]:
    """(name, value) of a matrix: large numbers as a Place, structures as dictionaries of such values."""
    if end - start <= SMALL:
        name, value, _, _ = _matrix(read(start, end - start), 0, end - start, order)
        return name, value
    parts, walked = [], _ranged(read, start, end, order)
    for _ in range(3):
        parts.append(next(walked))
    flags = struct.unpack(order + "I", read(parts[0][1], 4))[0]
    dims = tuple(int(x) for x in _numbers(read(parts[1][1], parts[1][2]), parts[1][0], 0, parts[1][2], order))
    name = read(parts[2][1], parts[2][2]).decode("latin-1").rstrip("\0")
    kind = flags & 0xFF
    if kind in (STRUCT, CHARS) and end - start <= SMALL_STRUCT:
        return name, _matrix(read(start, end - start), 0, end - start, order)[1]
    if kind == STRUCT:
        width_part, names_part = next(walked), next(walked)
        width = int(_numbers(read(width_part[1], width_part[2]), width_part[0], 0, width_part[2], order)[0])
        names = read(names_part[1], names_part[2])
        keys = [names[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(names), width)] if width else []
        values = [_outlined(read, s, s + n, order)[1] if n else None for k, s, n in walked if k == MATRIX]
        if int(np.prod(dims)) == 1:
            return name, dict(zip(keys, values, strict=False))
        return name, {k: values[i :: len(keys)] for i, k in enumerate(keys)}
    real = next(walked, None)
    if kind in (CELL, OBJECT, SPARSE, CHARS) or flags & 0x800 or real is None or real[0] not in TYPES:
        return name, None
    return name, Place(dims, order + TYPES[real[0]], real[1], int(np.prod(dims)))


def outline(read: Callable[[int, int], bytes], size: int) -> dict[str, object]:
    """Variables by name, of a file read in ranges (byte, bytes): small values as they are, large numbers as a Place whose bytes
    aren't read, at the top or inside structures; a large compressed matrix as Packed, unless it is a structure, which has to be
    unpacked to see its fields."""
    order, out = _order(read(0, 128)), {}
    for kind, start, n in _ranged(read, 128, size, order):
        if kind == MATRIX and n:
            name, value = _outlined(read, start, start + n, order)
            out[name] = value
        elif kind == COMPRESSED:
            head = zlib.decompressobj().decompress(read(start, min(n, PEEK)), PEEK)
            inner, body = struct.unpack(order + "2I", head[:8])
            first = list(elements(head, 8, len(head), order))[:3]
            flags = struct.unpack(order + "I", head[first[0][1] : first[0][1] + 4])[0]
            if inner != MATRIX:
                continue
            if body > SMALL_STRUCT and flags & 0xFF not in (STRUCT, CELL, CHARS):
                dims = tuple(int(x) for x in _numbers(head, *first[1], order))
                out[head[first[2][1] : first[2][1] + first[2][2]].decode("latin-1").rstrip("\0")] = Packed(dims, flags & 0xFF)
                continue
            plain = zlib.decompressobj().decompress(read(start, n))
            name, value, _, _ = _matrix(plain, 8, len(plain), order)
            out[name] = value
    return out


def write(variables: dict[str, np.ndarray | str | dict], compress: bool = False) -> bytes:
    """A MAT file of top-level numeric arrays and texts, and of structures of such."""

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<2I", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    def matrix(name: str, value: np.ndarray | str | dict) -> bytes:
        if isinstance(value, dict):
            names = b"".join(k.encode().ljust(32, b"\0") for k in value)
            head = element(6, struct.pack("<2I", STRUCT, 0)) + element(5, struct.pack("<2i", 1, 1)) + element(1, name.encode())
            return element(MATRIX, head + element(5, struct.pack("<i", 32)) + element(1, names) + b"".join(matrix("", v) for v in value.values()))
        x = np.array([ord(c) for c in value], "<u2").reshape(1, -1) if isinstance(value, str) else np.atleast_2d(value)
        kind, cls = (4, 4) if isinstance(value, str) else {"float32": (7, 7), "float64": (9, 6), "int16": (3, 10), "int32": (5, 12)}[x.dtype.name]
        return element(MATRIX, element(6, struct.pack("<2I", cls, 0)) + element(5, struct.pack(f"<{x.ndim}i", *x.shape)) + element(1, name.encode()) + element(kind, x.tobytes(order="F")))

    out = b"MATLAB 5.0 MAT-file".ljust(124) + b"\0\1IM"
    for name, value in variables.items():
        made = matrix(name, value)
        if compress:
            packed = zlib.compress(made)
            made = struct.pack("<2I", COMPRESSED, len(packed)) + packed
        out += made
    return out
