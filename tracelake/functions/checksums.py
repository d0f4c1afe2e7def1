"""Checksums and counts of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The reflected polynomial of the 32-bit code that recording blocks carry; Spark's crc32 has another. Fixed value.
KOOPMAN = 0xEB31D82E


def crc_table() -> list[int]:
    """The remainder of each byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (KOOPMAN if byte & 1 else 0)
        out.append(byte)
    return out


_TABLE = crc_table()


def crc_koopman(data: bytes) -> int:
    """From all ones, without a final inversion."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _TABLE[(crc ^ b) & 0xFF]
    return crc


#: Bytes of the blocks that are summed in step, at most; a larger block goes by itself.
IN_STEP = 16 << 20


def crcs_koopman(blocks: list[bytes]) -> np.ndarray:
    """crc_koopman of each block, all blocks in step: the loop is over places in a block, not over bytes."""
    table, out = np.array(_TABLE, np.uint32), np.full(len(blocks), 0xFFFFFFFF, np.uint32)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    first = 0
    while first < len(order):
        long = len(blocks[order[first]])
        part = order[first : first + max(1, IN_STEP // max(1, long))]
        first += len(part)
        raw = np.zeros((len(part), long), np.uint8)
        for row, i in zip(raw, part, strict=True):
            row[: len(blocks[i])] = np.frombuffer(blocks[i], np.uint8)
        columns = np.ascontiguousarray(raw.T)
        upto = np.array([len(blocks[i]) for i in part])
        crc = out[part]
        for k in range(long):
            live = np.searchsorted(-upto, -k, "left")  # blocks are in order of length, the longest first
            own = crc[:live]
            crc[:live] = own >> np.uint32(8) ^ table[(own ^ columns[k, :live]) & np.uint32(0xFF)]
        out[part] = crc
    return out


def block_checksum(data: Column) -> Column:
    """crc_koopman of a binary column, as a long."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for blocks in arrays:
            own = blocks.to_pylist()
            sums = iter(crcs_koopman([b for b in own if b is not None]).tolist())
            yield pa.array([None if b is None else next(sums) for b in own], pa.int64())

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(data)


def byte_counts(frame: DataFrame, by: str, data: str) -> DataFrame:
    """(by, byte, n, upto): how often each byte stands in the binary values of a group, and how many stand in all up to it: the
    statistics of a range coder. A group has 256 rows at most."""
    codes = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(F.col(data), i, F.lit(1))), 16, 10).cast("int"))
    counted = frame.where(F.length(data) > 0).select(by, F.explode(codes).alias("byte")).groupBy(by, "byte").agg(F.count("*").alias("n"))
    return counted.withColumn("upto", F.sum("n").over(Window.partitionBy(by).orderBy("byte")))
