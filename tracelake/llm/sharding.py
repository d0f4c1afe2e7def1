"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns VNODES points of the ring; a row starts at the hash of its text, so equal texts start together, and
belongs to the shard of the next point clockwise. A shard takes no more rows than its share: of n rows over s shards
n // s, and one more for the first n % s shards. Rows of an arc are in order of (position, doc_id); the owner takes the
first of them, and those that overflow continue clockwise to the next point whose shard has room. Thus the law `rows`
holds (counts at most one apart) while a change of the number of shards moves few rows.

The order of all rows comes from a range partitioning with doc_id as a second key, so a text that a third of all rows
share is dealt over many tasks. The driver sees the number of rows of each partition and of each arc, nothing of a row.

Defined results: a null text has size 8, a null text_crc32 and the position of an empty one; a null doc_id sorts first.
Repeated rows each get a slot. With no rows there is nothing to place. Other columns are ignored unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import cut, table

SHARDS, VNODES = 24, 64


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Points of the ring in order, and the shard of each. A point depends on its shard and number alone."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}/{v}") >> 1, s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def place(counts: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """counts: rows that start on the arc before each point. Gives (first row, rows, shard), in order of rows.

    Owners are served first, each with the first rows of its arcs; what overflows goes on clockwise.
    """
    n = int(counts.sum())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    first = np.concatenate([[0], np.cumsum(counts)])
    out, over = [], []
    for a, (count, s) in enumerate(zip(counts.tolist(), owner.tolist(), strict=True)):
        took = min(count, room[s])
        room[s] -= took
        if took:
            out.append((int(first[a]), took, s))
        if count > took:
            over.append((a, int(first[a]) + took, count - took))
    for a, row, left in over:
        at = a
        while left:
            at = (at + 1) % len(owner)
            s = int(owner[at])
            took = min(left, room[s])
            if took:
                room[s] -= took
                out.append((row, took, s))
                row, left = row + took, left - took
    return sorted(out)


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, *keep) of every row."""
    points, owner = ring(shards, vnodes)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1).alias("__position"),
        *[F.col(k) for k in keep],
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["__position", "doc_id", "text_crc32"]
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    rows = cut(placed.withColumn("__part", F.shiftright("__row", 33)).withColumn("__row", F.col("__row").bitwiseAND((1 << 33) - 1)))

    sizes = {r[0]: r[1] for r in rows.groupBy("__part").count().collect()}  # one row for each partition
    start = dict(zip(sorted(sizes), np.concatenate([[0], np.cumsum([sizes[p] for p in sorted(sizes)])]).tolist(), strict=False))

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a position beyond the last point starts on the arc of the first
            arc, n = np.unique(np.searchsorted(points, batch.column(0).to_numpy(zero_copy_only=False), "left"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(n)], ["arc", "n"])

    counts = np.zeros(len(points) + 1, np.int64)
    for r in rows.select("__position").mapInArrow(arcs, "arc long, n long").groupBy("arc").agg(F.sum("n").alias("n")).collect():  # one row for each arc
        counts[r["arc"]] = r["n"]
    # rows before the first point and after the last share an arc; keep the order of rows: two arcs of one owner
    segments = place(counts, np.append(owner, owner[0]), shards)
    rows_from = np.array([s[0] for s in segments], np.int64)
    shard_of = np.array([s[2] for s in segments], np.int64)
    slot_from, filled = [], [0] * shards
    for _, n, s in segments:
        slot_from.append(filled[s])
        filled[s] += n
    slot_base = np.array(slot_from, np.int64)
    columns = ["doc_id", "size", "text_crc32", *keep]
    schema = rows.select(*columns[:3], F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), *keep).schema

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column(0).to_numpy() + np.array([start[p] for p in batch.column(1).to_pylist()], np.int64)
            k = np.searchsorted(rows_from, row, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[2:5], pa.array(shard_of[k].astype(np.int32)), pa.array(slot_base[k] + row - rows_from[k]), *batch.columns[5:]], schema.names)

    return rows.select("__row", "__part", *columns).mapInArrow(slots, schema)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder of Parquet files for each shard, with all columns of docs; more columns may carry the names shard and slot."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "size", "text_crc32", "shard", "slot"))
    assign(docs, shards, keep=keep).write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
