"""What several corpus operators share: reading tables, cutting lineage, hold-out rule, shared model samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that may be broadcast by hint: at 16 to 64 bytes each, at most about 64 MB.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session whose driver is its one executor may
    leave that unset, and gets a temporary folder; on a cluster no folder of the driver would do."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back. The table goes when the session's program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint only if a count shows that it has no more than so many rows. df should be cheap to read again."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with `rank` (from 0, in the order of `order` within each value of group) and `total` (rows of the group).

    A range partitioning by group and order deals a hot group over many tasks, rows that are equal in all of these by a third
    key; only (group, partition) counts are summed in a window. Nulls are a group of their own and come first.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "__dealt"]
    dealt = df.withColumn("__dealt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__dealt")
    rows = cut(dealt.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)))
    runs = rows.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__p")).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy("__group")
    before = F.coalesce(F.sum("__n").over(own.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("*", before.alias("__before"), F.sum("__n").over(own).alias("total")))
    met = rows.join(runs, rows[group].eqNullSafe(runs["__group"]) & (rows["__part"] == runs["__p"]))
    return met.withColumn("rank", F.col("__row") - F.col("__first") + F.col("__before")).drop("__row", "__part", "__group", "__p", "__first", "__n", "__before")


def crc_mod(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, mod so many: the hold-out rule."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % mod


def uniform(col: str | Column, seed: int = 7) -> Column:
    """A repeatable number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 40)) / F.lit(float(1 << 40))


_HELD: dict[Any, Any] = {}
#: What the C library is told, where it is glibc: blocks from 4 MB on are mapped one by one, and go back when they are freed.
_MMAP_THRESHOLD, _TRIM_THRESHOLD, _LARGE = -3, -1, 4 << 20


def _c_library() -> Any:
    try:
        library = ctypes.CDLL(None)
        return library if hasattr(library, "malloc_trim") and hasattr(library, "mallopt") else None
    except OSError:
        return None


def _trim() -> None:
    """Give what was freed back to the system."""
    gc.collect()
    if (library := _c_library()) is not None:
        library.malloc_trim(0)


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between its tasks: one thing at a time, so that the operators of a pipeline, which share
    their workers, don't add up. What the last operator left goes back to the system."""
    if key not in _HELD:
        _HELD.clear()
        if (library := _c_library()) is not None:
            library.mallopt(_MMAP_THRESHOLD, _LARGE)
            library.mallopt(_TRIM_THRESHOLD, 4 * _LARGE)
        pa.set_memory_pool(pa.system_memory_pool())  # the default pool keeps what batches have freed
        _trim()
        _HELD[key] = make()
    return _HELD[key]


def tidy(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """run, with the worker's memory trimmed when a task ends: a worker may stay idle beside others."""

    def wrapped(batches: Iterator[Any]) -> Iterator[Any]:
        yield from run(batches)
        _trim()

    return wrapped


#: Rows and bytes of the batches that slices() cuts.
SLICE_ROWS, SLICE_BYTES = 500, 2 << 20


def cuts(sizes: list[int], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of so many rows or bytes at most; a larger row is a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= rows or total + size > most):
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows and about SLICE_BYTES of text, so that few texts at a time become Python strings."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type)]
        size = [sum(x) for x in zip(*(pc.fill_null(pc.binary_length(c), 0).to_pylist() for c in texts), strict=True)] if texts else [0] * batch.num_rows
        for start, end in cuts(size, rows):
            yield batch.slice(start, end - start)


def by_text(make: Callable[[], Callable[[list[str | None]], pa.Array]], kind: str) -> Callable[..., Column]:
    """A column function from texts to one value each: make() gives, in a task, the function that judges a list of texts.
    Only the texts go to Python and only the values come back; the other columns stay with Spark."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = make()
        for texts in arrays:
            found = [judge(texts.slice(start, end - start).to_pylist()) for start, end in cuts(pc.fill_null(pc.binary_length(texts), 0).to_pylist())]
            yield pa.concat_arrays(found) if found else judge([])
        _trim()

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)
