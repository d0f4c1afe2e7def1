"""Windows that arrive in chunks: assembly, stale answers, cancelled requests; in batch and as streams.

A chunk is (request, epoch, chunk_seq, last, values). A window is complete when the chunk marked last is there; the
chunks of a request that comes in again with a later epoch replace the earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def current(chunks: DataFrame) -> DataFrame:
    """Chunks of each request's latest epoch alone."""
    return chunks.withColumn("__latest", F.max("epoch").over(Window.partitionBy("request"))).where(F.col("epoch") == F.col("__latest")).drop("__latest")


def uncancelled(chunks: DataFrame, cancelled: DataFrame) -> DataFrame:
    return chunks.join(cancelled.select("request").distinct(), "request", "left_anti")


def assembled(chunks: DataFrame) -> DataFrame:
    """(request, complete, values): chunks in order, put together once each."""
    once = chunks.dropDuplicates(["request", "epoch", "chunk_seq"])
    latest = once.groupBy("request", "epoch").agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "last", "values"))).alias("parts"))
    newest = latest.groupBy("request").agg(F.max_by("parts", "epoch").alias("parts"))
    return newest.select("request", F.exists("parts", lambda p: p["last"]).alias("complete"), F.flatten(F.transform("parts", lambda p: p["values"])).alias("values"))


#: The store that keeps state by key on disk and writes what changed.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Assembly(StatefulProcessor):
    """Puts the chunks of a request together. Each chunk is a state of its own, under its number, so a batch writes the chunks that
    came and a few numbers, whatever has come before; chunks are read when a window is emitted."""

    def __init__(self, filtered: bool, idle_ms: int | None):
        self.filtered, self.idle_ms = filtered, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "epoch int, last int, sent int, whole int, latest long")
        self.parts = handle.getMapState("parts", "seq int", "v array<double>")

    def handleInputRows(self, key: tuple[Any], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        epoch, last, sent, whole, latest = self.known.get() or (-1, -1, 0, 0, -1)
        before, empty = latest, epoch < 0
        new: dict[int, list[float]] = {}  # chunks that came now: each question to the state is a message to another process
        for frame in rows:
            for r in frame.itertuples():
                latest = max(latest, int(r.at_ms))
                if r.epoch > epoch:
                    if not empty:
                        self.parts.clear()
                    epoch, last, sent, whole, empty, new = int(r.epoch), -1, 0, 0, True, {}
                if r.epoch == epoch:
                    k = int(r.chunk_seq)
                    if (k < 0 or k >= whole) and k not in new and (empty or not self.parts.containsKey((k,))):
                        new[k] = [float(v) for v in r.values]
                    last = k if r.last else last
        for k, v in new.items():
            self.parts.updateValue((k,), (v,))
        while whole in new or (not empty and self.parts.containsKey((whole,))):
            whole += 1
        done, fresh = 0 <= last < whole, whole > sent
        if self.idle_ms is not None and latest > before:
            if before >= 0:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(latest + self.idle_ms)
        self.known.update((epoch, last, max(sent, whole), whole, latest))
        if fresh and (done or not self.filtered):
            held = new if all(k in new for k in range(whole)) else {k[0]: v[0] for k, v in self.parts.iterator()}
            values = [v for k in range(whole) for v in held[k]]
            yield pd.DataFrame({"request": [key[0]], "epoch": [epoch], "complete": [done], "values": [values]})

    def handleExpiredTimer(self, key: tuple[Any], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.known.clear()
        self.parts.clear()
        yield from ()

    def close(self) -> None:
        pass


def assembled_stream(chunks: DataFrame, filtered: bool = False, time: str | None = None, idle: str = "10 minutes") -> DataFrame:
    """(request, epoch, complete, values) of a stream of chunks (request, epoch, chunk_seq, last, values): each time more of a
    window is there without a gap, what there is of it, and at the end all of it. With a filter on, which needs the whole
    window, nothing but the end. A later epoch begins anew, an earlier one is left out, and so are repeats. With a column of
    event time, a window is forgotten when the watermark is `idle` past its latest chunk; without one, none is. A window is what one
    request asks for, and bounded as that is. The session's streams keep their state in STORE from then on."""
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if time else None
    columns = ["request", F.col("epoch").cast("int"), F.col("chunk_seq").cast("int"), "last", F.col("values").cast("array<double>")]
    ms = (F.unix_millis(time) if time else F.lit(0)).cast("long").alias("at_ms")
    dealt = chunks.withWatermark(time, idle).select(*columns, ms, time) if time else chunks.select(*columns, ms)
    return dealt.groupBy("request").transformWithStateInPandas(Assembly(filtered, idle_ms), "request long, epoch int, complete boolean, values array<double>", "append", "EventTime" if time else "None")


def requests_once(stream: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """A stream of requests with repeats within the delay left out: work in flight isn't begun again."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, size: str, slide: str | None = None, delay: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """Count, mean, least and greatest value of each window of event time. `time` is a timestamp with a zone."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    made = stream.withWatermark(time, delay).groupBy(w.alias("w"), *by)
    return made.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")).select("w.start", "w.end", *by, "n", "mean", "least", "most")


def sessions(stream: DataFrame, time: str, gap: str, by: str, delay: str = "10 minutes") -> DataFrame:
    made = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return made.select("w.start", "w.end", by, "n")


def record_bounds(chunk_bytes: int, leftover: int, record: int) -> tuple[int, int]:
    """Whole records in a chunk that follows so many left-over bytes, and the bytes left over after it."""
    total = leftover + chunk_bytes
    return total // record, total % record
