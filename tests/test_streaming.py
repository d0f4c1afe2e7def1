import numpy as np
from pyspark.sql import functions as F

from tracelake.streaming import chunks as C

SF = "/root/testdata/sf0.001"


def test_assembly(spark):
    rows = [(1, 0, 1, True, [3.0]), (1, 0, 0, False, [1.0, 2.0]), (1, 0, 0, False, [1.0, 2.0]), (2, 0, 0, False, [9.0]), (2, 1, 0, False, [5.0])]
    df = spark.createDataFrame(rows, "request long, epoch long, chunk_seq long, last boolean, values array<double>")
    got = {r["request"]: (r["complete"], r["values"]) for r in C.assembled(df).collect()}
    assert got == {1: (True, [1.0, 2.0, 3.0]), 2: (False, [5.0])}
    assert C.current(df).count() == 4 and C.uncancelled(df, df.where("request = 1")).count() == 2
    assert C.record_bounds(10, 3, 4) == (3, 1)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = C.windowed(stream, "ts", "1 hour", delay="365 days")
    q = made.writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r["start"]: r["n"] for r in C.windowed(events, "ts", "1 hour").collect()}
    assert {r["start"]: r["n"] for r in spark.table("hourly").collect()} == want


def test_dedup_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    events.write.parquet(str(tmp_path / "in"))
    once = C.requests_once(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "365 days")
    q = once.writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == events.select("user_id").distinct().count()


def _streamed(spark, tmp_path, batches, filtered):
    """Rows of each batch in turn through the stateful assembly."""
    schema = "request long, epoch int, chunk_seq int, last boolean, values array<double>"
    source, name = tmp_path / f"in{filtered}", f"assembled{filtered}"
    source.mkdir()
    made = C.assembled_stream(spark.readStream.schema(schema).parquet(str(source)), filtered)
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = made.writeStream.foreachBatch(lambda df, _: out.extend(sorted(tuple(r) for r in df.collect()))).option("checkpointLocation", str(tmp_path / f"c{filtered}")).trigger(availableNow=True).queryName(name).start()
        assert q.awaitTermination(120)
    return out


def test_partial_and_final_windows(spark, tmp_path):
    batches = [
        [(1, 0, 0, False, [1.0, 2.0]), (2, 0, 1, True, [9.0])],
        [(1, 0, 2, True, [4.0]), (1, 0, 0, False, [1.0, 2.0])],
        [(1, 0, 1, False, [3.0]), (2, 0, 0, False, [8.0])],
        [(2, 1, 0, False, [5.0]), (2, 0, 0, False, [7.0])],
        [(2, 1, 1, True, [])],
    ]
    assert _streamed(spark, tmp_path, batches, False) == [(1, 0, False, [1.0, 2.0]), *sorted([(1, 0, True, [1.0, 2.0, 3.0, 4.0]), (2, 0, True, [8.0, 9.0])]), (2, 1, False, [5.0]), (2, 1, True, [5.0])]
    assert _streamed(spark, tmp_path, batches, True) == [*sorted([(1, 0, True, [1.0, 2.0, 3.0, 4.0]), (2, 0, True, [8.0, 9.0])]), (2, 1, True, [5.0])]


def test_growing_recordings(spark, tmp_path):
    from tracelake.sources import datasource, encoders

    datasource.register(spark)
    wave = np.stack([np.sin(np.arange(1000) / k) * 40 for k in (3, 7)])
    encoders.edf(str(tmp_path / "whole.edf"), wave, 100)
    raw = (tmp_path / "whole.edf").read_bytes()
    (tmp_path / "live").mkdir()
    head, record = 256 * 3, 2 * 2 * 100
    live = tmp_path / "live" / "a.edf"
    live.write_bytes(raw[: head + 4 * record + 30])
    (tmp_path / "live" / "b.edf").write_bytes(raw[:100])

    def new():
        out = []
        q = spark.readStream.format("recording").option("blockSamples", 200).load(f"{tmp_path}/live/*.edf").writeStream.foreachBatch(lambda df, _: out.extend((r["recording"].split("/")[-1], r["sample_idx"]) for r in df.where("channel_idx = 0").collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(out)

    assert new() == [("a.edf", i) for i in range(400)]
    live.write_bytes(raw[: head + 7 * record])
    (tmp_path / "live" / "b.edf").write_bytes(raw)
    assert new() == [("a.edf", i) for i in range(400, 700)] + [("b.edf", i) for i in range(1000)]


def test_idle_windows_are_forgotten(spark, tmp_path):
    """What isn't added to for `idle` behind the watermark goes; late, repeated and missing chunks over several batches."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    at = lambda hours: start + timedelta(hours=hours)
    batches = [
        [(1, 0, 0, False, [1.0], at(0)), (2, 0, 1, True, [2.0], at(0)), (2, 0, 1, True, [2.5], at(0))],
        [(3, 0, 0, False, [7.0], at(5))],
        [(3, 0, 1, False, [8.0], at(5.1))],
        [(1, 0, 1, True, [9.0], at(5.2)), (2, 0, 0, False, [1.0], at(5.2)), (3, 0, 2, True, [9.0], at(5.2)), (3, 0, 1, False, [0.0], at(5.2))],
    ]
    schema = "request long, epoch int, chunk_seq int, last boolean, values array<double>, at timestamp"
    (tmp_path / "in").mkdir()
    made = C.assembled_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), time="at", idle="1 hour")
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = made.writeStream.foreachBatch(lambda df, _: out.extend(sorted(tuple(r) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert out == [(1, 0, False, [1.0]), (3, 0, False, [7.0]), (3, 0, False, [7.0, 8.0]), *sorted([(2, 0, False, [1.0]), (3, 0, True, [7.0, 8.0, 9.0])])]
