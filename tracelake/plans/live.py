"""Queries for chunked and streamed windows. conversations are requests, their turns chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.plans.registry import query, table
from tracelake.streaming import chunks as C


def chunks(spark, sf_dir: str):
    """The turns of a conversation as chunks of its request. Of every third conversation the chunks before the last come twice, first
    with an earlier epoch and other values; of every fifth the last chunk never comes."""
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("m"))
    own = c.join(last, "conv_id").select(F.col("conv_id").alias("request"), F.lit(2).alias("epoch"), F.col("turn").alias("chunk_seq"), (F.col("turn") == F.col("m")).alias("last"), F.array(F.length("text")).alias("values"))
    stale = own.where("request % 3 = 0 AND NOT last").withColumns({"epoch": F.lit(1), "values": F.array(F.lit(-1), F.lit(-2))})
    return own.where("request % 5 <> 0 OR NOT last").unionByName(stale)


@query("""WITH c AS (SELECT DISTINCT ON (conv_id, turn) *, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id AS request, bool_or(last) AS complete, list(length(text)::INT ORDER BY turn) AS "values" FROM c WHERE conv_id % 5 <> 0 OR NOT last GROUP BY conv_id""")
def chunk_assembly(spark, sf_dir):
    return C.assembled(chunks(spark, sf_dir))


@query("SELECT conv_id AS request, turn AS chunk_seq FROM (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE conv_id % 3 <> 0 AND (conv_id % 5 <> 0 OR NOT last)")
def cancelled_requests(spark, sf_dir):
    own = chunks(spark, sf_dir)
    return C.uncancelled(own, own.where("request % 3 = 0")).select("request", "chunk_seq")


@query("SELECT l_orderkey AS request, l_linenumber AS chunk_seq FROM (SELECT *, max(l_suppkey % 4) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_suppkey % 4 = m")
def latest_epoch(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("chunk_seq"), (F.col("l_suppkey") % 4).alias("epoch"))
    return C.current(own).select("request", "chunk_seq")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def hourly_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return C.windowed(e, "ts", "1 hour", by=["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "least", "most")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return C.sessions(e, "ts", "30 minutes", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
