"""Queries for the relational pipelines of the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import scalars as X
from tracelake.operators import audit as A
from tracelake.operators import samples as S
from tracelake.plans.registry import query, table


@query("""WITH e AS (SELECT user_id, event_id, event_type, value FROM events)
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id) AS k FROM e) WHERE k = 1""")
def dedup_prefer_pass(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return A.deduplicated(e, "user_id", F.col("event_type") == "purchase", ["event_id"])


@query("SELECT url, page_id FROM (SELECT split_part(split_part(url, '#', 1), '?', 1) AS url, page_id, row_number() OVER (PARTITION BY split_part(split_part(url, '#', 1), '?', 1) ORDER BY page_id) AS k FROM pages) WHERE k = 1")
def dedup_keep_first(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.substring_index(F.substring_index("url", "#", 1), "?", 1).alias("url"), "page_id")
    return A.deduplicated(p, "url", F.lit(False), ["page_id"])


@query("SELECT event_id, user_id, 0 AS shard FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, user_id, 1 FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, NULL, 2 FROM events WHERE event_id % 3 = 2")
def union_shards(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return A.merged([e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1"), e.where("event_id % 3 = 2").drop("user_id")])


#: Audit rows by event; the tables hold none.
MESSAGES = ["fetchBuffer: file exceeds the 200MB cap", "FIFFB_RAW_DATA missing", "inline data exceeds limit", "HDF5 container", "net::ERR_FAILED", "stage-caption never visible", "HTTP 503", "renamed a.fdt", "something else", "no usable raw data block"]
EXTS, VERDICTS = ["ds", "fif", "set", "edf", "fif", "set", "vhdr"], ["fail", "console-error", "timeout", "render-fail"]
AUDIT = f"""a AS (SELECT event_id, user_id, event_type, value, {EXTS}[event_id % 7 + 1] AS ext, CASE WHEN value > 60 THEN 'pass' ELSE {VERDICTS}[event_id % 4 + 1] END AS verdict, CASE WHEN event_id % 11 < 10 THEN {MESSAGES}[event_id % 11 + 1] END AS message FROM events)"""
CLASS = """CASE WHEN verdict = 'pass' THEN NULL WHEN ext = 'ds' THEN 'format-CTF-residual'
WHEN ext = 'fif' AND (message ILIKE '%fetchbuffer%' OR message ILIKE '%exceeds % cap%' OR message ILIKE '%over %mb%' OR message ILIKE '%200mb%' OR message ILIKE '%200 mb%') THEN 'format-FIFF-large'
WHEN ext = 'fif' AND (message ILIKE '%fiffb\\_raw\\_data%' ESCAPE '\\' OR message ILIKE '%no %raw%block%' OR message ILIKE '%events/projections/annotations only%') THEN 'format-FIFF-no-raw-block'
WHEN ext = 'set' AND (message ILIKE '%200mb%' OR message ILIKE '%200 mb%' OR message ILIKE '%inline % exceeds%' OR message ILIKE '%cap on inline%') THEN 'format-EEGLAB-large'
WHEN ext = 'set' AND (message LIKE '%7.3%' OR message ILIKE '%hdf5%' OR message ILIKE '%jsfive%' OR message ILIKE '%renamed %fdt%' OR message ILIKE '%fdt %not found%') THEN 'format-EEGLAB-v73-renamed-fdt'
WHEN verdict = 'console-error' AND (regexp_matches(message, '5[0-9][0-9]') OR message ILIKE '%net::err%' OR message ILIKE '%tls%' OR message ILIKE '%econnreset%' OR message ILIKE '%eai\\_again%' ESCAPE '\\') THEN 'network-flake'
WHEN verdict = 'timeout' OR verdict = 'render-fail' AND message ILIKE '%stage-caption never visible%' THEN 'timeout-cold-cdn' ELSE 'unknown' END"""


def audit_rows(spark, sf_dir: str):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    one = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("event_id") % n).cast("int"))
    return e.withColumns({"ext": one(EXTS, 7), "verdict": F.when(F.col("value") > 60, "pass").otherwise(one(VERDICTS, 4)), "message": one(MESSAGES, 11)})


def classed():
    return X.failure_class(F.col("ext"), F.col("verdict"), F.col("message"))


@query(f"WITH {AUDIT} SELECT event_id, {CLASS} AS class FROM a")
def failure_classify(spark, sf_dir):
    return audit_rows(spark, sf_dir).select("event_id", classed().alias("class"))


@query(f"WITH {AUDIT}, c AS (SELECT {CLASS} AS class, event_type FROM a) SELECT class, event_type, count(*) AS n FROM c GROUP BY ALL")
def tally_by_verdict(spark, sf_dir):
    return audit_rows(spark, sf_dir).select(classed().alias("class"), "event_type").groupBy("class", "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {AUDIT} SELECT event_type, count(*) AS n, sum((verdict = 'pass')::INT)::BIGINT AS hits, round(sum((verdict = 'pass')::INT) / count(*), 6) AS rate FROM a GROUP BY event_type")
def rate_by_group(spark, sf_dir):
    return A.rates(audit_rows(spark, sf_dir), ["event_type"], F.col("verdict") == "pass")


@query(f"""WITH {AUDIT}, r AS (SELECT event_type, event_id % 5 AS run, 100.0 * sum((verdict = 'pass')::INT) / count(*) AS rate FROM a GROUP BY ALL)
SELECT event_type, count(*) AS n, round(avg(rate), 6) AS mean, round(stddev_samp(rate), 6) AS std, round(min(rate), 6) AS least, round(max(rate), 6) AS most, round(2.776 * stddev_samp(rate) / sqrt(5), 6) AS ci FROM r GROUP BY event_type""")
def multi_run_ci95(spark, sf_dir):
    """Pass rates of five runs, then mean, deviation and interval over the runs."""
    runs = A.rates(audit_rows(spark, sf_dir).withColumn("run", F.col("event_id") % 5), ["event_type", "run"], F.col("verdict") == "pass").withColumn("rate", 100.0 * F.col("hits") / F.col("n"))
    return S.ci95(runs, ["event_type"], "rate").select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most", "ci")])


@query(f"WITH {AUDIT}, f AS (SELECT event_type, count(*) AS frequency FROM a GROUP BY 1) SELECT event_id, event_type, value, frequency FROM a JOIN f USING (event_type) WHERE verdict <> 'pass' ORDER BY frequency, event_type, value DESC, event_id LIMIT 10")
def rarest_first_topk(spark, sf_dir):
    rows = audit_rows(spark, sf_dir).select("event_id", "event_type", "value", "verdict")
    frequency = rows.groupBy("event_type").agg(F.count("*").alias("frequency"))
    return rows.where("verdict <> 'pass'").join(frequency, "event_type").orderBy("frequency", "event_type", F.desc("value"), "event_id").limit(10).select("event_id", "event_type", "value", "frequency")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k <= 3")
def per_dataset_cap(spark, sf_dir):
    return A.capped(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || '#7'), c_custkey LIMIT 25")
def seeded_sample(spark, sf_dir):
    return A.sampled(table(spark, sf_dir, "customer"), "c_custkey", 25, 7).select("c_custkey", "c_name")


@query("SELECT event_type, event_id, rank::INT AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '#7'), event_id) AS rank FROM events) WHERE rank <= 20")
def stratified_sample(spark, sf_dir):
    """Twenty events of each type, chosen by the hash of their ids."""
    return A.stratified(table(spark, sf_dir, "events"), ["event_type"], "event_id", 20, 7).select("event_type", "event_id", "rank")


@query("""WITH q AS (SELECT event_type AS metric, event_id % 2 AS run, value, row_number() OVER (PARTITION BY event_type, event_id % 2 ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type, event_id % 2) AS n FROM events),
s AS (SELECT metric, run, max(CASE WHEN k = least(n - 1, floor(n * 0.5)) THEN value END) AS p50, max(CASE WHEN k = least(n - 1, floor(n * 0.95)) THEN value END) AS p95 FROM q GROUP BY ALL)
SELECT a.metric, a.p50, a.p95, b.p50 AS base_p50, b.p95 AS base_p95, CASE WHEN b.p50 IS NULL THEN 'new' WHEN (a.p50 > b.p50 * 1.01 AND a.p50 - b.p50 > 0.05) OR (a.p95 > b.p95 * 1.02 AND a.p95 - b.p95 > 0.05) THEN 'regressed' ELSE 'ok' END AS verdict
FROM s a LEFT JOIN s b ON a.metric = b.metric AND b.run = 0 WHERE a.run = 1""")
def regression_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), (F.col("event_id") % 2).alias("run"), "value")
    s = S.ranked(e, ["metric", "run"], "value", {"p50": 0.5, "p95": 0.95})
    current = s.where("run = 1").select("metric", "p50", "p95")
    return A.gated(current, s.where("run = 0"), "metric", {"p50": 0.01, "p95": 0.02}, 0.05)


@query("SELECT event_type, count(*) AS n, max(value) AS most, max(value) <= 500 AS within FROM events GROUP BY event_type")
def budget_gate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most")).withColumn("within", F.col("most") <= 500)


@query("SELECT n_regionkey, count(*) AS tables, sum((s_acctbal > 0)::INT)::BIGINT AS renderable, CASE WHEN min(s_acctbal) > 0 THEN 'ok' ELSE 'partial' END AS status FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_regionkey")
def coordinate_sweep(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return s.groupBy("n_regionkey").agg(F.count("*").alias("tables"), F.sum((F.col("s_acctbal") > 0).cast("long")).alias("renderable"), F.when(F.min("s_acctbal") > 0, "ok").otherwise("partial").alias("status"))


@query("SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY coalesce(o_orderpriority, ''), o_orderkey")
def two_key_sort(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.coalesce("o_orderpriority", F.lit("")), "o_orderkey").select("o_orderpriority", "o_orderkey")


@query("SELECT event_type, strftime(min(ts), '%Y-%m-%d') AS first_day, count(DISTINCT user_id) AS channels FROM events GROUP BY event_type")
def report_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.count_distinct("user_id").alias("channels"))
