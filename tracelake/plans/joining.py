"""Queries for the joins of the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import joins as J
from tracelake.operators import samples as S
from tracelake.plans.naming import text
from tracelake.plans.registry import query, table
from tracelake.plans.signal import SQL, samples


@query("SELECT doc_id, coalesce(quality = 0, false) AS bad FROM documents LEFT JOIN labels USING (doc_id)")
def bad_channel_mask(spark, sf_dir):
    """A mark for each document; those without a label aren't bad."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("bad"))


@query("WITH t AS (SELECT min(ts) AS t0 FROM events) SELECT event_id, user_id, event_type FROM events, t WHERE ts BETWEEN t0 + INTERVAL 1 DAY AND t0 + INTERVAL 2 DAY")
def events_in_window(spark, sf_dir):
    """Events of a closed interval of time."""
    e = table(spark, sf_dir, "events")
    t0 = e.agg(F.min("ts")).scalar()
    return e.where(F.col("ts").between(t0 + F.expr("INTERVAL 1 DAY"), t0 + F.expr("INTERVAL 2 DAY"))).select("event_id", "user_id", "event_type")


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_id % 3 <> 0), e AS (SELECT event_id AS eid, user_id AS uid, epoch_us(ts) AS onset, event_type FROM events WHERE event_id % 3 = 0)
SELECT event_id, eid AS nearest_id, event_type AS nearest_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(onset - t), eid) AS k FROM p JOIN e ON user_id = uid) WHERE k = 1""")
def nearest_event_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    marks = e.where("event_id % 3 = 0").select("user_id", F.col("t").alias("onset"), F.col("event_id").alias("ord"), "event_type")
    near = J.nearest(e.where("event_id % 3 <> 0").drop("event_type"), marks, "user_id", "t", "onset", "ord", ["event_type"])
    return near.where(F.col("event_ord").isNotNull()).select("event_id", F.col("event_ord").alias("nearest_id"), F.col("event_event_type").alias("nearest_type"))


@query(f"""WITH {SQL}, n AS (SELECT channel, max(sample_idx) AS last FROM s GROUP BY channel), q AS (SELECT channel, k, last, greatest(0, least((k * 0.37) * 10, last)) AS pos FROM n, LATERAL (SELECT unnest(range(last * 10 // 37 + 2)) AS k)),
v AS (SELECT q.*, floor(pos)::BIGINT AS f, pos - floor(pos) AS u FROM q)
SELECT v.channel, k::INT AS k, CASE WHEN a.sample_idx % 11 = 10 THEN NULL WHEN u = 0 THEN round(a.value, 6) WHEN b.sample_idx % 11 <> 10 THEN round(a.value * (1 - u) + b.value * u, 6) END AS value
FROM v LEFT JOIN s a ON a.channel = v.channel AND a.sample_idx = f LEFT JOIN s b ON b.channel = v.channel AND b.sample_idx = f + 1""")
def interpolated_asof(spark, sf_dir):
    """Values at times 0.37 s apart, from a channel's first frame to past its last."""
    frames = samples(spark, sf_dir).withColumn("ok", F.col("sample_idx") % 11 != 10)
    ends = frames.groupBy("channel").agg(F.max("sample_idx").alias("last"))
    points = ends.select("channel", F.explode(F.sequence(F.lit(0), (F.floor(F.col("last") * 10 / 37) + 1).cast("int"))).alias("k")).withColumn("t", F.col("k") * 0.37)
    return J.interpolated(points, frames, "channel", "t", 10.0, "sample_idx", "value", "ok").select("channel", "k", F.round("value", 6).alias("value"))


BLOCKS = "m AS (SELECT channel, max(sample_idx) AS last FROM s GROUP BY channel), b AS (SELECT channel, 7 * k AS start, 5 + k % 3 AS size, k AS block FROM m, LATERAL (SELECT unnest(range(last // 7 + 1)) AS k))"


def _ends(s):
    return s.groupBy("channel").agg(F.max("sample_idx").alias("last"))


def _blocks(s):
    """Blocks of 5 to 7 samples, each 7 samples after the last, over all of a channel."""
    k = F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 7).cast("int")))
    return _ends(s).select("channel", k.alias("block")).select("channel", (F.col("block") * 7).alias("start"), (F.col("block") % 3 + 5).alias("size"), "block")


@query(f"WITH {SQL}, {BLOCKS} SELECT s.channel, sample_idx, block::INT AS block FROM s JOIN b ON s.channel = b.channel AND sample_idx >= start AND sample_idx < start + size")
def block_range_join(spark, sf_dir):
    s = samples(spark, sf_dir).select("channel", "sample_idx")
    return J.in_blocks(s, _blocks(s), "channel", "sample_idx", "start", "size", ["block"], 16)


@query(f"WITH {SQL}, {BLOCKS}, w AS (SELECT channel, k AS win, 10 * k AS a, 10 * k + 12 AS z FROM m, LATERAL (SELECT unnest(range(last // 10 + 1)) AS k)) SELECT w.channel, win::INT AS win, block::INT AS block, greatest(a, start)::INT AS \"from\", least(z, start + size)::INT AS \"to\" FROM w JOIN b ON w.channel = b.channel AND a < start + size AND z > start")
def interval_overlap_join(spark, sf_dir):
    s = samples(spark, sf_dir)
    blocks = _blocks(s).withColumn("stop", F.col("start") + F.col("size"))
    windows = _ends(s).select("channel", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 10).cast("int"))).alias("win")).withColumns({"a": F.col("win") * 10, "z": F.col("win") * 10 + 12})
    return J.overlapping(windows, blocks, "channel", ("a", "z"), ("start", "stop"), 16).select("channel", "win", "block", F.col("from").cast("int"), F.col("to").cast("int"))


@query("""WITH f AS (SELECT 'n' || n_nationkey || '/m' || (n_nationkey % 3) AS key, 'deep' AS src FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'r' || r_regionkey, 'region' FROM region WHERE r_regionkey <> 2),
c AS (SELECT c_custkey, unnest(['n' || c_nationkey || '/m' || (c_custkey % 3), 'n' || c_nationkey, 'r' || n_regionkey]) AS key, unnest([0, 1, 2]) AS level FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, c.key, level, src FROM (SELECT c.*, src, row_number() OVER (PARTITION BY c_custkey ORDER BY level) AS k FROM c JOIN f USING (key)) c WHERE k = 1""")
def inheritance_first_match(spark, sf_dir):
    """The nearest sidecar up a directory tree."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    files = n.where("n_nationkey % 2 = 0").select(F.concat(name("n_nationkey"), F.lit("/m"), (F.col("n_nationkey") % 3).cast("string")).alias("key"), F.lit("deep").alias("src"))
    files = files.union(n.where("n_nationkey % 3 = 0").select(name("n_nationkey"), F.lit("nation"))).union(r.where("r_regionkey <> 2").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.lit("region")))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    levels = F.array(F.concat(name("c_nationkey"), F.lit("/m"), (F.col("c_custkey") % 3).cast("string")), name("c_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    return J.first_match(c, levels, files, "key").select("c_custkey", "hit.key", "hit.level", "hit.src")


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, (i + 1)::INT AS idx, CASE WHEN n = m THEN 'L' || (i + 1) ELSE 'Ch' || (i + 1) END AS label FROM l, LATERAL (SELECT unnest(range(n)) AS i)""")
def label_fallback(spark, sf_dir):
    """Names from metadata if there are as many as channels, else Ch1 to ChN."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("m"))  # noqa: E741
    own = l.withColumn("idx", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return own.select("l_orderkey", "idx", F.concat(F.when(F.col("n") == F.col("m"), "L").otherwise("Ch"), F.col("idx").cast("string")).alias("label"))


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_partkey AS binary_name, b.l_partkey AS sidecar_name, a.l_partkey % 5 <> b.l_partkey % 5 AS mismatch
FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey + 1 AND b.l_linenumber = a.l_linenumber""")
def positional_label_join(spark, sf_dir):
    """Labels of a file against those of its sidecar, by position, with a mark where they differ."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("binary_name"))
    b = a.select((F.col("l_orderkey") - 1).alias("l_orderkey"), "l_linenumber", F.col("binary_name").alias("sidecar_name"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).withColumn("mismatch", F.col("binary_name") % 5 != F.col("sidecar_name") % 5)


@query("""WITH s AS (SELECT lower(trim(s_name)) AS key, s_suppkey, s_acctbal FROM supplier), d AS (SELECT key, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY right(key, 2) ORDER BY s_suppkey DESC) AS k FROM s)
SELECT c_custkey, s_suppkey, s_acctbal FROM customer LEFT JOIN (SELECT * FROM d WHERE k = 1) d ON right(lower(trim(c_name)), 2) = right(d.key, 2)""")
def sensor_channel_join(spark, sf_dir):
    """Sensors with the channel row of the same name, trimmed and lower-cased; the last of several wins."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_name")
    key = lambda c: F.right(F.lower(F.trim(F.col(c))), F.lit(2))
    last = J.last_wins(s, key("s_name"), "s_suppkey").select("__key", "s_suppkey", "s_acctbal")
    return table(spark, sf_dir, "customer").withColumn("__key", key("c_name")).join(last, "__key", "left").select("c_custkey", "s_suppkey", "s_acctbal")


@query("SELECT n_name, count(*) AS located FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY n_name")
def located_channel_count(spark, sf_dir):
    """How many channels have a position: matches of a semi-join, by frame."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return c.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.count("*").alias("located"))


@query("""WITH k AS (SELECT c_custkey, 'ds-' || c_nationkey % 3 || '/sub-' || c_nationkey || '/' || c_mktsegment AS key FROM customer),
n AS (SELECT DISTINCT c_nationkey AS recording, 1 AS priority, 'sub-' || c_nationkey || '/' || c_mktsegment AS name FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT DISTINCT c_nationkey, 2, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT c_nationkey, 3, 'ds-' || c_nationkey % 3 || '/sub-' || c_nationkey || '/' || c_mktsegment FROM customer)
SELECT recording, c_custkey, priority, name FROM (SELECT n.recording, c_custkey, priority, name, row_number() OVER (PARTITION BY n.recording, c_custkey ORDER BY priority, name) AS r FROM k JOIN n ON key = name OR key LIKE '%/' || name) WHERE r = 1""")
def suffix_match_join(spark, sf_dir):
    """For each recording, the keys that are one of its names or end in /name, each with the name of least priority: names may have
    several parts."""
    c = table(spark, sf_dir, "customer")
    own, top = text("sub-", F.col("c_nationkey"), "/", F.col("c_mktsegment")), text("ds-", F.col("c_nationkey") % 3, "/")
    k = c.select("c_custkey", F.concat(top, own).alias("key"))
    named = lambda rows, priority, name: rows.select(F.col("c_nationkey").alias("recording"), F.lit(priority).alias("priority"), name.alias("name")).distinct()
    names = named(c.where("c_custkey % 5 = 0"), 1, own).unionByName(named(c.where("c_custkey % 3 = 0"), 2, F.col("c_mktsegment"))).unionByName(named(c, 3, F.concat(top, own)))
    return J.best_suffixes(k, "c_custkey", "key", names, "name", "recording", "priority")


@query("""WITH p AS (SELECT s_suppkey, n_nationkey, (s_nationkey = n_nationkey)::INT * 4 + (s_nationkey % 5 = n_regionkey)::INT * 2 + (s_suppkey % 3 = n_nationkey % 3)::INT AS score FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey OR s_nationkey = n_nationkey),
r AS (SELECT *, rank() OVER (PARTITION BY s_suppkey ORDER BY score DESC) AS k FROM p)
SELECT s_suppkey, max(score) AS score, min(n_nationkey) AS n_nationkey, count(*) > 1 AS ambiguous FROM r WHERE k = 1 GROUP BY s_suppkey""")
def best_scored_match(spark, sf_dir):
    """Coordinate files of a table, scored by what they share; a tie at the top is ambiguous."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    by_region = s.join(n, F.col("s_nationkey") % 5 == F.col("n_regionkey"))
    by_nation = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).where(F.col("s_nationkey") % 5 != F.col("n_regionkey"))
    score = (F.col("s_nationkey") == F.col("n_nationkey")).cast("int") * 4 + (F.col("s_nationkey") % 5 == F.col("n_regionkey")).cast("int") * 2 + (F.col("s_suppkey") % 3 == F.col("n_nationkey") % 3).cast("int")
    return J.best_scored(by_region.unionByName(by_nation), ["s_suppkey"], score, "n_nationkey")


@query("SELECT o_orderkey, coalesce(max(CASE WHEN l_linenumber = 2 THEN l_partkey END), max(CASE WHEN l_linenumber = 1 THEN l_partkey END)) AS companion FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def sibling_lookup(spark, sf_dir):
    """The companion file: the second of the group, else the first."""
    l = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_linenumber") == 2, F.col("l_partkey"))).alias("b"), F.max(F.when(F.col("l_linenumber") == 1, F.col("l_partkey"))).alias("a"))  # noqa: E741
    return table(spark, sf_dir, "orders").select("o_orderkey").join(l, "o_orderkey", "left").select("o_orderkey", F.coalesce("b", "a").alias("companion"))


@query("SELECT event_id, p_name FROM events JOIN part ON p_partkey = (props::JSON ->> 'k')::BIGINT")
def stimulus_assets(spark, sf_dir):
    """Events with the asset that their stimulus id names."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("p_partkey"))
    return e.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("event_id", "p_name")


@query("""WITH w AS (SELECT vec_id AS vertex, b AS bone, (b + 1) / 10.0 AS w FROM embeddings, (SELECT unnest(range(4)) AS b)), f AS (SELECT unnest(range(3)) AS frame)
SELECT frame::INT AS frame, vertex, round(sum(w * (embedding[1]::DOUBLE * (1 + bone) + frame)), 6) AS x, round(sum(w * (embedding[2]::DOUBLE + bone)), 6) AS y, round(sum(w * (embedding[3]::DOUBLE * 2)), 6) AS z FROM w JOIN embeddings ON vec_id = vertex, f GROUP BY ALL""")
def skinned_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rest = e.select(F.col("vec_id").alias("vertex"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    weights = rest.select("vertex", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("bone")).withColumn("w", (F.col("bone") + 1) / 10.0)
    m = [(f, b, [1.0 + b, 0.0, 0.0, float(f), 0.0, 1.0, 0.0, float(b), 0.0, 0.0, 2.0, 0.0]) for f in range(3) for b in range(4)]
    bones = F.broadcast(spark.createDataFrame(m, "frame int, bone int, m array<double>"))
    return J.skinned(weights, bones, rest).select("frame", "vertex", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("""WITH c AS (SELECT l_suppkey, l_linenumber AS rate, count(*) AS cnt FROM lineitem GROUP BY ALL), m AS (SELECT rate FROM c GROUP BY rate ORDER BY count(*) DESC, rate DESC LIMIT 1)
SELECT l_suppkey, rate::INT AS rate FROM c WHERE rate <> (SELECT rate FROM m)""")
def dropped_channels(spark, sf_dir):
    """Set difference: channels (supplier and rate) shown that aren't at the rate which most have."""
    c = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("int").alias("rate")).distinct()
    modal = c.groupBy("rate").agg(F.count("*").alias("n")).agg(F.max_by("rate", F.struct("n", "rate")).alias("rate"))
    return c.join(c.join(modal, "rate", "left_semi"), ["l_suppkey", "rate"], "left_anti")


@query(f"""WITH RECURSIVE {SQL}, x AS (SELECT channel, sample_idx AS i, (sample_idx * 9 + event_id % 7)::BIGINT AS px FROM s),
r AS (SELECT channel, 0::BIGINT AS i, px AS last, true AS shown FROM x WHERE i = 0 UNION ALL
SELECT r.channel, x.i, CASE WHEN px - last >= 32 THEN px ELSE last END, px - last >= 32 FROM r JOIN x ON x.channel = r.channel AND x.i = r.i + 1)
SELECT channel, i AS sample_idx FROM r WHERE shown""")
def label_suppression(spark, sf_dir):
    """Labels at least 32 pixels after the last one drawn."""
    x = samples(spark, sf_dir).select("channel", "sample_idx", (F.col("sample_idx") * 9 + F.col("event_id") % 7).alias("px"))
    return S.spaced(x, "channel", "sample_idx", "px", 32).select("channel", "sample_idx")
