"""Queries over samples: a user of `events` is a channel, its events in order of (ts, event_id) are samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import scalars as X
from tracelake.operators import dsp, folds
from tracelake.operators import samples as S
from tracelake.plans.registry import query, table

SQL = "s AS (SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, value, event_type, event_id FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numbered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type"), "user_id", ["ts", "event_id"], "value")


@query(f"WITH {SQL} SELECT channel, sample_idx, value FROM s WHERE sample_idx >= 10 AND sample_idx < 40")
def window_slice(spark, sf_dir):
    return S.window(samples(spark, sf_dir), 10, 30).select("channel", "sample_idx", "value")


@query(f"WITH {SQL} SELECT channel, sample_idx // 16 AS window_idx, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM s GROUP BY ALL")
def window_tumbling_stats(spark, sf_dir):
    return S.mean_std(S.tumbling(samples(spark, sf_dir), 16), ["channel", "window_idx"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"WITH {SQL} SELECT channel, w AS window_idx, count(*) AS n, round(sum(value), 4) AS total FROM s, (SELECT unnest([0, 1]) AS d) d, LATERAL (SELECT sample_idx // 8 - d.d AS w) x WHERE w >= 0 GROUP BY ALL")
def window_half_overlap(spark, sf_dir):
    return S.sliding(samples(spark, sf_dir), 16).groupBy("channel", "window_idx").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {SQL} SELECT channel, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM s GROUP BY channel")
def channel_mean_std(spark, sf_dir):
    return S.mean_std(samples(spark, sf_dir), ["channel"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"""WITH {SQL}, n AS (SELECT channel, count(*) AS n FROM s GROUP BY channel), p AS (SELECT unnest(range(20)) AS pixel),
g AS (SELECT channel, pixel, pixel * n // 20 AS a, CASE WHEN n >= 20 THEN (pixel + 1) * n // 20 ELSE pixel * n // 20 + 1 END AS b FROM n, p)
SELECT g.channel, pixel::INT AS pixel, min(value) AS lo, max(value) AS hi FROM g JOIN s ON s.channel = g.channel AND sample_idx >= a AND sample_idx < b GROUP BY g.channel, pixel""")
def minmax_decimate(spark, sf_dir):
    return S.decimated(samples(spark, sf_dir), 20)


@query(f"""WITH {SQL}, c AS (SELECT channel, event_type, stddev_pop(value) AS sd FROM s GROUP BY ALL), o AS (SELECT event_type, round(sd, 6) AS sd, row_number() OVER (PARTITION BY event_type ORDER BY sd) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM c WHERE sd > 0)
SELECT event_type, sd AS median_std, round(sd * 6 / 0.9, 4) AS slot_uv FROM o WHERE k = n // 2""")
def upper_median_scale(spark, sf_dir):
    spread = samples(spark, sf_dir).groupBy("channel", "event_type").agg(F.stddev_pop("value").alias("sd")).where("sd > 0").select("event_type", F.round("sd", 6).alias("sd"))
    return S.ranked(spread, ["event_type"], "sd", {"median_std": 0.5}).select("event_type", "median_std", F.round(F.col("median_std") * 6 / 0.9, 4).alias("slot_uv"))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, min(value) AS least, max(value) AS most, max(CASE WHEN k = least(n - 1, floor(n * 0.5)) THEN value END) AS p50, max(CASE WHEN k = least(n - 1, floor(n * 0.95)) THEN value END) AS p95, max(CASE WHEN k = least(n - 1, floor(n * 0.99)) THEN value END) AS p99 FROM o GROUP BY event_type""")
def nearest_rank_quantiles(spark, sf_dir):
    return S.ranked(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""WITH c AS (SELECT l_suppkey, l_linenumber AS rate, count(*) AS cnt FROM lineitem GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY cnt DESC, rate DESC) AS k FROM c)
SELECT l.l_orderkey, l.l_suppkey, l.l_linenumber FROM lineitem l JOIN m ON m.k = 1 AND m.l_suppkey = l.l_suppkey AND m.rate = l.l_linenumber""")
def modal_rate_channels(spark, sf_dir):
    """Of each supplier's lines, those at its most frequent line number, the greater of equally frequent ones."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    modal = S.mode_high(lines, ["l_suppkey"], "l_linenumber")
    return lines.join(modal, (lines["l_suppkey"] == modal["l_suppkey"]) & (F.col("l_linenumber") == F.col("mode")), "left_semi")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * p_retailprice / 1000 + (p_size - 25), 6) AS calibrated FROM lineitem JOIN part ON p_partkey = l_partkey")
def calibrate_affine(spark, sf_dir):
    """raw * scale + offset, with scale and offset from a table of channels."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_retailprice") / 1000).alias("scale"), (F.col("p_size") - 25).alias("offset"))
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("raw"))
    return raw.join(parts, "l_partkey").select("l_orderkey", "l_linenumber", F.round(F.col("raw") * F.col("scale") + F.col("offset"), 6).alias("calibrated"))


@query("SELECT vec_id, (i % 4)::INT AS channel, (i // 4)::INT AS sample_idx, embedding[i + 1]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)")
def deinterleave_embeddings(spark, sf_dir):
    made = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return made.select("vec_id", F.pmod("pos", F.lit(4)).alias("channel"), F.floor(F.col("pos") / 4).cast("int").alias("sample_idx"), F.col("value").cast("double").alias("value"))


@query("SELECT vec_id, list_transform(list_reverse(embedding[5:12]), lambda x: x::DOUBLE) AS part, len(embedding)::INT AS n FROM embeddings")
def array_slice_reverse(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.reverse(F.slice("embedding", 5, 8)).cast("array<double>").alias("part"), F.size("embedding").alias("n"))


@query(f"""WITH {SQL}, d AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY channel ORDER BY sample_idx), 0) AS delta FROM s), r AS (SELECT *, sum(CASE WHEN sample_idx % 8 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY sample_idx) AS run FROM d)
SELECT channel, sample_idx, round(sum(delta) OVER (PARTITION BY channel, run ORDER BY sample_idx), 4) AS value FROM r""")
def keysample_cumsum(spark, sf_dir):
    """Sums of differences, restarted at every eighth sample."""
    s = samples(spark, sf_dir)
    delta = folds.previous(s, "channel", "sample_idx", F.col("value"), "before").withColumn("delta", F.col("value") - F.coalesce("before", F.lit(0.0)))
    return S.restarted_sum(delta, "channel", "sample_idx", F.col("delta"), F.col("sample_idx") % 8 == 0).select("channel", "sample_idx", F.round("value", 4).alias("value"))


@query(f"WITH {SQL} SELECT channel, sample_idx, round(value + 0.25 * (sample_idx + 1) + 3, 6) AS value FROM s")
def linear_retrend(spark, sf_dir):
    return samples(spark, sf_dir).select("channel", "sample_idx", F.round(F.col("value") + 0.25 * (F.col("sample_idx") + 1) + 3, 6).alias("value"))


@query(f"WITH {SQL} SELECT channel, sample_idx // 5 AS frame, value FROM s WHERE sample_idx % 5 = 0")
def subsample_every(spark, sf_dir):
    return samples(spark, sf_dir).where(F.col("sample_idx") % 5 == 0).select("channel", F.floor(F.col("sample_idx") / 5).alias("frame"), "value")


@query(f"""WITH RECURSIVE {SQL}, k AS (SELECT 2 * pi() * 45 / 250 AS w0), c AS (SELECT (1 - cos(w0)) / 2 / (1 + sin(w0) / sqrt(2)) AS b0, (1 - cos(w0)) / (1 + sin(w0) / sqrt(2)) AS b1, -2 * cos(w0) / (1 + sin(w0) / sqrt(2)) AS a1, (1 - sin(w0) / sqrt(2)) / (1 + sin(w0) / sqrt(2)) AS a2 FROM k),
r AS (SELECT channel, 0::BIGINT AS i, value AS w, 0::DOUBLE AS w1, 0::DOUBLE AS w2 FROM s WHERE sample_idx = 0
UNION ALL SELECT r.channel, r.i + 1, s.value - a1 * r.w - a2 * r.w1, r.w, r.w1 FROM r JOIN s ON s.channel = r.channel AND s.sample_idx = r.i + 1, c)
SELECT channel, i AS sample_idx, round(b0 * w + b1 * w1 + b0 * w2, 6) AS filtered FROM r, c""")
def biquad_single_pass(spark, sf_dir):
    return dsp.filtered(samples(spark, sf_dir), [dsp.design("lowpass", 250, 45)], both_ways=False).select("channel", "sample_idx", F.round("filtered", 6).alias("filtered"))


@query(f"""WITH RECURSIVE {SQL}, k AS (SELECT 2 * pi() * 45 / 250 AS w0), c AS (SELECT (1 - cos(w0)) / 2 / (1 + sin(w0) / sqrt(2)) AS b0, (1 - cos(w0)) / (1 + sin(w0) / sqrt(2)) AS b1, -2 * cos(w0) / (1 + sin(w0) / sqrt(2)) AS a1, (1 - sin(w0) / sqrt(2)) / (1 + sin(w0) / sqrt(2)) AS a2 FROM k),
r AS (SELECT channel, 0::BIGINT AS i, value AS w, 0::DOUBLE AS w1, 0::DOUBLE AS w2 FROM s WHERE sample_idx = 0
UNION ALL SELECT r.channel, r.i + 1, s.value - a1 * r.w - a2 * r.w1, r.w, r.w1 FROM r JOIN s ON s.channel = r.channel AND s.sample_idx = r.i + 1, c),
f AS (SELECT channel, count(*) OVER (PARTITION BY channel) - 1 - i AS i, b0 * w + b1 * w1 + b0 * w2 AS value FROM r, c),
q AS (SELECT channel, 0::BIGINT AS i, value AS w, 0::DOUBLE AS w1, 0::DOUBLE AS w2 FROM f WHERE i = 0
UNION ALL SELECT q.channel, q.i + 1, f.value - a1 * q.w - a2 * q.w1, q.w, q.w1 FROM q JOIN f ON f.channel = q.channel AND f.i = q.i + 1, c)
SELECT channel, count(*) OVER (PARTITION BY channel) - 1 - i AS sample_idx, round(b0 * w + b1 * w1 + b0 * w2, 5) AS filtered FROM q, c""")
def filtfilt_zero_phase(spark, sf_dir):
    return dsp.filtered(samples(spark, sf_dir), [dsp.design("lowpass", 250, 45)]).select("channel", "sample_idx", F.round("filtered", 5).alias("filtered"))


def _pass(source: str, name: str, kind: str, f: float, backwards: bool) -> str:
    """SQL of one pass over (channel, i, value): tables named after `name`."""
    w0, alpha = f"(2 * pi() * {f} / 250)", "/ sqrt(2)" if kind != "notch" else "/ 60"
    b0, b1 = {"highpass": ("(1 + cos(w0)) / 2", "-(1 + cos(w0))"), "lowpass": ("(1 - cos(w0)) / 2", "1 - cos(w0)"), "notch": ("1", "-2 * cos(w0)")}[kind]
    i = "count(*) OVER (PARTITION BY channel) - 1 - i" if backwards else "i"
    return f"""{name}k AS (SELECT ({b0}) / (1 + sin(w0) {alpha}) AS b0, ({b1}) / (1 + sin(w0) {alpha}) AS b1, -2 * cos(w0) / (1 + sin(w0) {alpha}) AS a1, (1 - sin(w0) {alpha}) / (1 + sin(w0) {alpha}) AS a2 FROM (SELECT {w0} AS w0)),
{name}i AS (SELECT channel, ({i})::BIGINT AS i, value FROM {source}),
{name}r AS (SELECT channel, 0::BIGINT AS i, value AS w, 0::DOUBLE AS w1, 0::DOUBLE AS w2 FROM {name}i WHERE i = 0
UNION ALL SELECT r.channel, r.i + 1, s.value - a1 * r.w - a2 * r.w1, r.w, r.w1 FROM {name}r r JOIN {name}i s ON s.channel = r.channel AND s.i = r.i + 1, {name}k),
{name} AS (SELECT channel, ({i})::BIGINT AS i, b0 * w + b1 * w1 + b0 * w2 AS value FROM {name}r, {name}k)"""


CHAIN = [("highpass", 1), ("notch", 60), ("lowpass", 45)]
_PASSES = [_pass(f"p{k}" if k else "z", f"p{k + 1}", *CHAIN[k // 2], k % 2 == 1) for k in range(6)]


@query(f"WITH RECURSIVE {SQL}, z AS (SELECT channel, sample_idx AS i, value FROM s), " + ", ".join(_PASSES) + " SELECT channel, i AS sample_idx, round(value, 5) AS filtered FROM p6")
def filter_chain(spark, sf_dir):
    """High-pass, notch and low-pass in turn, each without a shift of phase."""
    chain = [dsp.design(kind, 250, f) for kind, f in CHAIN]
    return dsp.filtered(samples(spark, sf_dir), chain).select("channel", "sample_idx", F.round("filtered", 5).alias("filtered"))


@query("""WITH p AS (SELECT DISTINCT user_id AS channel, 100.0 + user_id % 7 * 50 AS fs, 1.0 + user_id % 40 AS f FROM events), w AS (SELECT *, 2 * pi() * f / fs AS w0 FROM p), a AS (SELECT *, 1 + sin(w0) / sqrt(2) AS a0, 1 + sin(w0) / 60 AS n0 FROM w)
SELECT channel, round((1 + cos(w0)) / 2 / a0, 9) AS hp_b0, round(-(1 + cos(w0)) / a0, 9) AS hp_b1, round((1 - cos(w0)) / 2 / a0, 9) AS lp_b0, round(-2 * cos(w0) / a0, 9) AS a1, round((2 - a0) / a0, 9) AS a2, round(1 / n0, 9) AS notch_b0, round((2 - n0) / n0, 9) AS notch_a2 FROM a""")
def biquad_coefficients(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel")).distinct().withColumns({"fs": 100.0 + F.col("channel") % 7 * 50, "f": 1.0 + F.col("channel") % 40})
    hp, lp, nt = X.highpass(F.col("fs"), F.col("f")), X.lowpass(F.col("fs"), F.col("f")), X.notch(F.col("fs"), F.col("f"))
    r = lambda c, k, name: F.round(c[k], 9).alias(name)
    return p.withColumns({"hp": hp, "lp": lp, "nt": nt}).select("channel", r(F.col("hp"), "b0", "hp_b0"), r(F.col("hp"), "b1", "hp_b1"), r(F.col("lp"), "b0", "lp_b0"), r(F.col("lp"), "a1", "a1"), r(F.col("lp"), "a2", "a2"), r(F.col("nt"), "b0", "notch_b0"), r(F.col("nt"), "a2", "notch_a2"))


@query("""WITH w AS (SELECT DISTINCT user_id AS channel, (user_id % 50) / 4.0 AS t0, (user_id % 50) / 4.0 + 2.0 + user_id % 17 AS t1 FROM events),
st AS (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10, 30, 60]) AS x), s AS (SELECT w.*, coalesce(max(x), 0.01)::DOUBLE AS step FROM w LEFT JOIN st ON x <= (t1 - t0) / 7 GROUP BY ALL)
SELECT channel, step, round(k * step, 6) AS t FROM s, LATERAL (SELECT unnest(range(ceil(t0 / step)::BIGINT, floor((t1 + 1e-9) / step)::BIGINT + 1)) AS k)""")
def time_ticks(spark, sf_dir):
    """Ticks at multiples of the greatest nice step that is no more than a seventh of the window."""
    w = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel")).distinct().withColumn("t0", F.col("channel") % 50 / 4.0).withColumn("t1", F.col("t0") + 2.0 + F.col("channel") % 17)
    steps = F.array(*[F.lit(float(s)) for s in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1, 2, 5, 10, 30, 60)])
    stepped = w.withColumn("step", F.coalesce(F.array_max(F.filter(steps, lambda s: s <= (F.col("t1") - F.col("t0")) / 7)), F.lit(0.01)))
    k = F.explode(F.sequence(F.ceil(F.col("t0") / F.col("step")), F.floor((F.col("t1") + 1e-9) / F.col("step"))))
    return stepped.withColumn("k", k).select("channel", "step", F.round(F.col("k") * F.col("step"), 6).alias("t"))


@query(f"""WITH {SQL}, c AS (SELECT channel, round(stddev_pop(value), 6) AS sd FROM s GROUP BY channel), e AS (SELECT *, floor(log10(sd)) AS k FROM c WHERE sd > 0), f AS (SELECT *, sd / pow(10, k) AS f FROM e)
SELECT channel, sd, CASE WHEN f < 1.5 THEN 1 WHEN f < 3.5 THEN 2 WHEN f < 7.5 THEN 5 ELSE 10 END * pow(10.0, k) AS nice FROM f""")
def nice_round_scale(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("channel").agg(F.round(F.stddev_pop("value"), 6).alias("sd")).where("sd > 0").withColumn("nice", X.nice_round(F.col("sd")))


@query(f"""WITH {SQL}, m AS (SELECT channel, avg(value) AS m FROM s GROUP BY channel), d AS (SELECT channel, sample_idx, round(abs(value - m), 6) AS d FROM s JOIN m USING (channel))
SELECT channel, d AS most, sample_idx AS at FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY d DESC, sample_idx DESC) AS k FROM d) WHERE k = 1""")
def max_abs_diff(spark, sf_dir):
    """Largest difference from a reference, with its place; of equal ones the last."""
    s = samples(spark, sf_dir)
    d = s.join(s.groupBy("channel").agg(F.avg("value").alias("m")), "channel").withColumn("d", F.round(F.abs(F.col("value") - F.col("m")), 6))
    best = d.groupBy("channel").agg(F.max(F.struct("d", "sample_idx")).alias("b"))
    return best.select("channel", F.col("b.d").alias("most"), F.col("b.sample_idx").alias("at"))


@query("SELECT event_type, min(event_id) AS first_event, (dense_rank() OVER (ORDER BY min(event_id)) - 1)::INT % 3 AS palette FROM events GROUP BY event_type")
def types_in_order(spark, sf_dir):
    """Distinct types in the order they are met, with a palette entry dealt round; as many rows as types."""
    first = table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_event"))
    return first.withColumn("palette", (F.row_number().over(Window.orderBy("first_event")) - 1) % 3)


@query("SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) - l_quantity AS start FROM lineitem")
def buffer_starts(spark, sf_dir):
    """Start of each buffer: samples of the buffers before it."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.sum("l_quantity").over(w) - F.col("l_quantity")).alias("start"))


@query("SELECT label, min(embedding[1])::DOUBLE AS x0, max(embedding[1])::DOUBLE AS x1, min(embedding[2])::DOUBLE AS y0, max(embedding[2])::DOUBLE AS y1, round(max(sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2)), 6) AS radius FROM embeddings GROUP BY label")
def bounding_box(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return e.groupBy("label").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.round(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))), 6).alias("radius"))


@query(f"WITH {SQL} SELECT channel, sample_idx, value FROM (SELECT *, dense_rank() OVER (ORDER BY channel) - 1 AS row FROM s) WHERE row >= 16 AND row < 24")
def channel_page(spark, sf_dir):
    """The samples of one page of channels."""
    s = samples(spark, sf_dir)
    page = s.select("channel").distinct().orderBy("channel").offset(16).limit(8)
    return s.join(page, "channel", "left_semi").select("channel", "sample_idx", "value")


@query(f"WITH {SQL}, n AS (SELECT channel, count(*) AS n, max(abs(value)) AS most FROM s GROUP BY channel) SELECT channel, n, CASE WHEN n > 2 * 40 THEN 'decimated' ELSE 'polyline' END AS drawn, NOT isnan(most) AND most < 1e6 AS plausible FROM n")
def draw_mode(spark, sf_dir):
    n = samples(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("most"))
    return n.select("channel", "n", F.when(F.col("n") > 80, "decimated").otherwise("polyline").alias("drawn"), (~F.isnan("most") & (F.col("most") < 1e6)).alias("plausible"))
