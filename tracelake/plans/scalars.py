"""Queries for the scalar, text, array and JSON functions of the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import scalars as X
from tracelake.plans.registry import query, table
from tracelake.sources import sidecars


def decimals_sql(x: str, places: int) -> str:
    """SQL of X.decimals: halves go up."""
    n = f"floor({x} * {10**places} + 0.5)::BIGINT"
    return f"((CASE WHEN {n} < 0 THEN '-' ELSE '' END) || abs({n}) // {10**places} || '.' || lpad((abs({n}) % {10**places})::VARCHAR, {places}, '0'))"


SCALE_SQL = f"CASE WHEN v < 1 THEN {decimals_sql('v', 2)} || ' µV' WHEN v < 1000 THEN floor(v + 0.5)::BIGINT || ' µV' ELSE {decimals_sql('(v / 1000)', 1)} || ' mV' END"


@query(f"WITH s AS (SELECT event_id, value * 3 - 100 AS v FROM events) SELECT event_id, {SCALE_SQL} AS label FROM s")
def format_scale_labels(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 3 - 100).alias("v"))
    return s.select("event_id", X.format_scale(F.col("v")).alias("label"))


@query("SELECT event_id, lpad((((event_id * 37) % 86400) // 3600)::VARCHAR, 2, '0') || ':' || lpad(((((event_id * 37) % 86400) % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((((event_id * 37) % 86400) % 60)::VARCHAR, 2, '0') AS clock, date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + date_part('second', ts)::INT AS second FROM events")
def clock_labels(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", X.hhmmss(F.col("event_id") * 37 + 0.0).alias("clock"), X.second_of_day(iso).cast("long").alias("second"))


@query("SELECT o_orderkey, CASE WHEN y < 85 THEN 2000 + y ELSE 1900 + y END || strftime(o_orderdate, '-%m-%dT%H:%M:%S') AS start FROM (SELECT o_orderkey, o_orderdate, (o_orderkey % 100)::INT AS y FROM orders)")
def edf_start_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    date = F.concat(F.date_format("o_orderdate", "dd.MM."), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    return o.select("o_orderkey", X.edf_start(date, F.date_format("o_orderdate", "HH.mm.ss")).alias("start"))


@query("SELECT event_id, CASE WHEN u > 0 AND u < 4102444800000000 THEN strftime(make_timestamp(u), '%Y-%m-%d %H:%M:%S') END AS start FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 WHEN event_id % 7 = 0 THEN 5102444800000000 ELSE event_id * 1000000 * 86400 // 10 END AS u FROM events)")
def micro_utc_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, -1).when(F.col("event_id") % 7 == 0, 5102444800000000).otherwise(F.floor(F.col("event_id") * 1000000 * 86400 / 10)).cast("long").alias("u"))
    return e.select("event_id", F.date_format(X.micro_utc(F.col("u")), "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' n/a ' WHEN 1 THEN '' WHEN 2 THEN value || ' uV' ELSE ' x' || value END AS cell, value FROM events) SELECT event_id, CASE WHEN event_id % 4 < 2 THEN NULL ELSE trim(cell) END AS text, CASE WHEN event_id % 4 = 2 THEN value END AS number FROM c")
def cell_parsing(spark, sf_dir):
    """Cells of a tab-separated file: n/a and empty are null; a number may have text behind it."""
    k = F.col("event_id") % 4
    cell = F.when(k == 0, " n/a ").when(k == 1, "").when(k == 2, F.concat(F.col("value").cast("string"), F.lit(" uV"))).otherwise(F.concat(F.lit(" x"), F.col("value").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", X.bids_cell(cell).alias("text"), X.float_prefix(cell).alias("number"))


@query("SELECT event_id, (CASE WHEN v < 0 THEN -floor(-v + 0.5) ELSE floor(v + 0.5) END)::BIGINT AS rounded, CASE WHEN b >= 8388608 THEN b - 16777216 ELSE b END::INT AS extended FROM (SELECT event_id, value - 50.5 AS v, (event_id * 7919) % 16777216 AS b FROM events)")
def codec_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", X.round_half_away(F.col("value") - 50.5).alias("rounded"), X.sign_extend24(F.col("event_id") * 7919 % 16777216).alias("extended"))


@query("WITH r AS (SELECT event_id, (event_id % 9 + 1) * (1 + (event_id % 4) * 0.004) AS ratio FROM events) SELECT event_id, CASE WHEN abs(ratio - 1) < 0.01 THEN 'ok' WHEN floor(ratio + 0.5) > 1 AND abs(ratio - floor(ratio + 0.5)) < 0.01 THEN 'epoched' ELSE 'mismatch' END AS class FROM r")
def duration_classes(spark, sf_dir):
    declared = (F.col("event_id") % 9 + 1) * (1 + (F.col("event_id") % 4) * 0.004)
    return table(spark, sf_dir, "events").select("event_id", X.duration_class(declared, F.lit(1.0)).alias("class"))


UNITS = ["uV", "mv", "Volts", "n/a", "fT", "µV", "MicroVolts", "millivolt", "arbitrary", "AU", "arb. units", "microV", " V"]


@query(f"""WITH u AS (SELECT event_id, CASE WHEN event_id % 14 < 13 THEN {UNITS}[event_id % 14 + 1] END AS raw FROM events), l AS (SELECT *, lower(raw) AS t FROM u)
SELECT event_id, CASE WHEN raw IS NULL THEN 'µV' WHEN t IN ('µv', 'uv', 'microv') OR t LIKE 'microvolt%' THEN 'µV' WHEN t = 'mv' OR t LIKE 'millivolt%' THEN 'mV' WHEN t = 'v' OR t LIKE 'volt%' THEN 'V' WHEN t = 'au' OR t LIKE 'arb%' THEN 'au' ELSE raw END AS unit, 'failed at step ' || event_id AS message FROM l""")
def units_and_messages(spark, sf_dir):
    units = F.get(F.array(*map(F.lit, UNITS)), (F.col("event_id") % 14).cast("int"))
    message = F.concat(F.lit("\x1b[31mfailed\x1b[0m   at\n step "), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.unit(units).alias("unit"), X.cleaned(message).alias("message"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS lang, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number, 'sub-' || page_id % 9 || '_ses-' || page_id % 4 || '_task-rest' AS prefix FROM pages""")
def url_entity_parse(spark, sf_dir):
    """Parts of a URL, and a prefix of entities taken apart and put together again."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    path = F.concat(F.lit("sub-"), (F.col("page_id") % 9).cast("string"), F.lit("/ses-"), (F.col("page_id") % 4).cast("string"), F.lit("/eeg/sub-"), (F.col("page_id") % 9).cast("string"), F.lit("_ses-x_task-rest_eeg.edf"))
    e = p.withColumn("e", X.entities(path))
    made = F.concat_ws("_", *[F.concat(F.lit(f"{k}-"), F.col("e")[k]) for k in ("sub", "ses", "task")])
    r = lambda pattern: F.regexp_extract("url", pattern, 1)
    return e.select("page_id", r("^([a-z]+)://").alias("scheme"), r("://([^/:?#]+)").alias("host"), r("/([a-z]{2})/[0-9]+").alias("lang"), r("/([0-9]+)").try_cast("long").alias("number"), made.alias("prefix"))


@query("""SELECT 'e' || event_id AS path, CASE WHEN event_id % 4 > 0 THEN (event_id % 4) * 250.0 END::DOUBLE AS fs, CASE WHEN event_id % 3 = 0 THEN value END AS duration, CASE WHEN event_id % 2 = 0 THEN event_type END AS reference, 50.0::DOUBLE AS line_frequency, (props::JSON ->> 'k')::BIGINT AS k FROM events""")
def json_sidecar(spark, sf_dir):
    """Typed fields of a JSON sidecar; an impossible rate is null, and fields that nobody named pass through."""
    e = table(spark, sf_dir, "events")
    rate = F.when(F.col("event_id") % 8 == 0, F.lit('"often"')).when(F.col("event_id") % 4 == 0, F.lit("-1")).otherwise((F.col("event_id") % 4 * 250).cast("string"))
    more = [F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "RecordingDuration": '), F.col("value").cast("string"))), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "EEGReference": "'), "event_type", F.lit('"')))]
    text = F.concat(F.lit('{"SamplingFrequency": '), rate, *[F.coalesce(m, F.lit("")) for m in more], F.lit(', "PowerLineFrequency": 50, "Other": '), "props", F.lit("}"))
    made = sidecars.recording_json(e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), text.alias("text")))
    return made.select("path", "fs", "duration", "reference", "line_frequency", F.try_variant_get("extra", "$.Other.k", "bigint").alias("k"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def listing_keys(spark, sf_dir):
    """Entries of a listing in markup."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


SPACES, LENGTHS = ["CTF", "eeglab", "EEGLAB-HJ", "KitYokogawa", "4DBti", "CapTrak", "false", "ctfx", "fctf", "ACPC"], ["m", "cm", "mm", "M"]


@query(f"""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, lower({SPACES}[vec_id % 10 + 1]) IN ('ctf', '4dbti', 'kityokogawa', 'eeglab', 'eeglab-hj') AS als, CASE vec_id % 4 WHEN 0 THEN 1000 WHEN 1 THEN 10 ELSE 1 END AS k FROM embeddings)
SELECT vec_id, round(CASE WHEN als THEN -b ELSE a END * k, 4) AS x, round(CASE WHEN als THEN a ELSE b END * k, 4) AS y, round(c * k, 4) AS z, round(a * 2 + 1, 6) AS hx, round(b * 2 + 2, 6) AS hy, round(c * 2 + 3, 6) AS hz FROM e""")
def coordinate_frames(spark, sf_dir):
    """Positions of several frames and units as RAS millimetres, and moved by a transform to the head."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    one = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("vec_id") % len(values)).cast("int"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("a"), at(1).alias("b"), at(2).alias("c"), one(SPACES).alias("space"), one(LENGTHS).alias("units"))
    shown = X.display_point(F.col("a"), F.col("b"), F.col("c"), F.col("space"), F.col("units"))
    m = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 1, 0, 2, 0, 2, 0, 0, 2, 3, 0, 0, 0, 1)])
    head = X.to_head(m, F.col("a"), F.col("b"), F.col("c"))
    return e.withColumns({"s": shown, "h": head}).select("vec_id", *[F.round(F.col("s")[k], 4).alias(k) for k in "xyz"], *[F.round(F.col("h")[k], 6).alias(f"h{k}") for k in "xyz"])


@query("WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), r AS (SELECT *, acos(greatest(least(c / sqrt(a * a + b * b + c * c), 1), -1)) / (pi() / 2) AS r FROM e) SELECT vec_id, round(r * cos(atan2(b, a)), 6) AS u, round(r * sin(atan2(b, a)), 6) AS v, round(a * cos(0.5) + c * sin(0.5), 6) AS px, round(b * sin(0.3) + (c * cos(0.5) - a * sin(0.5)) * cos(0.3), 6) AS depth FROM r")
def projections_3d(spark, sf_dir):
    """Scalp projection, and a turned view with depth."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))
    made = e.withColumns({"s": X.scalp_position(F.col("a"), F.col("b"), F.col("c")), "t": X.rotated(F.col("a"), F.col("b"), F.col("c"), 0.5, 0.3)})
    return made.select("vec_id", F.round("s.u", 6).alias("u"), F.round("s.v", 6).alias("v"), F.round("t.px", 6).alias("px"), F.round("t.depth", 6).alias("depth")).orderBy("depth")
