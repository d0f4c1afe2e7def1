"""Queries for names, addresses, predicates and positions. The names are made from rows of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import bids as B
from tracelake.functions import checksums as K
from tracelake.functions import scalars as X
from tracelake.operators import audit as A
from tracelake.operators import chunked as C
from tracelake.operators import folds
from tracelake.operators import geometry as G
from tracelake.operators import viewing as V
from tracelake.plans.registry import query, table
from tracelake.plans.scalars import SCALE_SQL, decimals_sql
from tracelake.sources import catalog


def one(values, key: str):
    """An element of a list by a row's number."""
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


URLS = ["sub-1/meg/sub-1_task-a_meg.ds/sub-1_task-a_meg.meg4", "sub-1/meg/sub-1_task-a_meg.ds/sub-2_task-a_meg.meg4", "sub-2/ieeg/sub-2_ieeg.mefd/x.timd/a", "sub-3/meg/sub-3_run-1_meg/config", "sub-3/meg/sub-3_run-1_meg/c,rfDC", "sub-4/eeg/sub-4_task-b_eeg.SET", "demo/test.EDF", "demo/readme.txt", "sub-5/nirs/sub-5_nirs.snirf"]


@query(f"""WITH u AS (SELECT event_id, 'https://h/ds' || event_id % 3 || '/' || {URLS}[event_id % {len(URLS)} + 1] AS url FROM events), c AS (SELECT *, regexp_extract(url, '^(.*/)([^/]+)_(eeg|ieeg|emg|meg|nirs)\\.ds/([^/]+)_(eeg|ieeg|emg|meg|nirs)\\.meg4$', ['dir', 'prefix', 'suffix', 'inner', 'kind']) AS c,
regexp_extract(url, '^(.*/)([^/]+)_(eeg|ieeg|emg|meg|nirs)\\.mefd/', ['dir', 'prefix', 'suffix']) AS m, regexp_extract(url, '^(.*/)([^/]+)_(eeg|ieeg|emg|meg|nirs)/(config|c,rf[A-Za-z0-9.]+)$', ['dir', 'prefix', 'suffix']) AS b, regexp_extract(url, '^(.*/)([^/]+)_(eeg|ieeg|emg|meg|nirs)\\.([A-Za-z0-9+]+)$', ['dir', 'prefix', 'suffix', 'ext']) AS p,
regexp_extract(url, '^(.*/)([^/]+)\\.(edf|bdf|set|vhdr|fif|fiff|snirf|con|sqd|nwb|raw|kdf)$', ['dir', 'prefix', 'ext'], 'i') AS f FROM u),
r AS (SELECT event_id, CASE WHEN c.dir <> '' AND c.prefix = c.inner AND c.suffix = c.kind THEN struct_pack(dir := c.dir, prefix := c.prefix, suffix := c.suffix, ext := 'ds') WHEN m.dir <> '' THEN struct_pack(dir := m.dir, prefix := m.prefix, suffix := m.suffix, ext := 'mefd') WHEN b.dir <> '' THEN struct_pack(dir := b.dir, prefix := b.prefix, suffix := b.suffix, ext := 'bti') WHEN p.dir <> '' THEN struct_pack(dir := p.dir, prefix := p.prefix, suffix := p.suffix, ext := lower(p.ext)) WHEN f.dir <> '' THEN struct_pack(dir := f.dir, prefix := f.prefix, suffix := 'eeg', ext := lower(f.ext)) END AS r FROM c)
SELECT event_id, r.dir AS dir, r.prefix AS prefix, r.suffix AS suffix, r.ext AS ext FROM r""")
def recording_urls(spark, sf_dir):
    """URLs of recordings taken apart; bundles, canonical names and bare ones."""
    url = text("https://h/ds", F.col("event_id") % 3, "/", one(URLS, "event_id"))
    return table(spark, sf_dir, "events").select("event_id", B.recording_url(url).alias("r")).select("event_id", "r.dir", "r.prefix", "r.suffix", "r.ext")


@query("""WITH p AS (SELECT c_custkey, 'ds' || lpad((c_custkey % 50)::VARCHAR, 6, '0') AS ds, CASE WHEN c_custkey % 10 <> 9 THEN c_nationkey::VARCHAR END AS sub, CASE WHEN c_custkey % 2 = 0 THEN 's' || c_custkey % 4 END AS ses, CASE WHEN c_custkey % 3 <> 0 THEN 'rest' END AS task, CASE WHEN c_custkey % 5 = 0 THEN 'x' END AS acq, CASE c_custkey % 4 WHEN 0 THEN 'DS' WHEN 1 THEN 'edf' WHEN 2 THEN 'fif' END AS ext, CASE WHEN c_custkey % 3 = 1 THEN 'MEG' END AS suf FROM customer),
n AS (SELECT *, lower(coalesce(suf, 'eeg')) AS s, lower(coalesce(ext, 'set')) AS e FROM p), f AS (SELECT *, 'sub-' || sub || coalesce('_ses-' || ses, '') || coalesce('_task-' || task, '') || coalesce('_acq-' || acq, '') || '_' || s AS name FROM n)
SELECT c_custkey, ds || '/sub-' || sub || '/' || coalesce('ses-' || ses || '/', '') || s || '/' || CASE WHEN e = 'ds' THEN name || '.ds/' || name || '.meg4' ELSE name || '.' || e END AS path FROM f""")
def recording_paths(spark, sf_dir):
    """Paths of recordings built from their entities; null without a subject."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    made = B.recording_path(text("ds", F.lpad((k % 50).cast("string"), 6, "0")), F.when(k % 10 != 9, F.col("c_nationkey").cast("string")), F.when(k % 2 == 0, text("s", k % 4)), F.when(k % 3 != 0, "rest"), F.when(k % 5 == 0, "x"), none, F.when(k % 4 == 0, "DS").when(k % 4 == 1, "edf").when(k % 4 == 2, "fif"), F.when(k % 3 == 1, "MEG"))
    return p.select("c_custkey", made.alias("path"))


@query("""SELECT s_suppkey, s_nationkey % 4 = s_suppkey % 4 AND (s_suppkey % 3 <> 0 OR s_suppkey % 2 = s_nationkey % 2) AND s_suppkey % 7 <> 0 AS compatible FROM supplier""")
def entity_compatibility(spark, sf_dir):
    """Whether a sidecar's entities are all its recording's, a space apart."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    candidate = text("sub-", n % 4, F.when(k % 3 == 0, text("_ses-", n % 2)).otherwise(""), F.when(k % 7 == 0, "_acq-odd").otherwise(""), "_space-CapTrak_electrodes.tsv")
    context = text("sub-", k % 4, "_ses-", k % 2, "_task-rest_eeg.edf")
    return table(spark, sf_dir, "supplier").select("s_suppkey", B.compatible(X.entities(candidate), X.entities(context)).alias("compatible"))


ADDRESSES = ["https://a/b", "HTTP://a", "ftp://a", "//evil/x", "/rel/a", "data:text", "", "file.edf", "javascript:1", "a/b:c"]
NAMES = ["a.fdt", "../a.fdt", "b/c.fdt", "c\\\\d.fdt", "http:x", ".hidden", "", "good name.fdt"]


@query(f"""WITH e AS (SELECT event_id, {ADDRESSES}[event_id % {len(ADDRESSES)} + 1] AS url, {[n.replace(chr(92) * 2, chr(92)) for n in NAMES]}[event_id % {len(NAMES)} + 1] AS name, repeat('x', (event_id % 70)::INT) AS request, (event_id % 5 - 1) * 100 AS start, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 268435456 WHEN 2 THEN 268435457 ELSE 10 END AS n, event_id % 5000 AS channels, (event_id % 9) * 200000 AS points, event_id % 5 AS trials FROM events)
SELECT event_id, url <> '' AND NOT starts_with(url, '//') AND regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*):', 1) IN ('', 'http', 'https') AS protocol_ok, length(request) BETWEEN 1 AND 64 AS request_ok, start >= 0 AND n > 0 AND n <= 268435456 AS window_ok,
channels BETWEEN 1 AND 4096 AND points BETWEEN 1 AND 1073741824 AND trials BETWEEN 1 AND 4096 AND channels::DOUBLE * points * trials <= 1073741824 AS sizes_ok, name <> '' AND NOT contains(name, '/') AND NOT contains(name, chr(92)) AND NOT starts_with(name, '.') AND NOT regexp_matches(lower(name), '^[a-z]+:') AS companion_ok FROM e""")
def request_predicates(spark, sf_dir):
    """What is checked before anything is read."""
    k = F.col("event_id")
    n = F.when(k % 4 == 0, 0).when(k % 4 == 1, 268435456).when(k % 4 == 2, 268435457).otherwise(10)
    sizes = B.valid_sizes(k % 5000, (k % 9) * 200000, k % 5)
    return table(spark, sf_dir, "events").select("event_id", B.allowed_protocol(one(ADDRESSES, "event_id")).alias("protocol_ok"), B.valid_request_name(F.repeat(F.lit("x"), (k % 70).cast("int"))).alias("request_ok"), B.valid_window((k % 5 - 1) * 100, n).alias("window_ok"), sizes.alias("sizes_ok"), B.safe_companion(one([x.replace("\\\\", "\\") for x in NAMES], "event_id")).alias("companion_ok"))


FILES = ["sub-1_task-a_eeg.edf", "sub-1_task-a_eeg.fdt", "._sub-1_eeg.edf", "sub-1_eeg.json", "sub-1_meg.FIF", "electrodes.tsv", "sub-1_meg.meg4", "sub-1_eeg.vhdr", "notes.txt", "sub-1_ieeg.nwb", "sub-1_nirs.snirf", "sub-1_emg.kdf"]
READABLE_SQL = "(" + ", ".join(f"'{x}'" for x in B.READABLE) + ")"
EXT_SQL = f"CASE WHEN starts_with(name, '._') OR split_part(name, '.', -1) IN ('fdt', 'vmrk', 'eeg', 'json', 'tsv') THEN NULL WHEN lower(split_part(name, '.', -1)) = 'meg4' THEN 'ds' WHEN lower(split_part(name, '.', -1)) IN {READABLE_SQL} THEN lower(split_part(name, '.', -1)) END"


def _listed(spark, sf_dir: str):
    """(event_id, ds, name, key): keys of a bucket."""
    name = one(FILES, "event_id")
    e = table(spark, sf_dir, "events").select("event_id", text("ds", F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("ds"), name.alias("name"))
    return e.withColumn("key", text(F.col("ds"), "/sub-1/", F.col("event_id"), "/", F.col("name")))


LISTED = f"f AS (SELECT event_id, 'ds' || lpad(user_id::VARCHAR, 6, '0') AS ds, {FILES}[event_id % {len(FILES)} + 1] AS name FROM events), k AS (SELECT *, ds || '/sub-1/' || event_id || '/' || name AS key FROM f)"


@query(f"WITH {LISTED}, x AS (SELECT *, {EXT_SQL} AS ext FROM k) SELECT ds AS dataset_id, key, ext FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY key) AS n FROM x WHERE ext IS NOT NULL) WHERE n = 1")
def primary_files(spark, sf_dir):
    """Of each dataset's keys the first that is opened by itself."""
    return catalog.primaries(_listed(spark, sf_dir).select("key"))


@query(f"WITH {LISTED} SELECT event_id, regexp_matches(name, '_(eeg|ieeg|emg|meg|nirs)\\.(" + "|".join(B.READABLE) + ")$', 'i') AS recording FROM k")
def recording_names(spark, sf_dir):
    return _listed(spark, sf_dir).select("event_id", B.is_recording_name(F.col("name")).alias("recording"))


@query(f"WITH {LISTED}, r AS (SELECT *, regexp_matches(name, '_(eeg|ieeg|emg|meg|nirs)\\.(" + "|".join(B.READABLE) + ")$', 'i') AS ok FROM k) SELECT ds AS drop, min_by(name, event_id) FILTER (WHERE ok) AS picked, NOT bool_or(ok) AND bool_or(name LIKE '%.tsv') AS only_tables FROM r GROUP BY ds")
def dropped_files(spark, sf_dir):
    """What is opened of files dropped together."""
    return V.picked(_listed(spark, sf_dir).withColumn("drop", F.col("ds")), "drop", "name", "event_id")


@query(f"""WITH {LISTED}, x AS (SELECT *, {EXT_SQL} AS ext FROM k), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY key) AS n FROM x WHERE ext IS NOT NULL) WHERE n = 1), d AS (SELECT DISTINCT ds FROM k)
SELECT coalesce(ext, 'none') AS ext, CASE WHEN ext IS NULL THEN 'empty' ELSE 'loadable' END AS verdict, count(*) AS datasets FROM d LEFT JOIN p USING (ds) GROUP BY ALL""")
def bucket_enumeration(spark, sf_dir):
    """One recording of each dataset of a bucket, listed page by page, and how many there are of each kind."""
    keys = folds.numbered(_listed(spark, sf_dir), "ds", ["event_id"], "place").withColumn("page", F.floor(F.col("place") / 25))
    page = F.concat(F.lit("<ListBucketResult>"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<Contents><Key>"), "key", F.lit("</Key></Contents>")))), ""), F.lit("</ListBucketResult>"))
    pages = keys.groupBy("ds", "page").agg(page.alias("text")).select(F.concat_ws("/", "ds", "page").alias("path"), "text")
    return catalog.tallied(catalog.datasets(catalog.listed(pages)), catalog.primaries(catalog.listed(pages)))


@query("""WITH c AS (SELECT c_nationkey AS rec, upper(' ' || s_name) AS name, CASE c_custkey % 3 WHEN 0 THEN 'eeg' WHEN 1 THEN 'EMG' END AS type, s_suppkey, s_acctbal FROM customer JOIN supplier ON s_suppkey = c_custkey % 100 + 1)
SELECT rec, name, s_suppkey::DOUBLE AS x, s_acctbal AS y, 1.0::DOUBLE AS z FROM c WHERE coalesce(type, 'EEG') ILIKE 'EEG' AND rec % 5 <> 0""")
def template_positions(spark, sf_dir):
    """Positions of a template for channels of its names, where a recording has none of its own."""
    s = table(spark, sf_dir, "supplier")
    c = table(spark, sf_dir, "customer").withColumn("s_suppkey", F.col("c_custkey") % 100 + 1).join(s.select("s_suppkey", "s_name"), "s_suppkey")
    channels = c.select(F.col("c_nationkey").alias("rec"), F.upper(F.concat(F.lit(" "), "s_name")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "eeg").when(F.col("c_custkey") % 3 == 1, "EMG").alias("type"))
    montage = s.select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("double").alias("x"), F.col("s_acctbal").alias("y"), F.lit(1.0).alias("z"))
    return G.template_positions(channels, montage, channels.where("rec % 5 = 0").select("rec"), "rec")


@query("""SELECT s_nationkey AS tab, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'CTF' END, CASE WHEN s_nationkey % 2 = 0 THEN 'CapTrak' END, '') AS frame, count(*) AS n, list(s_name ORDER BY s_name) AS names FROM supplier GROUP BY ALL""")
def frame_groups(spark, sf_dir):
    """Sensors of each table by coordinate frame."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tab"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "CTF").otherwise("").alias("own"), F.when(F.col("s_nationkey") % 2 == 0, "CapTrak").alias("named"))
    return G.by_frame(s, "tab", "own", "named")


@query("""WITH s AS (SELECT s_nationkey AS n, count(*) FILTER (WHERE s_suppkey % 2 = 0) AS c, min_by(s_name, s_suppkey) FILTER (WHERE s_suppkey % 2 = 0) AS first, min('bad ' || s_suppkey) FILTER (WHERE s_suppkey % 9 = 0) AS error FROM supplier GROUP BY 1)
SELECT n_nationkey, coalesce(c > 0, false) OR error IS NOT NULL AS supplied, CASE WHEN error IS NULL THEN coalesce(c, 0) ELSE 0 END AS n_sets, CASE WHEN error IS NULL THEN first END AS source, error FROM nation LEFT JOIN s ON n = n_nationkey""")
def attached_coordinates(spark, sf_dir):
    """Recordings with their coordinate sets, or with the error that keeps them from having any."""
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    sets = s.where("s_suppkey % 2 = 0").select("n_nationkey", F.col("s_name").alias("source"), F.col("s_suppkey").alias("ordinal"))
    errors = s.where("s_suppkey % 9 = 0").select("n_nationkey", text("bad ", F.col("s_suppkey")).alias("message"))
    return G.attached(table(spark, sf_dir, "nation").select("n_nationkey"), sets, errors, "n_nationkey")


NICE = "CASE WHEN f < 1.5 THEN 1 WHEN f < 3.5 THEN 2 WHEN f < 7.5 THEN 5 ELSE 10 END * pow(10.0, k)"


@query(f"""WITH e AS (SELECT event_id, value - 20 AS slot, 10.0 + event_id % 40 AS h FROM events), n AS (SELECT *, CASE WHEN slot > 0 THEN floor(log10(slot * 0.5)) END AS k FROM e), g AS (SELECT *, slot * 0.5 / pow(10, k) AS f FROM n), u AS (SELECT *, {NICE} AS uv FROM g), p AS (SELECT *, uv / slot * h AS px FROM u)
SELECT event_id, CASE WHEN slot > 0 AND px >= 8 THEN round(uv, 6) END AS uv, CASE WHEN slot > 0 AND px >= 8 THEN round(px, 6) END AS px, CASE WHEN slot > 0 AND px >= 8 THEN round(388 - px, 6) END AS y_top FROM p""")
def scale_bars(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bar = X.scale_bar(F.col("value") - 20, 10.0 + F.col("event_id") % 40, F.lit(700), F.lit(0), F.lit(400))
    return e.select("event_id", bar.alias("b")).select("event_id", *[F.round(F.col("b")[c], 6).alias(c) for c in ("uv", "px", "y_top")])


@query(f"""WITH e AS (SELECT event_id, value AS v, (event_id % 16) * 0.25 AS gain, event_id % 900 - 40.0 AS x, event_id % 500 - 20.0 AS y, 64 + event_id % 3 AS ch, 1000 + event_id % 7 AS ns FROM events), s AS (SELECT *, greatest(0.0, least(800.0, x - 60)) / 800 AS share FROM e)
SELECT event_id, {decimals_sql('gain', 2)} || '×' || CASE WHEN v > 0 THEN ' (~' || {SCALE_SQL} || '/slot)' ELSE '' END AS gain, round(5 + share * ns / 250, 6) AS t, least(greatest(floor(greatest(0.0, least(400.0, y - 10)) / (400.0 / ch)), 0), ch - 1)::BIGINT AS channel, least(greatest(floor(share * (ns - 1) + 0.5), 0), ns - 1)::BIGINT AS sample FROM s""")
def cursor_readout(spark, sf_dir):
    """What stands beside the cursor: gain, time, channel and sample."""
    k = F.col("event_id")
    c = X.cursor(k % 900 - 40.0, k % 500 - 20.0, F.lit(60.0), F.lit(10.0), F.lit(800.0), F.lit(400.0), 64 + k % 3, 1000 + k % 7, F.lit(5.0), F.lit(250.0))
    made = table(spark, sf_dir, "events").select("event_id", X.gain_readout((k % 16) * 0.25, F.col("value")).alias("gain"), c.alias("c"))
    return made.select("event_id", "gain", F.round("c.t", 6).alias("t"), F.col("c.channel").cast("long").alias("channel"), F.col("c.sample").cast("long").alias("sample"))


@query("""WITH e AS (SELECT event_id, event_id % 9 + 1 AS i, CASE WHEN event_id % 5 <> 0 THEN event_id % 4 + 1 END AS src, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 + 1 END AS det, CASE WHEN event_id % 2 = 0 THEN 700 + (event_id % 100) * 1.25 END AS wl FROM events)
SELECT event_id, CASE WHEN src IS NOT NULL AND det IS NOT NULL THEN 'S' || src || 'D' || det || coalesce('-' || floor(wl + 0.5)::BIGINT || 'nm', '') ELSE 'Ch' || i END AS label FROM e""")
def optode_labels(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", B.optode_label(k % 9 + 1, F.when(k % 5 != 0, k % 4 + 1), F.when(k % 7 != 0, k % 3 + 1), F.when(k % 2 == 0, 700 + (k % 100) * 1.25)).alias("label"))


DTYPES = ["<f4", "f8", ">i2", "|u1", "=i4", "<i8", "!f4", "<f2", "u2", "S10"]


@query(f"""WITH e AS (SELECT event_id, {DTYPES}[event_id % {len(DTYPES)} + 1] AS d, event_id * 7 AS size, event_id % 5 AS unit FROM events), p AS (SELECT *, regexp_extract(d, '^([<>=!@|])?([iuf])([0-9]+)$', ['e', 'k', 'b']) AS p FROM e)
SELECT event_id, CASE WHEN p.e NOT IN ('>', '!') AND (p.k || p.b) IN ('f4', 'f8', 'i1', 'i2', 'i4', 'u1', 'u2', 'u4') THEN p.k END AS kind, CASE WHEN p.e NOT IN ('>', '!') AND (p.k || p.b) IN ('f4', 'f8', 'i1', 'i2', 'i4', 'u1', 'u2', 'u4') THEN TRY_CAST(p.b AS INT) END AS bytes,
CASE WHEN unit <= 0 THEN 'x: a record has no bytes' WHEN size % unit <> 0 THEN 'x: ' || size || ' bytes are no multiple of ' || unit END AS error FROM p""")
def stored_numbers(spark, sf_dir):
    """Number types of stored arrays, and sizes that whole records can't have."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", B.number_type(one(DTYPES, "event_id")).alias("t"), B.size_error(k * 7, k % 5, F.lit("x")).alias("error"))
    return e.select("event_id", "t.kind", "t.bytes", "error")


@query("""WITH e AS (SELECT vec_id, [1, 301, 2, 502][vec_id % 4 + 1] AS kind, CASE WHEN vec_id % 5 = 0 THEN 0 WHEN vec_id % 5 = 1 THEN 'nan'::DOUBLE ELSE embedding[1]::DOUBLE END AS x, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 1 END AS y FROM embeddings)
SELECT vec_id, CASE WHEN kind = 2 THEN 'EEG' ELSE 'MEG' END AS sensors, CASE kind WHEN 1 THEN 'MEG' WHEN 301 THEN 'MEGREF' ELSE 'EEG' END AS type, CASE WHEN kind = 2 THEN 'CapTrak' ELSE 'FIFF device' END AS space FROM e WHERE kind <> 502 AND NOT isnan(x) AND (x <> 0 OR y <> 0)""")
def fiff_sensors(spark, sf_dir):
    """Sensors of a FIFF channel table that have a place; reference coils are told apart so that they can be hidden."""
    k = F.col("vec_id")
    x = F.when(k % 5 == 0, 0.0).when(k % 5 == 1, float("nan")).otherwise(F.get("embedding", F.lit(0)).cast("double"))
    y = F.when(k % 5 == 0, 0.0).otherwise(1.0)
    e = table(spark, sf_dir, "embeddings").select("vec_id", B.fiff_sensor(one([1, 301, 2, 502], "vec_id"), x, y, F.lit(0.0)).alias("s")).where(F.col("s").isNotNull())
    return e.select("vec_id", "s.sensors", "s.type", "s.space")


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN (event_id % 5000) * 1000 + 250 END AS ms, CASE WHEN event_id % 3 = 0 THEN event_id END AS passed, CASE WHEN event_id % 3 = 0 THEN 50.5::DOUBLE END AS percent FROM events""")
def run_logs(spark, sf_dir):
    """Durations and headlines taken from logs and reports."""
    k = F.col("event_id")
    end = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + k % 5000), "yyyy-MM-dd'T'HH:mm:ss")
    log = text("x\nSTART ", F.date_format(F.timestamp_seconds(F.lit(1_700_000_000)), "yyyy-MM-dd'T'HH:mm:ss"), ".000Z\nmore\n", F.when(k % 4 == 3, "").otherwise(text("END ", end, ".250Z")), "\nlast")
    report = F.when(k % 3 == 0, text("# Report\n**", k, " of 900 datasets (50.5%) actually render**")).otherwise("nothing")
    made = table(spark, sf_dir, "events").select("event_id", B.run_seconds(log).alias("ms"), B.headline(report).alias("h"))
    return made.select("event_id", "ms", "h.passed", "h.percent")


@query("""WITH e AS (SELECT event_id, value, CASE WHEN event_id % 3 <> 0 THEN value END AS cursor, (event_id % 10) * 0.5 AS age, event_id % 4 = 0 AS active, CASE WHEN event_id % 5 <> 0 THEN event_id END AS ce, event_id + 1 AS we FROM events)
SELECT event_id, CASE WHEN cursor IS NOT NULL AND age < 2 THEN cursor ELSE 10 + 4 / 2.0 END::DOUBLE AS t, CASE WHEN active THEN ce ELSE we END AS shown FROM e""")
def synchronised_panels(spark, sf_dir):
    """The time that a pose panel shows, and the event that a stimulus panel shows."""
    k = F.col("event_id")
    t = V.shown_time(F.when(k % 3 != 0, F.col("value")), F.lit(100.0) - (k % 10) * 0.5, F.lit(100.0), F.lit(10.0), F.lit(4.0), 2.0)
    return table(spark, sf_dir, "events").select("event_id", t.alias("t"), V.shown_event(k % 4 == 0, F.when(k % 5 != 0, k), k + 1).alias("shown"))


@query("""SELECT event_id, upper(coalesce(CASE WHEN event_id % 4 > 0 THEN event_type END, '')) AS type, CASE WHEN event_id % 4 = 0 THEN 'grey' WHEN event_type = 'click' THEN 'red' END AS colour FROM events""")
def draw_options(spark, sf_dir):
    """Types and colours that channels are drawn with."""
    channels = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("type"))
    return V.draw_options(channels, spark.createDataFrame([("MISC", "grey"), ("CLICK", "red")], "type string, colour string"))


@query("""SELECT c_custkey, n_name AS channels_name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 2 END AS events_n, CASE WHEN n_name IS NOT NULL THEN 'n' || n_nationkey END AS channels_source, CASE WHEN c_custkey % 2 = 0 THEN 'e' || c_custkey END AS events_source FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 3 <> 0""")
def metadata_bundle(spark, sf_dir):
    """Recordings with all that was found for them and where."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0")
    channels = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", text("n", F.col("n_nationkey")).alias("url"), F.col("n_name").alias("name"))
    events = c.where("c_custkey % 2 = 0").select("c_custkey", text("e", F.col("c_custkey")).alias("url"), (F.col("c_custkey") * 2).alias("n"))
    made = V.bundle(c.select("c_custkey"), "c_custkey", channels=channels, events=events)
    return made.select("c_custkey", F.col("channels.name").alias("channels_name"), F.col("events.n").alias("events_n"), F.col("sources")["channels"].alias("channels_source"), F.col("sources")["events"].alias("events_source"))


@query(f"""WITH RECURSIVE r AS (SELECT b, 0 AS k, b::BIGINT AS v FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, {K.KOOPMAN}) ELSE v >> 1 END FROM r WHERE k < 8), c AS (SELECT list(v ORDER BY b) AS t FROM r WHERE k = 8)
SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda x: ascii(x)::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295) AS crc FROM part, c""")
def block_checksums(spark, sf_dir):
    """The checksum of recording blocks, over the bytes of names."""
    return table(spark, sf_dir, "part").select("p_partkey", K.block_checksum(F.encode("p_name", "UTF-8")).alias("crc"))


@query("""WITH b AS (SELECT p_brand, ascii(unnest(string_split(p_name, ''))) AS byte FROM part), c AS (SELECT p_brand, byte, count(*) AS n FROM b GROUP BY ALL) SELECT p_brand, byte::INT AS byte, n, sum(n) OVER (PARTITION BY p_brand ORDER BY byte)::BIGINT AS upto FROM c""")
def byte_statistics(spark, sf_dir):
    """How often each byte occurs, and how many stand before the next."""
    return K.byte_counts(table(spark, sf_dir, "part").select("p_brand", F.encode("p_name", "UTF-8").alias("data")), "p_brand", "data")


@query("""WITH s AS (SELECT l_orderkey AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem), c AS (SELECT a, 3 * (i // 3) AS row FROM s WHERE i % 3 = 0)
SELECT a AS "array", win::INT AS "window", row AS chunk FROM c, (SELECT unnest([0, 1, 2]) AS win) WHERE row + 3 > 2 * win AND row < 2 * win + 4""")
def chunk_windows(spark, sf_dir):
    """Windows of stored arrays with the chunks that they overlap."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("array")).agg(F.count("*").alias("n"))  # noqa: E741
    chunks = l.select("array", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"), F.lit(3))).alias("row"), F.lit(3).alias("rows"))
    windows = l.select("array", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("window")).withColumns({"start": F.col("window") * 2, "stop": F.col("window") * 2 + 4})
    return C.overlapping(chunks, windows, run=4).select("array", "window", F.col("row").cast("long").alias("chunk"))


@query(f"""WITH {LISTED}, m AS (SELECT ds, key, regexp_replace(name, '\\.[^.]*$', '') AS stem, event_id FROM k) SELECT ds AS dataset, key, list(o ORDER BY o) AS siblings FROM (SELECT a.ds, a.key, b.key AS o FROM m a JOIN m b ON a.ds = b.ds AND a.stem = b.stem AND a.key <> b.key) GROUP BY ALL""")
def manifest_siblings(spark, sf_dir):
    """Files of a manifest with those of the same stem beside them."""
    files = _listed(spark, sf_dir).select(F.col("ds").alias("dataset"), F.col("key"))
    return catalog.siblings(files, "dataset", "key")


@query("""SELECT o_custkey, o_orderkey, c_mktsegment AS source, CASE WHEN o_orderkey % 3 = 0 THEN 250.0 END::DOUBLE AS fs FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 2 = 0""")
def catalogue_lookup(spark, sf_dir):
    """Records of a catalogue for the recordings asked for."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    records = o.select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("path"), F.to_json(F.struct(F.when(F.col("o_orderkey") % 3 == 0, 250.0).alias("sampling_frequency"))).alias("record"))
    found = catalog.records(c.select(F.col("c_custkey").alias("dataset"), F.col("c_mktsegment").alias("source")), records)
    return found.select(F.col("dataset").alias("o_custkey"), F.col("path").alias("o_orderkey"), "source", "fs")


@query("""WITH e AS (SELECT event_id, event_id % 3000 AS ds, event_type, value FROM events), s AS (SELECT ds, count(*) AS n, count(*) FILTER (WHERE value > 60) AS ok, count(*) FILTER (WHERE event_type = 'click') AS gone FROM e GROUP BY ds), c AS (SELECT *, CASE WHEN ok > 0 THEN 'loadable' WHEN gone = n THEN 'empty' ELSE 'broken' END AS class FROM s)
SELECT class, count(*) AS datasets, round(count(*) / (SELECT count(*) FROM c), 6) AS share, round(sum(ok) / nullif(sum(n) - sum(gone), 0), 6) AS effective FROM c GROUP BY class""")
def catalogue_sample(spark, sf_dir):
    """Datasets by what came of their recordings, with the pass rate of those that had a chance."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("ds"), (F.col("value") > 60).alias("ok"), (F.col("event_type") == "click").alias("gone"))
    return A.catalogue(e, "ds", F.col("ok"), F.col("gone"))
