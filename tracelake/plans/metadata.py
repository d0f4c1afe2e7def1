"""Queries for metadata beside recordings, reports over audits, and small decisions of a viewer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracelake.functions import scalars as X
from tracelake.operators import audit as A
from tracelake.operators import folds
from tracelake.operators import geometry as G
from tracelake.operators import pose as P
from tracelake.operators import reports as R
from tracelake.plans.audit import AUDIT, CLASS, audit_rows, classed
from tracelake.plans.formats import _parts
from tracelake.plans.naming import text
from tracelake.plans.recordings import folder
from tracelake.plans.registry import query, table
from tracelake.sources import catalog, sidecars


def _dealt(rows, key: str):
    """rows over all tasks: a small file is few of them, whatever a row's work is."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


@query("SELECT event_id, greatest(0.0, least(60.0 - 10.0, value - 40))::DOUBLE AS start, greatest(0, least(20000 - 2500, event_id * 3 - 500))::BIGINT AS sample FROM events")
def viewport_clamp(spark, sf_dir):
    """Where a view of ten seconds may begin, in seconds and in samples."""
    return table(spark, sf_dir, "events").select("event_id", X.clamp(F.col("value") - 40, F.lit(0.0), F.lit(60.0) - 10.0).alias("start"), X.clamp(F.col("event_id") * 3 - 500, F.lit(0).cast("long"), F.lit(20000 - 2500).cast("long")).alias("sample"))


@query("""WITH e AS (SELECT event_id, event_id % 300 AS ch, CASE WHEN event_id % 7 <> 0 THEN (event_id % 11) * 100.0 END AS fs, CASE WHEN event_id % 2 = 0 THEN 2 END AS b FROM events), r AS (SELECT event_id, ch * fs * coalesce(b, 4) AS r FROM e)
SELECT event_id, (CASE WHEN r IS NULL OR r <= 0 THEN 10 WHEN r * 30 <= 1572864 THEN 30 WHEN r * 20 <= 1572864 THEN 20 WHEN r * 10 <= 1572864 THEN 10 WHEN r * 5 <= 1572864 THEN 5 ELSE 2 END)::INT AS seconds FROM r""")
def default_windows(spark, sf_dir):
    """The longest window on offer that stays within the budget of bytes."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", R.default_window(k % 300, F.when(k % 7 != 0, (k % 11) * 100.0), F.when(k % 2 == 0, 2)).cast("int").alias("seconds"))


@query(f"""WITH e AS (SELECT event_id, ((event_id % 97) / 4.0)::DOUBLE AS t0, ((event_id % 97) / 4.0)::DOUBLE + ([0.05, 0.4, 1.3, 6, 20, 90, 700]::DOUBLE[])[event_id % 7 + 1] AS t1, 100 + event_id % 900 AS w FROM events), s AS (SELECT unnest({X.STEPS}::DOUBLE[]) AS step, unnest(range({len(X.STEPS)})) AS i),
b AS (SELECT e.*, coalesce(max(i), 0) AS base FROM e LEFT JOIN s ON step <= (t1 - t0) / 7 GROUP BY ALL), c AS (SELECT b.*, s.i, s.step, ((t1 - t0) / s.step + 1) * 44 > w AND n.step IS NOT NULL AND n.step <= (t1 - t0) / 2 + 1e-9 AS crowded FROM b JOIN s ON s.i >= base LEFT JOIN s n ON n.i = s.i + 1),
f AS (SELECT event_id, t0, t1, min_by(step, i) AS step FROM c WHERE NOT crowded GROUP BY ALL)
SELECT event_id, step, greatest(0, floor((t1 + 1e-9) / step) - ceil(t0 / step) + 1)::INT AS n_major, round(ceil(t0 / step) * step, 6) AS first_major, (SELECT count(*) FROM range(ceil(t0 / (step / 5))::BIGINT, floor((t1 + 1e-9) / (step / 5))::BIGINT + 1) r(k) WHERE k % 5 <> 0)::INT AS n_minor FROM f""")
def axis_ticks(spark, sf_dir):
    """Major and minor ticks of time axes of several spans and widths."""
    k = F.col("event_id")
    t0 = (k % 97) / 4.0
    t1 = t0 + F.get(F.array(*[F.lit(float(v)) for v in (0.05, 0.4, 1.3, 6, 20, 90, 700)]), (k % 7).cast("int"))
    made = _dealt(table(spark, sf_dir, "events").select("event_id"), "event_id").select("event_id", t0.alias("t0"), X.time_axis(t0, t1, 100 + k % 900).alias("a"))
    return made.select("event_id", "a.step", F.size("a.major").alias("n_major"), F.round(F.ceil(F.col("t0") / F.col("a.step")) * F.col("a.step"), 6).alias("first_major"), F.size("a.minor").alias("n_minor"))


@query("""SELECT event_id, event_id // 250 AS record, event_id % 250 AS within, 256 * 5 + (event_id // 250) * 4 * 250 * 2 AS byte, (event_id * 3 + 500 - 1) // 250 - (event_id * 3) // 250 + 1 AS records FROM events""")
def record_layout(spark, sf_dir):
    """Record, place and byte of a sample, and how many records a window of 500 touches."""
    k = F.col("event_id")
    record = lambda i: F.floor(i / 250)
    return table(spark, sf_dir, "events").select("event_id", record(k).alias("record"), (k % 250).alias("within"), (256 * 5 + record(k) * 4 * 250 * 2).alias("byte"), (record(k * 3 + 499) - record(k * 3) + 1).alias("records"))


@query("SELECT event_id, length(split_part(id, '/', 1)) = 8 AND regexp_matches(id, '^(ds|nm|on|xx)[0-9]{6}$') AS ok FROM (SELECT event_id, ['ds', 'nm', 'on', 'xx', 'DS', 'zz'][event_id % 6 + 1] || lpad(event_id::VARCHAR, 6, '0') || CASE WHEN event_id % 5 = 0 THEN '/' ELSE '' END AS id FROM events)")
def dataset_ids(spark, sf_dir):
    k = F.col("event_id")
    made = text(F.get(F.array(*map(F.lit, ["ds", "nm", "on", "xx", "DS", "zz"])), (k % 6).cast("int")), F.lpad(k.cast("string"), 6, "0"), F.when(k % 5 == 0, "/").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", X.is_dataset_id(made).alias("ok"))


@query("""WITH l AS (SELECT user_id, event_type, max_by(event_id % 2 = 0, event_id) AS bad FROM events WHERE value > 50 GROUP BY ALL), f AS (SELECT user_id, event_type, min(event_id) % 3 = 0 AS bad FROM events GROUP BY ALL)
SELECT f.user_id, f.event_type, coalesce(l.bad, f.bad) AS bad FROM f LEFT JOIN l USING (user_id, event_type)""")
def flag_overlay(spark, sf_dir):
    """Marks of bad channels with a user's last edit on top."""
    e = table(spark, sf_dir, "events")
    flags = e.groupBy("user_id", "event_type").agg((F.min("event_id") % 3 == 0).alias("bad"))
    edits = e.where("value > 50").select("user_id", "event_type", F.col("event_id").alias("at"), (F.col("event_id") % 2 == 0).alias("bad"))
    return R.overlaid(flags, edits, ["user_id", "event_type"])


@query("""WITH r AS (SELECT 'u' || user_id AS path, event_type AS name, event_id % 10 <> 0 AS good, event_id AS x FROM events), g AS (SELECT path, count(*) FILTER (WHERE NOT good) AS skipped FROM r GROUP BY path), d AS (SELECT path, name, count(*) > 1 AS duplicate FROM r WHERE good GROUP BY ALL)
SELECT path, name, x::DOUBLE AS x, 'CTF' AS frame, duplicate, skipped FROM r JOIN g USING (path) JOIN d USING (path, name) WHERE good""")
def electrode_tables(spark, sf_dir):
    """Positions of electrodes; rows that aren't numbers are counted, names that stand twice are marked."""
    k = F.col("event_id")
    line = F.concat_ws("\t", "event_type", F.when(k % 10 == 0, "n/a").otherwise(k.cast("string")), F.lit("-1.5e-2"), F.lit("+.5"), F.lit("CTF"))
    return sidecars.electrodes(_parts(spark, sf_dir, line, "name\tx\ty\tz\tcoordinate_system\n", "\n")).select("path", "name", "x", F.col("coordinate_system").alias("frame"), "duplicate", "skipped")


@query("""SELECT 'e' || event_id AS path, CASE event_id % 3 WHEN 0 THEN 'CTF' WHEN 1 THEN 'CapTrak' ELSE 'Other' END AS system, CASE event_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'mm' ELSE 'n/a' END AS units FROM events""")
def coordinate_systems(spark, sf_dir):
    """Frame and units of coordinate files: those of the modality, else those of another."""
    k = F.col("event_id")
    json = F.when(k % 3 == 0, '{"MEGCoordinateSystem": "CTF", "MEGCoordinateUnits": "m", "EEGCoordinateSystem": "CapTrak", "EEGCoordinateUnits": "mm"}').when(k % 3 == 1, '{"EEGCoordinateSystem": "CapTrak", "EEGCoordinateUnits": "mm"}').otherwise("{}")
    return sidecars.coordinate_system(table(spark, sf_dir, "events").select(text("e", k).alias("path"), json.alias("text")), "MEG")


@query("""WITH c AS (SELECT c_custkey, 'sub-' || c_nationkey AS s, c_custkey % 2 = 0 AS e, CASE c_mktsegment WHEN 'MACHINERY' THEN 'run' ELSE lower(c_mktsegment) END AS t FROM customer),
v AS (SELECT c_custkey, CASE WHEN e THEN [s || '_ses-1_task-' || t || '_x.tsv', s || '_ses-1_x.tsv', 'ses-1_task-' || t || '_x.tsv', s || '_x.tsv', 'ses-1_x.tsv', 'x.tsv'] ELSE [s || '_task-' || t || '_x.tsv', s || '_x.tsv', 'task-' || t || '_x.tsv', 'x.tsv'] END AS names,
CASE WHEN e THEN ['d/' || s || '/ses-1/eeg', 'd/' || s || '/ses-1', 'd/' || s, 'd'] ELSE ['d/' || s || '/eeg', 'd/' || s, 'd'] END AS dirs FROM c)
SELECT c_custkey, flatten(list_transform(dirs, lambda d: list_transform(names, lambda x: d || '/' || x))) AS listed, names[1] AS named FROM v""")
def sidecar_candidates(spark, sf_dir):
    """Where a recording's sidecar may lie: most particular names first, with the subject and without, in its folder and those above."""
    task = F.when(F.col("c_mktsegment") == "MACHINERY", "run").otherwise(F.lower("c_mktsegment"))
    session = F.col("c_custkey") % 2 == 0
    path = text("d/sub-", F.col("c_nationkey"), F.when(session, "/ses-1").otherwise(""), "/eeg/sub-", F.col("c_nationkey"), F.when(session, "_ses-1").otherwise(""), "_task-", task, "_eeg.edf")
    made = sidecars.candidates(path, "x.tsv", 4)
    listed = _dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey").select("c_custkey", made.alias("listed"))
    return listed.select("c_custkey", "listed", F.substring_index(F.get("listed", F.lit(0)), "/", -1).alias("named"))


@query("""SELECT o_custkey AS dataset, 'f' || o_orderkey AS path, o_orderkey AS size FROM orders WHERE o_orderkey % 4 <> 1""")
def manifests(spark, sf_dir):
    """Entries of manifests, of ten entries each; those whose URL names another dataset are left out."""
    o = folds.numbered(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], "place").withColumn("part", F.floor(F.col("place") / 10))
    own = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    url = F.when(F.col("o_orderkey") % 4 == 0, text("https://h/f", F.col("o_orderkey"))).when(F.col("o_orderkey") % 4 == 1, "https://h/ds999999/f").otherwise(text("https://h/nm000001/f", F.col("o_orderkey")))
    entry = F.struct(text("f", F.col("o_orderkey")).alias("path"), F.col("o_orderkey").alias("size"), own.alias("checksum"), F.lit("md5").alias("checksum_algorithm"), url.alias("url"))
    files = o.groupBy("o_custkey", "part").agg(F.to_json(F.collect_list(entry)).alias("text"))
    found = sidecars.manifest(files, "nm000001")
    return found.select(F.col("checksum").cast("int").cast("long").alias("dataset"), "path", "size")


@query("""SELECT 'p' || s_suppkey AS path, 'sub-' || s_nationkey || '/' AS prefix, CASE WHEN s_suppkey % 3 = 0 THEN 't' || s_suppkey END AS token FROM supplier""")
def listing_pages(spark, sf_dir):
    """Folders that pages of a listing name, and where the listing goes on."""
    k = F.col("s_suppkey")
    page = text("<R><IsTruncated>", F.when(k % 3 == 0, "true").otherwise("false"), "</IsTruncated><CommonPrefixes><Prefix>sub-", F.col("s_nationkey"), "/</Prefix></CommonPrefixes>", F.when(k % 3 == 0, text("<NextContinuationToken>t", k, "</NextContinuationToken>")).otherwise(""), "</R>")
    pages = table(spark, sf_dir, "supplier").select(text("p", k).alias("path"), page.alias("text"))
    return catalog.prefixes(pages).join(catalog.next_page(pages), "path", "left")


@query(f"""WITH {AUDIT}, k AS (SELECT *, event_id % 3000 AS url FROM a), d AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY (verdict <> 'pass')::INT, event_id % 3, event_id) AS n FROM k) SELECT url, event_id, verdict FROM d WHERE n = 1""")
def merged_shards(spark, sf_dir):
    """Shards of an audit written as lines of JSON, read again, and one row of each address kept: one that passed, else the first."""
    where = folder(spark)
    rows = audit_rows(spark, sf_dir).withColumn("url", F.col("event_id") % 3000)
    for k in range(3):
        R.write_jsonl(rows.where(F.col("event_id") % 3 == k), f"{where}/shard{k}")
    read = [catalog.shards(spark, f"{where}/shard{k}", rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")) for k in range(3)]
    return A.deduplicated(A.merged(read), "url", F.col("verdict") == "pass", ["shard", "event_id"]).select("url", "event_id", "verdict").orderBy("url")


@query(f"""WITH {AUDIT}, c AS (SELECT *, {CLASS} AS class FROM a), n AS (SELECT count(*) AS n FROM c), f AS (SELECT ext, count(*) AS frequency FROM c GROUP BY ext),
b AS (SELECT coalesce(class, 'pass') AS key, count(*) AS k FROM c GROUP BY 1), o AS (SELECT event_id, row_number() OVER (ORDER BY (class IS NOT NULL)::INT, frequency, c.ext, event_id) AS r FROM c JOIN f USING (ext) WHERE class IS NULL OR class = 'unknown')
SELECT 'summary' AS section, verdict AS key, count(*) AS n, round(100.0 * count(*) / (SELECT n FROM n), 1) AS percent FROM c GROUP BY verdict
UNION ALL SELECT 'bins', key, k, round(100.0 * k / (SELECT n FROM n), 1) FROM b
UNION ALL SELECT 'surprising', event_id::VARCHAR, r, NULL FROM o WHERE r <= 10""")
def full_report(spark, sf_dir):
    """An audit in sections: verdicts, classes of failure, and the ten rows that surprise most."""
    rows = audit_rows(spark, sf_dir).withColumn("class", classed())
    return A.report(rows, "verdict", "class", "ext", "event_id")


@query("""WITH p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), r AS (SELECT label, vec_id, x * cos(0.5) + z * sin(0.5) AS px, y * cos(0.3) - (z * cos(0.5) - x * sin(0.5)) * sin(0.3) AS py FROM p),
b AS (SELECT label, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM r GROUP BY label), s AS (SELECT *, least((400 - 40) / (x1 - x0), (300 - 40) / (y1 - y0)) AS s FROM b WHERE x1 > x0 AND y1 > y0)
SELECT label, vec_id, round(200 + (px - (x0 + x1) / 2) * s, 4) AS u, round(150 - (py - (y0 + y1) / 2) * s, 4) AS v FROM r JOIN s USING (label)""")
def fitted_views(spark, sf_dir):
    """Points turned, projected and fitted into a picture of 400 by 300 pixels, by group."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    turned = table(spark, sf_dir, "embeddings").select("label", "vec_id", X.rotated(at(0), at(1), at(2), 0.5, 0.3).alias("r"))
    return G.fitted(turned.select("label", "vec_id", "r.px", "r.py"), "label", 400, 300, 20).select("label", "vec_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))

def _posed(vectors, key: str, values: str, joints: int, fs: float = 30.0):
    """(path, text): a sidecar for each vector, whose numbers in pairs are x and y of its joints, for as many frames as it has, with z 0. Every third
    key's second frame is marked as not valid, and every seventh key's numbers are cut short. Made in tasks, row by row."""

    def run(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, vectors in arrays:
            out = []
            for k, v in zip(keys.to_pylist(), vectors.to_pylist(), strict=True):
                xy = np.array(v, np.float32).reshape(-1, joints, 2)
                frames = len(xy)
                made = P.sidecar(np.concatenate([xy, np.zeros((frames, joints, 1), np.float32)], 2), fs, np.array([k % 3 != 0 or f != 1 for f in range(frames)]))
                if k % 7 == 0:
                    made["n_frames"] += 1
                out.append(json.dumps(made))
            yield pa.array(out, pa.string())

    run.__annotations__ = {"arrays": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return vectors.select(F.col(key).cast("string").alias("path"), F.arrow_udf(run, "string")(key, values).alias("text"))


@query("""SELECT vec_id AS pose, (i // 8)::INT AS frame, ((i % 8))::INT AS joint, embedding[i * 2 + 1]::FLOAT AS x, embedding[i * 2 + 2]::FLOAT AS y, vec_id % 3 <> 0 OR i // 8 <> 1 AS ok FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 2)) AS i FROM embeddings WHERE vec_id % 7 <> 0)""")
def pose_sidecars(spark, sf_dir):
    """Poses from sidecars in JSON with packed numbers, by frame and joint; a sidecar of another length is left out."""
    e = table(spark, sf_dir, "embeddings")
    return P.frames(_posed(e, "vec_id", "embedding", joints=8)).select(F.col("path").cast("long").alias("pose"), F.col("frame_idx").alias("frame"), F.col("joint_idx").alias("joint"), "x", "y", "ok")
