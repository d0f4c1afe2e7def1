"""Queries for arrays stored as filtered chunks under an index: events of a type are an array of rows (value, event_id)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracelake.operators import blockcodec
from tracelake.operators import chunked as C
from tracelake.operators import folds
from tracelake.operators.shared import fixed
from tracelake.plans.registry import query, table

ROWS, FILTERS, FANOUT = 64, [C.SHUFFLE, C.DEFLATE, C.FLETCHER], 8
SQL = """s AS (SELECT event_type AS a, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS r, value, event_id FROM events), n AS (SELECT a, count(*) AS n FROM s GROUP BY a)"""
#: Windows of an array of n rows: first row and rows.
WINDOWS = [("0", "n // 3"), ("n // 2", "200"), ("n - 50", "100"), ("n + 5", "10")]


def chunks(spark, sf_dir):
    """(array, row, rows, address, bytes): the chunks of each array, filtered, the last one filled up with zeros."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    rows = folds.numbered(e, "event_type", ["ts", "event_id"], "row").withColumn("chunk", F.floor(F.col("row") / ROWS).cast("long"))

    def pack(part: pa.Table) -> pa.Table:
        x, at = np.zeros((ROWS, 2)), part.column("row").to_numpy() % ROWS
        x[at, 0], x[at, 1] = part.column("value").to_numpy(), part.column("event_id").to_numpy()
        chunk = part.column("chunk")[0].as_py()
        return pa.table({"array": [part.column("event_type")[0].as_py()], "row": [chunk * ROWS], "rows": [ROWS], "address": [chunk], "bytes": [C.filtered(x.astype("<f8").tobytes(), FILTERS, 8)]})

    return fixed(rows.groupBy("event_type", "chunk").applyInArrow(pack, "array string, row long, rows long, address long, bytes binary"))


def windows(spark, sf_dir):
    """(array, window, start, stop): windows of each array, cut at its end."""
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("array")).agg(F.count("*").alias("n"))
    asked = F.array(*[F.struct(F.lit(k).cast("long").alias("window"), F.expr(a.replace("//", "div")).alias("start"), F.expr(f"{a.replace('//', 'div')} + {m.replace('//', 'div')}").alias("stop")) for k, (a, m) in enumerate(WINDOWS)])
    return n.select("array", "n", F.inline(asked)).select("array", "window", "start", F.least("stop", "n").alias("stop"))


@query(f"WITH {SQL}, w AS (" + " UNION ALL ".join(f"SELECT a, {k} AS w, {a} AS low, least({a} + {m}, n) AS high FROM n" for k, (a, m) in enumerate(WINDOWS)) + """)
SELECT w.a AS "array", w::BIGINT AS "window", r::BIGINT AS "row", c::INT AS "column", CASE c WHEN 0 THEN value ELSE event_id END::DOUBLE AS value FROM w JOIN s ON s.a = w.a AND r >= low AND r < high, (SELECT unnest([0, 1]) AS c)""")
def indexed_windows(spark, sf_dir):
    """Windows of arrays: down the index to the chunks that they overlap, and the values of these."""
    stored = chunks(spark, sf_dir)
    nodes, roots = C.indexed(stored, FANOUT)
    found, _ = C.walked(windows(spark, sf_dir), nodes, roots)
    pairs = found.join(stored.select("array", "address", "bytes"), ["array", "address"])
    return C.values(pairs, "<f8", 2, FILTERS, keep=("array", "window"))


BLOCK = 250
BLOCKS_SQL = f"s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, floor(value)::BIGINT AS v FROM events), b AS (SELECT event_type || '-' || (k // {BLOCK}) AS block, (k // {BLOCK}) % 7 = 3 AS spoilt, k % {BLOCK} AS sample_idx, v FROM s)"


@query(f"WITH {BLOCKS_SQL} SELECT block, sample_idx, v AS value, NULL AS error FROM b WHERE NOT spoilt UNION ALL SELECT DISTINCT block, NULL, NULL, 'checksum' FROM b WHERE spoilt")
def coded_blocks(spark, sf_dir):
    """Samples coded in blocks of differences and decoded again, many blocks in step; of each type the fourth of seven blocks is spoilt."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", F.floor("value").alias("v"))
    rows = folds.numbered(e, "event_type", ["ts", "event_id"], "k").withColumn("block", F.floor(F.col("k") / BLOCK).cast("long"))

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("k")
        n = part.column("block")[0].as_py()
        made = bytearray(blockcodec.encode(part.column("v").to_numpy(), start=n))
        made[-1] ^= n % 7 == 3
        return pa.table({"block": [f"{part.column('event_type')[0].as_py()}-{n}"], "bytes": [bytes(made)]})

    blocks = rows.groupBy("event_type", "block").applyInArrow(pack, "block string, bytes binary")
    return blockcodec.decoded(blocks, "block", "bytes")
