"""Line dedup by a log-template tree of fixed depth.

Every line is parsed down a tree: first by its number of tokens, then by its leading tokens; a token with a digit is a
variable field. Below the leaf, the rest of the line is cut into up to SEGMENTS runs of tokens, and the line belongs to one
template with all runs and to one for each run left open, so lines of one leaf that differ inside a single run, be it a
name, a price or a misspelling, share a template. The parse of a line depends on that line alone, so the tree needs no
order of arrival and is built in parallel. A template is recurring if it stands in at least MIN_DOCS documents; its
lines are dropped from all documents except the one of the smallest id. A line of LONG or more tokens that stands word for
word in two documents is a copy already.

Lines of fewer than OPEN tokens are only compared whole, for want of anything to hold the rest of the template. Lines end at
a line feed; blank lines stay.

Tokens are runs of other characters than ASCII's white space.

Defined results: null and empty texts stay as they are; a document of which every line is dropped keeps an empty text
in :func:`drop_lines`. Rows that repeat a doc_id are one document: it counts once, and if it is the first holder, all its rows
keep the line. Rows of a null doc_id are documents by their text, which come after all others. Other columns pass through;
n_chars, if there, follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import BROADCAST_ROWS, cut, held, slices, table, tidy

LEADING, SEGMENTS, MIN_DOCS, OPEN, LONG = 3, 5, 3, 5, 8
VARIABLE = b"<*>"
_DIGITS = frozenset(b"0123456789")


def templates(line: str) -> list[bytes]:
    """The templates of a line, spelled out: with all its runs, then with one run of tokens left open."""
    data = line.encode()
    tokens = data.split()  # bytes are split at ASCII's white space
    n = len(tokens)
    if not n:
        return []
    if not _DIGITS.isdisjoint(data):
        tokens = [t if _DIGITS.isdisjoint(t) else VARIABLE for t in tokens]
    whole = b"%d " % n + b" ".join(tokens)
    if n < OPEN:
        return [whole]
    leading = min(LEADING, n - LEADING)
    rest = n - leading
    runs = min(SEGMENTS, rest)
    made = [b" ".join(tokens[leading + rest * s // runs : leading + rest * (s + 1) // runs]) for s in range(runs)]
    path = b"%d " % n + b" ".join(tokens[:leading])
    return [whole, *(b" ".join([path, *made[:s], b"%b%d" % (VARIABLE, s), *made[s + 1 :]]) for s in range(runs))]


def literal(line: str) -> bytes | None:
    """The words of a long line as they are."""
    tokens = line.encode().split()
    return b" ".join(tokens) if len(tokens) >= LONG else None


def keys(line: str) -> list[int]:
    """Signed 64-bit hashes of the templates, and of the line itself if it is long; the latter are odd, all others even."""
    made = [xxhash.xxh64_intdigest(t) & ~1 for t in templates(line)]
    if (own := literal(line)) is not None:
        made.append(xxhash.xxh64_intdigest(own) | 1)
    return [h - (1 << 64) if h >> 63 else h for h in made]


def _anonymous() -> Column:
    """What tells rows of a null doc_id apart; null where there is an id."""
    return F.when(F.col("doc_id").isNull(), F.md5("text")).alias("anon")


def _parsed(docs: DataFrame) -> DataFrame:
    """(doc_id, anon, key): the distinct templates of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("line_dedup", dict)  # lets go of what other operators kept
        for batch in slices(batches):
            rows, found = [], []

            def made() -> pa.RecordBatch:
                at = pa.array(rows, pa.int32())  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.int64())], ["doc_id", "anon", "key"])  # noqa: B023

            for i, text in enumerate(batch.column(2).to_pylist()):
                own = {k for line in (text or "").split("\n") for k in keys(line)}
                rows += [i] * len(own)
                found += own
                if len(rows) >= 100_000:
                    yield made()
                    rows, found = [], []
            yield made()

    return docs.select(F.col("doc_id").cast("long"), _anonymous(), "text").mapInArrow(tidy(run), "doc_id long, anon string, key long")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, anon, keys): per document, its recurring templates, without those of which it is the first holder."""
    parsed = _parsed(docs)
    if docs.groupBy("doc_id", _anonymous()).count().where("count > 1").limit(1).count():
        parsed = parsed.distinct()
    parsed = cut(parsed)
    enough = F.when(F.pmod("key", F.lit(2)) == 1, min(2, min_docs)).otherwise(min_docs)
    counted = cut(parsed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min("anon").alias("first_anon")).where(F.col("n") >= enough))
    if counted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = parsed.join(F.broadcast(counted), "key")
    else:
        # templates that so many rows hold can't be more than BROADCAST_ROWS; the others have no hot key to shuffle
        hot = F.col("n") > counted.agg(F.sum("n")).first()[0] / BROADCAST_ROWS
        found = parsed.join(F.broadcast(counted.where(hot)), "key").unionByName(parsed.join(counted.where(~hot), "key"))
    is_first = F.coalesce(F.when(F.col("first").isNull(), F.col("anon") == F.col("first_anon")).otherwise(F.col("doc_id") == F.col("first")), F.lit(False))
    flagged = cut(found.where(~is_first).select("doc_id", "anon", "key"))
    return flagged.groupBy("doc_id", "anon").agg(F.collect_set("key").alias("keys"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the lines of recurring templates dropped from their texts."""
    columns = docs.columns
    found = recurring(docs, min_docs).select(F.col("doc_id").alias("__id"), F.col("anon").alias("__other"), F.col("keys").alias("__keys"))
    named = found.where("__id IS NOT NULL").drop("__other")
    marked = docs.join(named, docs["doc_id"] == named["__id"], "left").select(*columns, "__keys")
    if (bare := cut(found.where("__id IS NULL").drop("__id"))).limit(1).count():
        anonymous = docs.where("doc_id IS NULL")
        anonymous = anonymous.join(bare, F.md5(anonymous["text"]) == bare["__other"], "left").select(*columns, "__keys")
        marked = marked.where("doc_id IS NOT NULL").unionByName(anonymous)

    def kept(arrays: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held("line_dedup", dict)
        for texts, dropped in arrays:
            made = []
            for text, drop in zip(texts, dropped, strict=True):
                text = text.as_py()
                if text and drop.is_valid:
                    gone = set(drop.as_py())
                    text = "\n".join(line for line in text.split("\n") if gone.isdisjoint(keys(line)))
                made.append(text)
            yield pa.array(made, pa.string())

    kept.__annotations__ = {"arrays": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    # only the texts that lose a line go to Python
    some = F.col("__keys").isNotNull()
    made = marked.withColumn("__text", F.arrow_udf(kept, "string")(F.when(some, F.col("text")), "__keys"))
    made = made.withColumn("text", F.when(some, F.col("__text")).otherwise(F.col("text")))
    if "n_chars" in columns:
        made = made.withColumn("n_chars", F.when(some & F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return made.select(columns)


def keep_unrepeated(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """drop_lines, without the documents of which nothing is left though they had text."""
    before = F.length(F.trim(F.col("text"))) > 0
    return drop_lines(docs.withColumn("__had", F.coalesce(before, F.lit(False))), min_docs).where(~F.col("__had") | (F.length(F.trim(F.col("text"))) > 0)).select(docs.columns)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_kept, text): every document with its text as it is after dedup."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    kept = drop_lines(docs)
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return kept.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(lines).alias("n_kept"), "text")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN doc_id IS NULL THEN md5(text) END AS anon, text FROM documents),
l AS (SELECT r, doc_id, anon, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
t AS (SELECT r, doc_id, anon, i, line, list_filter(regexp_split_to_array(line, '[\t\n\v\f\r ]+'), lambda x: x <> '') AS raw FROM l),
m AS (SELECT r, doc_id, anon, i, len(raw) AS n, raw, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM t WHERE len(raw) > 0),
p AS (SELECT r, doc_id, anon, i, n, w, least(3, n - 3) AS lead, least(5, n - least(3, n - 3)) AS runs FROM m WHERE n >= 5),
s AS (SELECT r, doc_id, anon, i, n || ' ' || array_to_string(w[1:lead], ' ') AS path, runs AS many,
  list_transform(range(0, runs), lambda k: array_to_string(w[1 + lead + ((n - lead) * k) // runs : lead + ((n - lead) * (k + 1)) // runs], ' ')) AS runs FROM p),
k AS (SELECT r, doc_id, anon, i, n || ' ' || array_to_string(w, ' ') AS key, 3 AS least FROM m
  UNION ALL SELECT r, doc_id, anon, i, array_to_string(raw, ' ') || ' literally', 2 FROM m WHERE n >= 8
  UNION ALL SELECT r, doc_id, anon, i, path || ' ' || array_to_string(list_transform(range(0, many), lambda k: CASE WHEN k = o THEN '<*>' || o ELSE runs[k + 1] END), ' '), 3
  FROM s, range(0, 5) AS x(o) WHERE o < many),
c AS (SELECT key, least, min(doc_id) AS first, min(anon) AS first_anon FROM k GROUP BY key, least HAVING count(DISTINCT coalesce(doc_id::VARCHAR, anon)) >= least),
g AS (SELECT DISTINCT r, i FROM k JOIN c USING (key, least) WHERE CASE WHEN first IS NULL THEN anon <> first_anon ELSE doc_id IS DISTINCT FROM first END),
a AS (SELECT r, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN g USING (r, i) GROUP BY r)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::INT AS n_lines, (CASE WHEN coalesce(a.text, '') = '' THEN 0 ELSE n_kept END)::INT AS n_kept, CASE WHEN d.text IS NOT NULL THEN coalesce(a.text, '') END AS text
FROM d LEFT JOIN a USING (r)
"""
