"""Benchmark decontamination: short test items inside long documents, with DataFrame operations only.

Words are runs of letters and digits of the lower-cased text; an item's set is its distinct shingles of five words, or its
whole sequence as one shingle if it has fewer words; texts are cut into runs of such lengths too. Items are partitioned by set size. An item of q shingles keeps a MinHash sketch: its k smallest shingle hashes, where k comes
from the upper bound u of its size partition, k = floor((1 - t) * u) + 1. A document that contains at least the share t
of an item lacks at most floor((1 - t) * q) < k of its shingles, so it holds at least one hash of the sketch: the
candidate search loses nothing. Candidates are then verified by exact shingle containment.

Defined results: null texts and texts without words have no shingles and match nothing, as items too. An item of fewer than
five words is found where its words stand consecutively. Repeated rows of a document or an item count once. Rows of a null
doc_id or item_id are left out of :func:`leaks`, which names documents; :func:`decontaminate` judges each text of a null doc_id
by itself. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import cut, small, table

WORDS = 5
THRESHOLD = 0.8


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _starts(n: int) -> Column:
    """0-based starts of the runs of n of column words; empty where there are fewer words."""
    return F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))


def _hash(start: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(F.col("words"), start + k) for k in range(n)])


def _hashes(n: int) -> Column:
    return F.transform(_starts(n), lambda i: _hash(i, n))


def _runs(n: int) -> Column:
    """Every run of n of column words: spelled out, with its hash."""
    return F.transform(_starts(n), lambda i: F.struct(F.array_join(F.slice("words", i + 1, n), " ").alias("shingle"), _hash(i, n).alias("h")))


def hashed(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, h): hash of every run of so many words at every place."""
    worded = docs.where("doc_id IS NOT NULL").select("doc_id", words(F.col("text")).alias("words"))
    made = [_hashes(n) for n in lengths]
    return worded.select("doc_id", F.explode(F.concat(*made) if len(made) > 1 else made[0]).alias("h"))


def spelled(frame: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """(key, shingle, h): every run of so many words spelled out, with the hash that hashed() gives it."""
    worded = frame.select(key, words(F.col("text")).alias("words"))
    made = [_runs(n) for n in lengths]
    return worded.select(key, F.inline(F.concat(*made) if len(made) > 1 else made[0]))


def item_shingles(items: DataFrame, n: int) -> DataFrame:
    """(item_id, shingle, h) of items: runs of n words, or the whole item if it has fewer; and its number of words, n at most."""
    worded = items.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    made = _runs(n)
    for k in range(1, n):
        made = F.when(F.size("words") == k, _runs(k)).otherwise(made)
    return worded.select("item_id", F.least(F.size("words"), F.lit(n)).alias("length"), F.inline(made)).distinct()


def sketches(shingled: DataFrame, threshold: float) -> DataFrame:
    """(h, item_id): the sketch of each item, as long as its size partition asks for."""
    hashes = shingled.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    upper = F.pow(2, F.floor(F.log2(F.size("hs"))) + 1) - 1  # sizes 1, 2-3, 4-7, ... share a partition
    return hashes.select(F.explode(F.slice("hs", 1, (F.floor((1 - threshold) * upper + 1e-9) + 1).cast("int"))).alias("h"), "item_id")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of documents that contain the share `threshold` of an item."""
    shingled = cut(item_shingles(items, n))
    # which of the lengths 1 to n occur among the items
    lengths = sorted(r[0] for r in shingled.select("length").distinct().collect()) or [n]
    candidates = cut(hashed(docs, lengths).join(small(sketches(shingled, threshold)), "h").select("doc_id", "item_id").distinct())
    held = docs.join(small(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
    sizes = shingled.groupBy("item_id").agg(F.count_distinct("shingle").alias("n_item"))
    shared = spelled(held, "doc_id", lengths).join(small(shingled), ["h", "shingle"]).select("doc_id", "item_id", "shingle").distinct()
    counted = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared")).join(candidates, ["doc_id", "item_id"], "left_semi")
    found = counted.join(small(sizes), "item_id").where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
    return found.select("doc_id", "item_id", "n_item", "n_shared", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """docs without those that contain an item."""
    found = cut(leaks(docs, items, threshold, n).select("doc_id").distinct())
    kept = docs.join(small(found), "doc_id", "left_anti").select(docs.columns)
    unnamed = docs.where("doc_id IS NULL")
    if not unnamed.limit(1).count():
        return kept
    texts = unnamed.where("text IS NOT NULL").select(F.md5("text").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    found = cut(leaks(texts, items, threshold, n).select(F.col("doc_id").alias("__text")).distinct())
    unnamed = unnamed.join(small(found), F.md5("text") == F.col("__text"), "left_anti").select(docs.columns)
    return kept.where("doc_id IS NOT NULL").unionByName(unnamed)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
z AS (SELECT DISTINCT least(len(w), 5) AS z FROM iw WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, array_to_string(w[i:i+least(len(w), 5)-1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)),
sd AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+z-1], ' ') AS s FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM dw, z)),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM sd JOIN si USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM m JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n_item
"""
