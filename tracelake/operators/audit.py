"""Relational pipelines over audit rows: union of shards, dedup, classes, tallies, reports and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(shards: list[DataFrame]) -> DataFrame:
    """Union of shards by name, with the place of each row's shard in column `shard`."""
    out = shards[0].withColumn("shard", F.lit(0))
    for i, s in enumerate(shards[1:], 1):
        out = out.unionByName(s.withColumn("shard", F.lit(i)), allowMissingColumns=True)
    return out


def deduplicated(rows: DataFrame, key: str, passed: Column, order: list[str]) -> DataFrame:
    """One row for each key: one that passed if there is any, else the first in order. An aggregate, so that a key with
    many rows is combined before the shuffle."""
    columns = rows.columns
    rank = F.struct((~passed).cast("int").alias("__bad"), *order)
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in columns if c != key]), rank).alias("__row")).select(key, "__row.*").select(columns)


def capped(rows: DataFrame, by: list[str], order: list[str], cap: int) -> DataFrame:
    """The first `cap` rows of each group."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= cap).drop("__k")


def rates(rows: DataFrame, by: list[str], hit: Column) -> DataFrame:
    n, hits = F.count("*"), F.sum(hit.cast("long"))
    return rows.groupBy(*by).agg(n.alias("n"), hits.alias("hits"), F.round(hits / n, 6).alias("rate"))


def rarest_first(rows: DataFrame, kind: str, order: list[Column | str], k: int) -> DataFrame:
    """The k rows of the rarest kinds."""
    frequency = rows.groupBy(kind).agg(F.count("*").alias("frequency"))
    return rows.join(frequency, kind).orderBy("frequency", kind, *order).limit(k)


def gated(current: DataFrame, baseline: DataFrame, metric: str, worst: dict[str, float], floor: float) -> DataFrame:
    """Metrics of a run against a baseline: a figure fails if it grew by more than its share and by more than `floor`."""
    both = current.join(baseline.select(metric, *[F.col(c).alias(f"base_{c}") for c in worst]), metric, "left")
    fails = F.lit(False)
    for c, share in worst.items():
        fails = fails | ((F.col(c) > F.col(f"base_{c}") * (1 + share)) & (F.col(c) - F.col(f"base_{c}") > floor))
    return both.withColumn("verdict", F.when(F.col(f"base_{next(iter(worst))}").isNull(), "new").when(fails, "regressed").otherwise("ok"))


def sampled(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows chosen by the hash of their key and a seed: repeatable, and the same for any order or partitioning."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), key).limit(k)


def stratified(rows: DataFrame, by: list[str], key: str, k: int, seed: int) -> DataFrame:
    """k rows of each group (all of a smaller one) with their rank, chosen as in sampled(). The ranks are limited before the
    shuffle: a task keeps k rows of a group at most, and these are put together, so a hot group is no more than that from each."""
    chance = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(chance, key))).where(F.col("rank") <= k)


def catalogue(rows: DataFrame, dataset: str, passed: Column, hopeless: Column) -> DataFrame:
    """(class, datasets, share, effective): datasets by what came of their rows: `loadable` if any passed, `empty` if none had a
    chance, else `broken`; each class with its share and the pass rate of rows that had a chance."""
    each = rows.groupBy(dataset).agg(F.count("*").alias("n"), F.sum(passed.cast("long")).alias("ok"), F.sum(hopeless.cast("long")).alias("gone"))
    named = each.withColumn("class", F.when(F.col("ok") > 0, "loadable").when(F.col("gone") == F.col("n"), "empty").otherwise("broken"))
    tried = F.sum("n") - F.sum("gone")
    made = named.groupBy("class").agg(F.count("*").alias("datasets"), F.round(F.sum("ok") / F.when(tried != 0, tried), 6).alias("effective"))
    total = named.agg(F.count("*").cast("double").alias("n")).scalar()
    return made.select("class", "datasets", F.round(F.col("datasets") / total, 6).alias("share"), "effective")


def report(rows: DataFrame, verdict: str, kind: str, ext: str, key: str, top: int = 10) -> DataFrame:
    """(section, key, n, percent) of an audit: `summary` by verdict, `bins` by class (null: pass), and `surprising`, the rows that passed
    or that no rule explains, of the rarest kinds of file first, passed ones before others, so many of them."""
    total = rows.agg(F.count("*").cast("double").alias("n")).scalar()
    counted = lambda section, by: rows.groupBy(by.alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), F.col("key").cast("string").alias("key"), "n", F.round(100.0 * F.col("n") / total, 1).alias("percent"))
    frequency = rows.groupBy(ext).agg(F.count("*").alias("__f"))
    odd = rows.where(F.col(kind).isNull() | (F.col(kind) == "unknown")).join(frequency, ext)
    first = odd.orderBy(F.col(kind).isNotNull(), "__f", ext, key).limit(top)
    numbered = first.withColumn("n", F.row_number().over(Window.orderBy(F.col(kind).isNotNull(), "__f", ext, key)).cast("long"))
    surprising = numbered.select(F.lit("surprising").alias("section"), F.col(key).cast("string").alias("key"), "n", F.lit(None).cast("double").alias("percent"))
    return counted("summary", F.col(verdict)).unionByName(counted("bins", F.coalesce(kind, F.lit("pass")))).unionByName(surprising)
