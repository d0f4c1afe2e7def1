"""Joins of the engine: nearest in time, interpolated, range, overlap, first match, best match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import folds
from tracelake.operators.shared import fixed


def nearest(points: DataFrame, events: DataFrame, by: str, t: str, onset: str, ordinal: str, keep: list[str]) -> DataFrame:
    """Each point with the event of its group that is nearest in time; of equally near ones the first by ordinal.

    Points and events are interleaved in one sort by (group, time): the last event at or before a point and the first at
    or after it are running values, so no pair of rows is formed. One shuffle, by group; a hot group is cut in time.
    """
    event = F.struct(onset, ordinal, *keep)
    kind = points.withColumns({"__t": F.col(t), "__p": F.lit(True)}).unionByName(events.groupBy(by, onset).agg(F.min_by(event, ordinal).alias("__e")).select(by, F.col(onset).alias("__t"), "__e", F.lit(False).alias("__p")), allowMissingColumns=True)
    both = folds.around(kind, by, "__t", "__p", "__e").where("__p")
    gap = lambda e: F.abs(e[onset] - F.col(t))
    b, a = F.col("__b"), F.col("__a")
    best = F.when(a.isNull() | (gap(b) < gap(a)) | ((gap(b) == gap(a)) & (b[ordinal] <= a[ordinal])), b).otherwise(a)
    return both.withColumn("__best", best).select(*points.columns, *[F.col("__best")[k].alias(f"event_{k}") for k in (onset, ordinal, *keep)])


def interpolated(points: DataFrame, frames: DataFrame, by: str, t: str, fs: float, frame: str, value: str, valid: str) -> DataFrame:
    """Each point with the value at its time between frames floor(t * fs) and the next, clamped at the last frame; null if
    a frame that is needed isn't valid."""
    last = frames.groupBy(by).agg(F.max(frame).alias("__last"))
    placed = points.join(last, by).withColumn("__pos", F.greatest(F.lit(0.0), F.least(F.col(t) * fs, F.col("__last").cast("double")))).withColumn("__k", F.floor("__pos"))
    side = lambda n: frames.select(by, (F.col(frame) - n).alias("__k"), F.col(value).alias(f"__v{n}"), F.col(valid).alias(f"__ok{n}"))
    both = placed.join(side(0), [by, "__k"], "left").join(side(1), [by, "__k"], "left")
    u = F.col("__pos") - F.col("__k")
    made = F.when(~F.col("__ok0"), None).when(u == 0, F.col("__v0")).when(F.col("__ok1"), F.col("__v0") * (1 - u) + F.col("__v1") * u)
    return both.withColumn("value", made).select(*points.columns, "value")


def in_blocks(samples: DataFrame, blocks: DataFrame, by: str, sample: str, start: str, size: str, keep: list[str], width: int) -> DataFrame:
    """Each sample with the block that holds it, start <= sample < start + size.

    Blocks are listed under every run of `width` samples that they touch, so the join is on equal keys.
    """
    run = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(start) + F.col(size) - 1) / width)))
    listed = blocks.where(F.col(size) > 0).withColumn("__run", run)
    joined = samples.withColumn("__run", F.floor(F.col(sample) / width)).join(listed, [by, "__run"])
    return joined.where((F.col(sample) >= F.col(start)) & (F.col(sample) < F.col(start) + F.col(size))).select(*samples.columns, *keep)


def overlapping(left: DataFrame, right: DataFrame, by: str, a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open intervals of a group that overlap, with the bounds of what they share.

    Intervals are listed under every run of `width` that they touch; a pair is formed under the first run they share.
    """
    runs = lambda frame, ends: frame.where(F.col(ends[0]) < F.col(ends[1])).withColumn("__run", F.explode(F.sequence(F.floor(F.col(ends[0]) / width), F.floor((F.col(ends[1]) - 1) / width))))
    pairs = runs(left, a).join(runs(right, b), [by, "__run"])
    low, high = F.greatest(F.col(a[0]), F.col(b[0])), F.least(F.col(a[1]), F.col(b[1]))
    return pairs.where((low < high) & (F.floor(low / width) == F.col("__run"))).withColumns({"from": low, "to": high}).drop("__run")


def first_match(targets: DataFrame, candidates: Column, files: DataFrame, key: str) -> DataFrame:
    """Each target with the first of its candidate keys, in order, that files has. candidates: an array of keys."""
    listed = targets.select("*", F.posexplode(candidates).alias("level", key))
    found = listed.join(files, key)
    return found.groupBy(*targets.columns).agg(F.min_by(F.struct(key, "level", *[c for c in files.columns if c != key]), "level").alias("hit"))


def suffix_matched(keys: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """Rows of keys and names where the key is the name or ends in a slash and the name. A key is listed under each of its endings
    that begins after a slash, with as many parts as any name has, so the join is on equal endings."""
    parts = F.split(F.col(key), "/", -1)
    most = names.agg(F.max(F.size(F.split(F.col(name), "/", -1)))).scalar()
    endings = F.transform(F.sequence(F.lit(1), F.col("__most")), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))
    listed = keys.withColumn("__most", F.least(F.size(parts), most)).withColumn("__end", F.explode(endings)).drop("__most")
    return listed.join(names, F.col("__end") == F.col(name)).drop("__end")


#: Rows of matches that are sent to all tasks.
FEW = 200_000


def best_suffixes(keys: DataFrame, ident: str, key: str, names: DataFrame, name: str, by: str, rank: str) -> DataFrame:
    """(by, ident, rank, name): for each `by` and ident, of the names that suffix_matched finds for the ident's keys the one of least rank, then name.

    Names are found once for all idents that have the same keys, and the best is chosen there; what was chosen, if it is few rows by a
    count, then goes to the idents where they are, so that no ident's matches are shuffled or sorted."""
    own = keys.where(F.col(key).isNotNull()).groupBy(ident).agg(F.sort_array(F.collect_set(key)).alias("__keys"))
    listed = own.select("__keys").distinct().withColumn(key, F.explode("__keys"))
    best = suffix_matched(listed, key, names, name).groupBy("__keys", by).agg(F.min(F.struct(rank, name)).alias("best"))
    best = fixed(best.select("__keys", by, "best.*"))
    few = best.limit(FEW + 1).count() <= FEW
    return own.join(F.broadcast(best) if few else best, "__keys").select(by, ident, rank, name)


def last_wins(frame: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with the same key, the last in order."""
    rows = frame.withColumn("__key", key)
    return rows.groupBy("__key").agg(F.max_by(F.struct(*frame.columns), order).alias("row")).select("__key", "row.*")


def best_scored(pairs: DataFrame, by: list[str], score: Column, pick: str) -> DataFrame:
    """The best-scored candidate of each group; `ambiguous` where several share the best score."""
    scored = pairs.withColumn("__score", score)
    top = scored.withColumn("__rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("__score")))).where("__rank = 1")
    return top.groupBy(*by).agg(F.max("__score").alias("score"), F.min(pick).alias(pick), (F.count("*") > 1).alias("ambiguous"))


def skinned(weights: DataFrame, bones: DataFrame, rest: DataFrame) -> DataFrame:
    """(frame, vertex, x, y, z): linear blend of each vertex over the affine frames of its bones.

    weights (vertex, bone, w); bones (frame, bone, m: 12 numbers, row by row); rest (vertex, x, y, z).
    """
    m = lambda i: F.get("m", F.lit(i))
    row = lambda r: F.col("w") * (m(4 * r) * F.col("x") + m(4 * r + 1) * F.col("y") + m(4 * r + 2) * F.col("z") + m(4 * r + 3))
    joined = weights.join(rest, "vertex").join(bones, "bone")
    return joined.groupBy("frame", "vertex").agg(F.sum(row(0)).alias("x"), F.sum(row(1)).alias("y"), F.sum(row(2)).alias("z"))
