"""Windows, reductions and decimation over samples (channel, sample_idx, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators import folds


def numbered(frame: DataFrame, channel: str, order: list[str], value: str) -> DataFrame:
    """(channel, sample_idx, value, ...): samples numbered from 0 in the order given. One shuffle, by channel and segment."""
    return folds.numbered(frame, channel, order, "sample_idx").withColumnsRenamed({channel: "channel", value: "value"})


def window(samples: DataFrame, start: int, n: int) -> DataFrame:
    """Samples of [start, start + n), clamped at 0; empty if nothing is left."""
    return samples.where((F.col("sample_idx") >= max(0, start)) & (F.col("sample_idx") < start + n))


def mean_std(samples: DataFrame, by: list[str | Column]) -> DataFrame:
    """n, mean and population deviation of each group; NaN and null values don't count."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return samples.groupBy(*by).agg(F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"))


def tumbling(samples: DataFrame, n: int) -> DataFrame:
    return samples.withColumn("window_idx", F.floor(F.col("sample_idx") / n))


def sliding(samples: DataFrame, n: int) -> DataFrame:
    """Windows of n samples, each half a window after the last: a sample is in up to two of them."""
    half = n // 2
    k = F.floor(F.col("sample_idx") / half)
    return samples.withColumn("window_idx", F.explode(F.filter(F.array(k - 1, k), lambda w: w >= 0)))


def decimated(samples: DataFrame, pixels: int) -> DataFrame:
    """(channel, pixel, lo, hi): least and greatest value of each of so many equal runs of a channel's samples.

    Run p holds samples [floor(p * n / P), floor((p + 1) * n / P)). A pixel without samples of its own, where there are
    fewer samples than pixels, repeats the sample that its run would begin with. NaN counts as a sample but has no value: a
    pixel of nothing else has null bounds. Each sample finds its pixels by itself, so one aggregate does for all.
    """
    sizes = samples.groupBy("channel").agg((F.max("sample_idx") + 1).alias("n"))
    i, n = F.col("sample_idx"), F.col("n")
    dense = F.floor(((i + 1) * pixels - 1) / n)
    # of fewer samples than pixels, sample i has the pixels p with floor(p * n / P) = i
    first, last = F.when(n < pixels, F.ceil(i * pixels / n)).otherwise(dense), F.when(n < pixels, F.ceil((i + 1) * pixels / n) - 1).otherwise(dense)
    placed = samples.join(sizes, "channel").select("channel", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("pixel"), F.when(~F.isnan("value"), F.col("value")).alias("value"))
    return placed.groupBy("channel", "pixel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


#: Share of a group within which percentile_approx finds a rank, and the margin around a rank that is counted exactly.
ACCURACY, MARGIN = 100_000, 5e-5


def ranked(frame: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles: the element min(n - 1, floor(n * q)) in order, exactly; nulls don't count.

    A sketch bounds each quantile from below and above; one aggregate counts what lies below the bound, another the values
    between the bounds, each distinct value once. Only those few are put in order, so no task sorts a group.
    """
    rows = frame.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    shares = [min(1.0, max(0.0, q + d)) for q in quantiles.values() for d in (-MARGIN, MARGIN)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"), F.percentile_approx("__v", shares, ACCURACY).alias("__bounds"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.get("__bounds", F.lit(2 * i)).alias("lo"), F.get("__bounds", F.lit(2 * i + 1)).alias("hi"), F.least(F.col("n") - 1, F.floor(F.col("n") * q)).alias("k")) for i, q in enumerate(quantiles.values())])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    bounded = rows.alias("a").join(sketch.select(*by, wanted.alias("__wanted")).alias("b"), same).select(*[F.col(f"a.{c}").alias(c) for c in by], "__v", "__wanted")
    below = bounded.groupBy(*by).agg(*[F.sum((F.col("__v") < F.get("__wanted", F.lit(i))["lo"]).cast("long")).alias(f"__b{i}") for i in range(len(quantiles))])
    between = bounded.select(*by, "__v", F.explode("__wanted").alias("w")).where((F.col("__v") >= F.col("w.lo")) & (F.col("__v") <= F.col("w.hi")))
    counted = between.groupBy(*by, "__v", F.col("w.i").alias("__i"), F.col("w.k").alias("__k")).agg(F.count("*").alias("__c"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"d.{c}")) for c in by]
    base = F.get(F.array(*[F.col(f"d.__b{i}") for i in range(len(quantiles))]), F.col("c.__i"))
    upto = F.sum("__c").over(Window.partitionBy(*by, "__i").orderBy("__v"))
    placed = counted.withColumn("__upto", upto).alias("c").join(below.alias("d"), same).where(base + F.col("c.__upto") > F.col("c.__k"))
    picked = placed.groupBy(*[F.col(f"c.{c}").alias(c) for c in by]).agg(*[F.min(F.when(F.col("c.__i") == i, F.col("c.__v"))).alias(name) for i, name in enumerate(quantiles)])
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by]
    return sketch.alias("e").join(picked.alias("f"), same).select(*[F.col(f"e.{c}").alias(c) for c in by], "n", "least", "most", *quantiles)


def mode_high(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value of each group; of equally frequent ones the greatest."""
    counted = frame.groupBy(*by, value).agg(F.count("*").alias("cnt"))
    return counted.groupBy(*by).agg(F.max_by(value, F.struct("cnt", value)).alias("mode"), F.max("cnt").alias("cnt"))


#: Two-sided 95 % points of Student's t by degrees of freedom 1 to 30. Fixed values.
T95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]


def ci95(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation, half width of the 95 % interval of the mean, least and most."""
    t = F.coalesce(F.get(F.array(*map(F.lit, T95)), (F.col("n") - 2).cast("int")), F.lit(1.96))
    made = frame.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    return made.withColumn("ci", F.when(F.col("n") < 2, 0.0).otherwise(t * F.col("std") / F.sqrt("n")))


restarted_sum, spaced = folds.restarted_sum, folds.spaced
