"""Ordered folds that split a hot group: numbers, previous values, restarted sums, nearest events, spacing.

A group of more than SPLIT rows is cut into up to SEGMENTS segments at quantiles of its order, so that each is a task's work.
A fold then takes two passes: one row of each segment says what the segment does to the value that is carried, these few rows
are put together in order, and each segment goes on from what came before it. What a segment does is small for each fold:
its rows (numbering), its last value (previous), the sum since its last restart (restarted sums), its first and last event
(nearest), and for greedy spacing which mark it ends at for each mark that may be the first it keeps.

The quantiles are written down before they are used, so that all passes cut alike. Rows of one group that are equal in the
first column of the order stay in one segment. Smaller groups are one segment each, and cost no pass: if there is no hot
group the plans are plain windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.shared import fixed

#: Rows above which a group is cut, and the square root of the number of its segments.
SPLIT, SIDE = 2_000_000, 32
SEG = "__seg"


def segmented(frame: DataFrame, by: str, order: str) -> tuple[DataFrame, bool]:
    """frame with the segment of each row (-1 in groups that aren't cut), and whether any group is cut."""
    hot = frame.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n")).where(F.col("__n") > SPLIT)
    if not hot.limit(1).count():
        return frame.withColumn(SEG, F.lit(-1)), False
    hot = fixed(hot.select("__by"))
    t = F.col(order).cast("double")
    shares = [k / SIDE**2 for k in range(1, SIDE**2)]
    same = F.col(by).eqNullSafe(F.col("__by"))
    cuts = frame.select(by, t.alias("__t")).join(hot, same).groupBy("__by").agg(F.percentile_approx("__t", shares, 10 * SIDE**2).alias("__cuts"))
    # two levels, so that a row is compared with 2 * SIDE cuts
    level = F.transform(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda k: F.element_at("__cuts", k * SIDE))
    inner = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: F.slice("__cuts", k * SIDE + 1, SIDE - 1))
    cuts = fixed(cuts.select("__by", level.alias("__outer"), inner.alias("__inner")))
    upto = lambda cells: F.size(F.filter(cells, lambda c: c <= t))
    placed = frame.join(cuts, same, "left").withColumn("__k", upto(F.col("__outer")))
    seg = F.when(F.col("__outer").isNull(), -1).when(t.isNull(), 0).otherwise(F.col("__k") * SIDE + upto(F.get("__inner", F.col("__k"))))
    return placed.withColumn(SEG, seg).drop("__by", "__outer", "__inner", "__k"), True


def _joined(rows: DataFrame, summary: DataFrame, by: str) -> DataFrame:
    """rows with what summary (__by, __s, ...) says of their segment; null in groups that aren't cut."""
    return rows.join(summary, F.col(by).eqNullSafe(F.col("__by")) & (F.col(SEG) == F.col("__s")), "left").drop("__by", "__s")


def _summary(rows: DataFrame, by: str, **values: Column) -> DataFrame:
    made = rows.where(F.col(SEG) >= 0).groupBy(F.col(by).alias("__by"), F.col(SEG).alias("__s"))
    return made.agg(*[v.alias(k) for k, v in values.items()])


def _earlier() -> tuple:
    own = Window.partitionBy("__by").orderBy("__s")
    return own, own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)


def numbered(frame: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """frame with the place of each row in its group, from 0."""
    rows, cut = segmented(frame, by, order[0])
    place = F.row_number().over(Window.partitionBy(by, SEG).orderBy(*order)).cast("long") - 1
    if not cut:
        return rows.withColumn(name, place).drop(SEG)
    _, before, _ = _earlier()
    sizes = _summary(rows, by, __n=F.count("*")).select("__by", "__s", F.sum("__n").over(before).alias("__before"))
    return _joined(rows.withColumn(name, place), sizes, by).withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__before", SEG)


def previous(frame: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """frame with the value of the row before in its group; null in the first."""
    rows, cut = segmented(frame.withColumn("__v", value), by, order)
    made = rows.withColumn(name, F.lag("__v").over(Window.partitionBy(by, SEG).orderBy(order)))
    if not cut:
        return made.drop(SEG, "__v")
    own, _, _ = _earlier()
    ends = _summary(rows, by, __last=F.max_by(F.struct("__v"), order), __first=F.min(order))
    ends = ends.select("__by", "__s", "__first", F.lag("__last").over(own).alias("__carried"))
    return _joined(made, ends, by).withColumn(name, F.when(F.col(order) == F.col("__first"), F.col("__carried")["__v"]).otherwise(F.col(name))).drop("__first", "__carried", SEG, "__v")


def restarted_sum(frame: DataFrame, by: str, order: str, delta: Column, restart: Column, name: str = "value") -> DataFrame:
    """frame with `name`, a running sum of delta that begins anew, with the row's own delta, where restart holds; and `run`, the
    number of restarts in its segment so far."""
    rows, cut = segmented(frame.withColumns({"__d": delta, "__r": F.coalesce(restart, F.lit(False)).cast("int")}), by, order)
    w = Window.partitionBy(by, SEG).orderBy(order)
    local = rows.withColumn("run", F.sum("__r").over(w))
    local = local.withColumn(name, F.sum("__d").over(Window.partitionBy(by, SEG, "run").orderBy(order)))
    if not cut:
        return local.drop(SEG, "__d", "__r")
    own, _, _ = _earlier()
    ends = _summary(local, by, __tail=F.max_by(name, order), __has=F.max("__r")).withColumn("__g", F.sum("__has").over(own))
    upto = F.sum("__tail").over(Window.partitionBy("__by", "__g").orderBy("__s"))
    carried = ends.withColumn("__upto", upto).select("__by", "__s", F.lag("__upto").over(own).alias("__carried"))
    total = F.when(F.col("run") == 0, F.col(name) + F.coalesce("__carried", F.lit(0.0))).otherwise(F.col(name))
    return _joined(local, carried, by).withColumn(name, total).drop("__carried", SEG, "__d", "__r")


def around(frame: DataFrame, by: str, order: str, tie: str, value: str) -> DataFrame:
    """frame with __b, the last value at or before each row in order of (order, tie), and __a, the first at or after it in order of
    (order descending, tie): running values that skip nulls."""
    rows, cut = segmented(frame, by, order)
    back = F.last(value, True).over(Window.partitionBy(by, SEG).orderBy(order, tie))
    ahead = F.last(value, True).over(Window.partitionBy(by, SEG).orderBy(F.desc(order), tie))
    made = rows.withColumns({"__b": back, "__a": ahead})
    if not cut:
        return made.drop(SEG)
    _, before, after = _earlier()
    known = F.col(value).isNotNull()
    ends = _summary(rows, by, __first=F.min_by(value, F.when(known, F.col(order))), __last=F.max_by(value, F.when(known, F.col(order))))
    ends = ends.select("__by", "__s", F.last("__last", True).over(before).alias("__cb"), F.first("__first", True).over(after).alias("__ca"))
    return _joined(made, ends, by).withColumns({"__b": F.coalesce("__b", "__cb"), "__a": F.coalesce("__a", "__ca")}).drop("__cb", "__ca", SEG)


def _chain(places: np.ndarray, least: float) -> np.ndarray:
    """For each mark, if it is kept, the last one that is: each leads to the first mark at least so far on."""
    to = np.searchsorted(places, places + least)
    last = np.arange(len(places))
    for i in range(len(places) - 1, -1, -1):
        if to[i] < len(places):
            last[i] = last[to[i]]
    return last


def spaced(marks: DataFrame, by: str, order: str, place: str, least: float) -> DataFrame:
    """Of each group's marks in order, those at least so far after the last one kept. Places don't fall as the order goes on.

    A segment's first kept mark lies within `least` of its first mark, or is the next one. So its summary holds, for each mark of
    that stretch, the place of the last mark kept if that one is the first; where the segment is entered then decides its end."""
    rows, cut = segmented(marks, by, order)
    if cut:
        kind = marks.schema[by].dataType.simpleString()
        hot = rows.where(F.col(SEG) >= 0).select(F.col(by).alias("__by"), F.col(SEG).alias("__s"), F.col(order).alias("__o"), F.col(place).cast("double").alias("__p"))

        def ends(part: pa.Table) -> pa.Table:
            x = np.sort(part.column("__p").to_numpy())
            starts = x[: np.searchsorted(x, x[0] + least) + 1]
            last = x[_chain(x, least)[: len(starts)]]
            keep = np.flatnonzero(np.append(True, np.diff(starts) > 0))
            return pa.Table.from_arrays([part.column("__by").slice(0, 1).combine_chunks(), part.column("__s").slice(0, 1).combine_chunks(), pa.array([starts[keep].tolist()]), pa.array([last[keep].tolist()])], ["__by", "__s", "starts", "lasts"])

        def entries(part: pa.Table) -> pa.Table:
            part = part.sort_by("__s")
            last, out = None, []
            for starts, lasts in zip(*(part.column(c).to_pylist() for c in ("starts", "lasts")), strict=True):
                out.append(last)
                at = 0 if last is None else int(np.searchsorted(starts, last + least))
                if at < len(starts):
                    last = lasts[at]
            return pa.Table.from_arrays([part.column("__by"), part.column("__s"), pa.array(out, pa.float64())], ["__by", "__s", "__entry"])

        known = hot.groupBy("__by", "__s").applyInArrow(ends, f"__by {kind}, __s int, starts array<double>, lasts array<double>")
        carried = fixed(known.groupBy("__by").applyInArrow(entries, f"__by {kind}, __s int, __entry double"))
        rows = _joined(rows, carried, by)
    else:
        rows = rows.withColumn("__entry", F.lit(None).cast("double"))
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, by, SEG).sortWithinPartitions(by, SEG, order).select(*marks.columns, SEG, "__entry")
    at, to, n = marks.columns.index(by), marks.columns.index(place), len(marks.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = (), None
        for batch in batches:
            kept = []
            for i, (g, x, s, entry) in enumerate(zip(*(batch.column(k).to_pylist() for k in (at, to, n, n + 1)), strict=True)):
                if (g, s) != group:
                    group, last = (g, s), entry
                if last is None or x - last >= least:
                    last = x
                    kept.append(i)
            yield pa.RecordBatch.from_arrays(batch.take(pa.array(kept, pa.int32())).columns[:n], batch.schema.names[:n])

    return dealt.mapInArrow(run, marks.schema)
