"""Mixing sources to target weights by entropy balancing.

Of all rates that give each source its target of words, with no rate above CAP, the mix has those that are nearest to one
for every document in relative entropy: rate = min(CAP, exp(tilt * size)), with one tilt a source. The tilt solves the
convex dual: Newton's steps on the logarithm of the source's words, inside a bracket that every step narrows. What a step
needs (words and second moments by source) are sums over a table of (source, size, documents), so steps are Spark jobs that
don't read a document again, and the tilts of all sources are a table as well.

Rates become whole copies: the whole part, and one more for documents whose random number, divided by the rate's fraction,
is low enough. How low is set in a cascade: from a source's longest documents (sizes between powers of two) to its shortest,
each class takes what comes nearest to its words, and what is left over or short goes to the next class; where that ends
further than NEAR from the target, as in a source of few documents, two classes at a time move to where they come nearest. Random numbers depend on seed, id and text alone and sums
are whole numbers, so that reruns agree however rows are dealt.

As the tilt goes with size, a source that must shrink keeps its short documents, and one that must grow repeats its long
ones: the price of changing as few documents as can be.

Defined results: a null text has no words; documents without words are taken no times. A null source is the last source. Rows
that are equal in source, id and text are taken alike. If no document has words, all targets are 0. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import cut, ranked, table, uniform

WEIGHTS = (1, 2, 3)
CAP = 3
#: Steps of the threshold of a class of sizes, and the unit that rates are rounded to.
BINS, UNIT = 4096, 1 << 20
#: Decimals of a tilt times the mean size, and the relative error of a source's words at which its steps end.
TILT_DECIMALS, CLOSE = 9, 1e-11
MOST_STEPS = 200
#: A source of few documents is brought to within this share of its target, if any two of its bands can.
NEAR = 1e-3


def n_words(text: str | Column) -> Column:
    """Number of runs of other characters than ASCII's white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, budget: float | None = None) -> DataFrame:
    """(source, source_size, docs, target) of sizes (source, size): by weight, which repeat in the order of the sources, of all
    words or `budget`; a target stops at cap times the source's size, and the excess is shared again by weight."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    own = own.select("*", F.lit(0).alias("g"), F.col("source").isNull().alias("last"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    own = cut(ranked(own, "g", ["last", "source"]).select("source", "source_size", "docs", weight.alias("weight")))
    most = cap * F.col("source_size")
    words = float(own.agg(F.sum("source_size").alias("n")).first()["n"] or 0) if budget is None else budget
    level, full = -1.0, -1
    while True:  # the level rises until no more sources are full
        is_full = most <= level * F.col("weight")
        got = own.agg(F.count(F.when(is_full, 1)).alias("full"), F.sum(F.when(is_full, most)).alias("words"), F.sum(F.when(~is_full, F.col("weight"))).alias("weight")).first()
        if got["full"] == full or not got["weight"]:
            break
        full, level = got["full"], (words - float(got["words"] or 0)) / got["weight"]
    return own.select("source", "source_size", "docs", F.least(level * F.col("weight"), most.cast("double")).alias("target"))


def rate(tilt: Column, size: Column, cap: float = CAP) -> Column:
    return F.least(F.lit(float(cap)), F.exp(tilt * size))


def balanced(counts: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, tilt): the tilt at which documents of counts (source, size, n) give each source its target."""
    mean = F.col("source_size") / F.col("docs")
    grows, rest = F.col("target") > F.col("source_size"), F.col("source_size") > 0
    state = wanted.select(
        F.col("source").alias("key"),
        "source_size",
        "target",
        F.when(rest, mean).otherwise(1.0).alias("mean"),
        # a tilt of log(cap) a word gives every document the highest rate
        F.when(F.col("target") >= cap * F.col("source_size"), math.log(cap)).otherwise(0.0).alias("tilt"),
        F.when(grows | ~rest, 0.0).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("low"),
        F.when(grows, math.log(cap)).otherwise(0.0).alias("high"),
        ((F.col("target") >= cap * F.col("source_size")) | ~rest).alias("done"),
    )
    for _ in range(MOST_STEPS):
        state = cut(state)
        if not state.where("not done").limit(1).count():
            break
        taken = F.col("n") * F.col("size") * rate(F.col("tilt"), F.col("size"), cap)
        free = F.col("tilt") * F.col("size") < math.log(cap)
        active = state.where("not done").select("key", "tilt")
        sums = counts.join(active, F.col("source").eqNullSafe(F.col("key"))).groupBy("key").agg(F.sum(taken).alias("words"), F.sum(F.when(free, taken * F.col("size"))).alias("slope"))
        sums = sums.withColumnRenamed("key", "met")
        off = F.log(F.col("words") / F.col("target"))
        low, high = F.when(off <= 0, F.col("tilt")).otherwise(F.col("low")), F.when(off >= 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - off * F.col("words") / F.col("slope")
        inside = F.coalesce((step > low) & (step < high), F.lit(False))
        close = F.coalesce((F.abs(off) < CLOSE) | (high - low <= 1e-16 * F.abs(high)), F.lit(False))
        moved = state.join(sums, F.col("key").eqNullSafe(F.col("met")), "left")
        ends = F.col("done") | close
        state = moved.select("key", "source_size", "target", "mean", F.when(ends, F.col("tilt")).when(inside, step).otherwise((low + high) / 2).alias("tilt"), low.alias("low"), high.alias("high"), ends.alias("done"))
    # sums of floating-point numbers depend on the order of rows in their last digits: leave these out
    return state.select(F.col("key").alias("source"), "source_size", "target", (F.round(F.col("tilt") * F.col("mean"), TILT_DECIMALS) / F.col("mean")).alias("tilt"))


def _parts(tilt: Column, size: Column, chance: Column, cap: float) -> tuple[Column, Column, Column]:
    """(whole copies, fraction in units, bin of the extra copy; null where there can be none) of a document."""
    units = F.round(rate(tilt, size, cap) * UNIT).cast("long")
    whole, part = F.shiftright(units, 20), units.bitwiseAND(UNIT - 1)
    odds = chance * UNIT / (chance * UNIT + part)
    return whole, part, F.when(part > 0, F.floor(odds * BINS).cast("int"))


def cascade(rows: pd.DataFrame) -> pd.DataFrame:
    """rows (source, target, band, words, whole, bins, extra) of one source, as (source, band, below): documents of a band of
    sizes whose bin is below get one copy more. extra[i] are the words of documents in bins[i]; `words` are those that the
    band's rates give, `whole` those of its whole copies."""
    given = rows.sort_values("band", ascending=False)
    target, source = float(given["target"].iloc[0]), given["source"].iloc[0]
    bins = [np.sort(np.asarray(b, np.int64)) for b in given["bins"]]
    sums = [np.concatenate([[0], np.cumsum(np.asarray(e, np.float64)[np.argsort(b)])]) for b, e in zip(given["bins"], given["extra"], strict=True)]
    at, over = [], 0.0
    for words, whole, reach in zip(given["words"], given["whole"], sums, strict=True):
        need = words - whole + over
        at.append(int(np.abs(reach - need).argmin()))
        over = need - reach[at[-1]]
    missed = target - float(given["whole"].sum()) - sum(r[k] for r, k in zip(sums, at, strict=True))
    while abs(missed) > NEAR * target:  # a source of few documents: move two bands at once
        best = None
        for i, j in itertools.combinations_with_replacement(range(len(sums)), 2):
            need = missed + sums[i][at[i]] + (sums[j][at[j]] - sums[i] if i != j else 0 * sums[i] - sums[i])
            reach = sums[j] if i != j else np.zeros(1)
            place = np.searchsorted(reach, need)
            for k in (np.maximum(place - 1, 0), np.minimum(place, len(reach) - 1)):
                left = need - reach[k]
                m = int(np.abs(left).argmin())
                if best is None or abs(left[m]) < abs(best[0]):
                    best = (float(left[m]), i, m, j, int(k[m]) if i != j else m)
        if best is None or abs(best[0]) >= abs(missed) * (1 - 1e-9):
            break
        missed, at[best[1]], at[best[3]] = best[0], best[2], best[4]
    below = [int(b[k - 1]) + 1 if k else 0 for b, k in zip(bins, at, strict=True)]
    return pd.DataFrame({"source": source, "band": given["band"].astype("int32"), "below": np.array(below, np.int32)})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, budget: float | None = None, seed: int = 12) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of docs (doc_id, source, text)."""
    chance = F.greatest(uniform(F.struct("doc_id", F.xxhash64("text")), seed), F.lit(1e-12))
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words("text").alias("size"), chance.alias("chance")))
    counts = cut(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    tilts = cut(balanced(counts, targets(sized.select("source", "size"), weights, cap, budget), cap).withColumnRenamed("source", "key"))

    met = sized.join(tilts, F.col("source").eqNullSafe(F.col("key"))).drop("key")
    whole, part, place = _parts(F.col("tilt"), F.col("size"), F.col("chance"), cap)
    rows = met.select("*", whole.alias("whole"), part.alias("part"), place.alias("bin"), F.when(F.col("size") > 0, F.floor(F.log2("size"))).cast("int").alias("band"))
    exact = F.col("size").cast("decimal(38,0)")
    binned = rows.where("size > 0").groupBy("source", "target", "band", "bin").agg(F.sum(exact * (F.col("whole") * UNIT + F.col("part"))).alias("units"), F.sum(exact * F.col("whole")).alias("whole"), F.sum("size").alias("extra"))
    listed = F.filter(F.collect_list(F.struct("bin", "extra")), lambda x: x["bin"].isNotNull())  # BINS at most
    classes = binned.groupBy("source", "target", "band").agg((F.sum("units").cast("double") / UNIT).alias("words"), F.sum("whole").cast("double").alias("whole"), listed.alias("met"))
    classes = classes.select("source", "target", "band", "words", "whole", F.col("met.bin").alias("bins"), F.col("met.extra").alias("extra"))
    steps = cut(classes.groupBy("source").applyInPandas(cascade, "source string, band int, below int").withColumnsRenamed({"source": "__source", "band": "__band"}))

    joined = rows.join(steps, rows["source"].eqNullSafe(steps["__source"]) & (rows["band"] == steps["__band"]), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("bin") < F.col("below"), F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")
