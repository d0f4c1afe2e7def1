"""Ordered folds over a hot channel that is cut into segments, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import folds
from tracelake.operators import joins as J
from tracelake.operators import samples as S


@pytest.fixture(params=[10**9, 20], ids=["plain", "cut"])
def split(request, monkeypatch):
    monkeypatch.setattr(folds, "SPLIT", request.param)
    monkeypatch.setattr(folds, "SIDE", 4)
    return request.param


def rows_of(seed, n=400):
    """Channel a holds nearly all rows; b, None and c few; times repeat."""
    rng = random.Random(seed)
    return [(rng.choice(["a"] * 12 + ["b", None, "c"]), rng.randint(0, 300), k, round(rng.uniform(-5, 5), 3)) for k in range(n)]


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1:3]):
        out.setdefault(r[0], []).append(r)
    return out


def test_numbers(spark, split):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "c string, t long, k long, v double").repartition(5)
    got = {r["k"]: r["sample_idx"] for r in S.numbered(df, "c", ["t", "k"], "v").collect()}
    assert got == {r[2]: i for own in groups(rows).values() for i, r in enumerate(own)}


def test_a_hot_channel_is_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(folds, "SPLIT", 20)
    monkeypatch.setattr(folds, "SIDE", 4)
    df = spark.createDataFrame(rows_of(2), "c string, t long, k long, v double")
    rows, cut = folds.segmented(df, "c", "t")
    sizes = {(r["c"], r[folds.SEG]): r["count"] for r in rows.groupBy("c", folds.SEG).count().collect()}
    hot = [n for (c, s), n in sizes.items() if c == "a"]
    assert cut and len(hot) == 16 and max(hot) < 60 and all(s == -1 for c, s in sizes if sum(n for (d, _), n in sizes.items() if d == c) <= 20)


@pytest.mark.parametrize("every", [7, 10**6])
def test_previous_and_restarted_sums(spark, split, every):
    rows = [(c, k, v) for c, _, k, v in rows_of(3)]
    df = spark.createDataFrame(rows, "c string, k long, v double").repartition(5)
    got = {r["k"]: (r["p"], round(r["s"], 6)) for r in folds.restarted_sum(folds.previous(df, "c", "k", F.col("v"), "p"), "c", "k", F.col("v"), F.col("k") % every == 3, "s").collect()}
    want = {}
    for own in groups([(c, k, 0, v) for c, k, v in rows]).values():
        total, before = 0.0, None
        for _, k, _, v in own:
            total = v if k % every == 3 else total + v
            want[k] = (before, round(total, 6))
            before = v
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)


@pytest.mark.parametrize("share", [0.02, 0.5])
def test_nearest(spark, split, share):
    rng = random.Random(4)
    rows = rows_of(5)
    events = [(c, float(t), k, "x" * (k % 3)) for c, t, k, _ in rows if rng.random() < share]
    points = [(c, t + rng.choice([0.0, 0.5]), k) for c, t, k, _ in rows]
    e, p = spark.createDataFrame(events, "c string, onset double, ord long, label string"), spark.createDataFrame(points, "c string, t double, k long")
    e = e.where("c is not null")
    got = {r["k"]: (r["event_onset"], r["event_ord"]) for r in J.nearest(p.where("c is not null"), e, "c", "t", "onset", "ord", ["label"]).collect()}
    for c, t, k in points:
        if c is not None:
            own = [(abs(x - t), o, x) for d, x, o, _ in events if d == c]
            want = min(own, default=None)
            assert got[k] == ((want[2], want[1]) if want else (None, None)), (c, t, k)


@pytest.mark.parametrize("least", [1, 5, 40, 1000])
def test_spaced(spark, split, least):
    rows = [(c, k, t) for (c, _, _, _), k, t in zip(rows_of(6), range(400), sorted(r[1] for r in rows_of(6)), strict=True)]
    df = spark.createDataFrame(rows, "c string, k long, p long").repartition(5)
    got = sorted(r["k"] for r in S.spaced(df, "c", "k", "p", least).collect())
    want = []
    for c in {r[0] for r in rows}:
        last = None
        for _, k, p in [r for r in rows if r[0] == c]:
            if last is None or p - last >= least:
                last = p
                want.append(k)
    assert got == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], "c string, t long, k long, v double")
    assert S.numbered(df, "c", ["t", "k"], "v").count() == S.spaced(df, "c", "t", "t", 3).count() == folds.restarted_sum(df, "c", "t", F.col("v"), F.lit(False), "s").count() == 0
