"""Operators over samples against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import scalars as X
from tracelake.operators import dsp
from tracelake.operators import samples as S


def plain_pass(x, c):
    b0, b1, b2, a1, a2 = c
    out, w1, w2 = [], 0.0, 0.0
    for v in x:
        w = v - a1 * w1 - a2 * w2
        out.append(b0 * w + b1 * w1 + b2 * w2)
        w2, w1 = w1, w
    return np.array(out)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 5000])
@pytest.mark.parametrize("kind", ["highpass", "lowpass", "notch"])
def test_one_pass(n, kind):
    x = np.random.default_rng(n).normal(0, 50, n)
    c = dsp.design(kind, 250, {"highpass": 1, "lowpass": 45, "notch": 60}[kind])
    assert np.allclose(dsp.one_pass(x, c), plain_pass(x, c), rtol=0, atol=1e-9)


@pytest.mark.parametrize("both", [False, True])
def test_blocks_give_what_the_whole_channel_gives(spark, both):
    chain = [dsp.design("highpass", 250, 20), dsp.design("lowpass", 250, 45)]
    rng = np.random.default_rng(1)
    own = {"a": rng.normal(10, 50, 3000), "b": rng.normal(0, 1, 7), "c": rng.normal(0, 1, 1024)}
    rows = [(k, i, float(v)) for k, x in own.items() for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "channel string, sample_idx long, value double")
    got = dsp.filtered(df, chain, both, block=512).toPandas()
    assert len(got) == len(rows)
    for k, x in own.items():
        for c in chain:
            x = plain_pass(x, c)
            if both:
                x = plain_pass(x[::-1], c)[::-1]
        assert np.allclose(got[got.channel == k].sort_values("sample_idx").filtered, x, rtol=0, atol=1e-9)


def test_reach_covers_the_memory():
    for c in (dsp.design("highpass", 250, 1), dsp.design("notch", 250, 60), dsp.design("lowpass", 250, 45)):
        x = np.zeros(dsp.reach(c) + 200)
        x[0] = 1
        assert np.abs(dsp.one_pass(x, c)[dsp.reach(c) :]).max() < 1e-16
    with pytest.raises(ValueError, match="never forgets"):
        dsp.reach((1.0, 0.0, 0.0, -2.0, 1.0))


@pytest.mark.parametrize("pixels", [1, 3, 7, 20])
def test_decimated(spark, pixels):
    own = {"a": [3.0, 1.0, float("nan"), 4.0, 5.0, -1.0, 2.0, float("nan")], "b": [float("nan")] * 3, "c": [7.0], "d": [float(i % 13) for i in range(100)]}
    df = spark.createDataFrame([(k, i, v) for k, x in own.items() for i, v in enumerate(x)], "channel string, sample_idx long, value double")
    got = {(r["channel"], r["pixel"]): (r["lo"], r["hi"]) for r in S.decimated(df, pixels).collect()}
    want = {}
    for k, x in own.items():
        n = len(x)
        for p in range(pixels):
            a = p * n // pixels
            run = [v for v in x[a : max(a + 1, (p + 1) * n // pixels)] if v == v]
            want[k, p] = (min(run), max(run)) if run else (None, None)
    assert got == want


def test_ranked(spark):
    rng = random.Random(3)
    own = {"a": [rng.gauss(0, 1) for _ in range(5000)], "b": [7.0] * 900 + [1.0, 9.0], "c": [2.0], None: [float(rng.randrange(5)) for _ in range(400)]}
    df = spark.createDataFrame([(k, v) for k, x in own.items() for v in [*x, None]], "g string, v double").repartition(5)
    qs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r.asDict() for r in S.ranked(df, ["g"], "v", qs).collect()}
    for k, x in own.items():
        x = sorted(x)
        n = len(x)
        assert got[k] == {"g": k, "n": n, "least": x[0], "most": x[-1]} | {name: x[min(n - 1, int(n * q))] for name, q in qs.items()}


def test_spaced(spark):
    rng = random.Random(4)
    own = {k: sorted(rng.randrange(2000) for _ in range(200)) for k in "abc"}
    df = spark.createDataFrame([(k, i, v) for k, x in own.items() for i, v in enumerate(x)], "g string, i long, px long").repartition(7)
    got = sorted((r["g"], r["i"]) for r in S.spaced(df, "g", "i", "px", 32).collect())
    want = []
    for k, x in own.items():
        last = None
        for i, v in enumerate(x):
            if last is None or v - last >= 32:
                want.append((k, i))
                last = v
    assert got == want


def test_scalars(spark):
    df = spark.createDataFrame([(0.125, 1.0), (-0.125, 2.0), (0.004, -0.001), (999.95, 12.345)], "x double, y double")
    assert [tuple(r) for r in df.select(X.decimals(F.col("x"), 2), X.decimals(F.col("y"), 1)).collect()] == [("0.13", "1.0"), ("-0.12", "2.0"), ("0.00", "0.0"), ("999.95", "12.3")]
    shown = df.limit(1).select(X.display_point(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit("salsa"), F.lit("m")).alias("p"), X.display_point(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit("EEGLAB-HJ"), F.lit("cm")).alias("q"), X.display_point(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(None).cast("string"), F.lit("?")).alias("r")).first()
    assert tuple(shown["p"]) == (1000, 2000, 3000) and tuple(shown["q"]) == (-20, 10, 30) and tuple(shown["r"]) == (1, 2, 3)
