"""Chunked arrays under an index, and coded blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import checksums
from tracelake.operators import blockcodec as B
from tracelake.operators import chunked as C


@pytest.mark.parametrize(("n", "fanout"), [(1, 4), (4, 4), (5, 4), (300, 4), (300, 64)])
def test_index_walk(spark, n, fanout):
    """All windows find their chunks, and no round reads a node that no window overlaps."""
    chunks = spark.createDataFrame([(a, 10 * k, 10, 1000 * i + k, b"x") for i, a in enumerate(("a", "b")) for k in range(n)], "array string, row long, rows long, address long, bytes binary").repartition(3)
    nodes, roots = C.indexed(chunks, fanout)
    rng = random.Random(n)
    asked = [(rng.choice("ab"), w, s, s + rng.randint(0, 40)) for w in range(12) for s in [rng.randint(-20, 10 * n + 20)]]
    found, read = C.walked(spark.createDataFrame(asked, "array string, window long, start long, stop long"), nodes, roots)
    got = sorted((r["array"], r["window"], r["row"], r["rows"], r["address"]) for r in found.collect())
    want = sorted((a, w, 10 * k, 10, 1000 * (a == "b") + k) for a, w, s, e in asked for k in range(n) if 10 * k < e and 10 * k + 10 > s and s < e)
    assert got == want
    size = 10
    for level in reversed(read):  # from the leaves up
        size *= fanout
        spans = {(a, at // size) for a, w, s, e in asked if s < e for at in range(max(0, s), min(e, 10 * n))}
        assert level <= max(2, len(spans))
    assert nodes.count() >= sum(read)


def test_nodes_are_checked():
    raw = C.node(1, [(0, 5, 7), (64, 6, 8)], 128)
    assert C.entries_of(raw) == (1, [(0, 64, 5, 7), (64, 128, 6, 8)])
    for bad in (raw[:-1], b"", b"X" + raw[1:]):
        with pytest.raises(ValueError, match="node"):
            C.entries_of(bad)


def test_codec_round_trips():
    rng = np.random.default_rng(1)
    signals = [np.cumsum(rng.integers(-s, s + 1, n)) for s, n in ((0, 50), (3, 1), (3, 2), (100, 3000), (127, 777), (1000, 500), (2**20, 400))]
    signals += [np.zeros(0, np.int64), np.array([-(2**31), 2**31 - 1, 0, -128, -129, 127]), rng.integers(-(2**31), 2**31, 300), np.full(5000, -128), np.tile([0, 128, 0, -128], 300)]
    for got, want in zip(B.decode([B.encode(x, start=i) for i, x in enumerate(signals)]), signals, strict=True):
        assert np.array_equal(got, want)
    assert len(B.encode(signals[3])) < 3000 * 1.2 + B.HEADER


def test_codec_scales_and_names_errors():
    x = np.array([10, -25, 1000, 7])
    assert B.decode([B.encode(x, scale=10.0)])[0].tolist() == [10, -30, 1000, 10]
    raw = B.encode(np.arange(100))
    spoilt = bytearray(raw)
    spoilt[310] ^= 1
    coded = bytearray(raw)
    coded[4] |= 2
    assert B.decode([bytes(spoilt), raw[:200], raw[:-8], bytes(coded), None]) == ["checksum", "cut off", "cut off", "encrypted", "cut off"]
    assert B.decode([]) == []


def test_checksums_in_step(monkeypatch):
    rng = random.Random(2)
    blocks = [rng.randbytes(rng.choice([0, 1, 7, 300])) for _ in range(60)]
    for most in (1, 1000, 1 << 20):
        monkeypatch.setattr(checksums, "IN_STEP", most)
        assert checksums.crcs_koopman(blocks).tolist() == [checksums.crc_koopman(b) for b in blocks]


def test_decoded_table(spark):
    df = spark.createDataFrame([("a", bytearray(B.encode(np.arange(5)))), ("b", None), ("c", bytearray(B.encode(np.zeros(0)))), (None, bytearray(B.encode(np.array([3]))))], "n string, raw binary").withColumn("value", F.lit(1))
    got = {tuple(r) for r in B.decoded(df, "n", "raw").collect()}
    assert got == {("a", i, i, None) for i in range(5)} | {("b", None, None, "cut off"), (None, 0, 3, None)}
