"""Biquad filters over samples in blocks.

A recurrence has no declarative form, but a stable filter forgets: what lies REACH samples back has decayed below 2^-60 of
its size. So a channel is cut into blocks, each with as many samples of its neighbours as the filters remember, and the
blocks are filtered apart in Arrow functions. One shuffle, whatever the number of filters; a channel of any length is dealt
over many tasks. The result is that of one pass over the whole channel, up to rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Biquad = tuple[float, float, float, float, float]  # b0, b1, b2, a1, a2
#: Least samples of a block; samples that are worked on as one matrix row.
BLOCK, RUN = 1 << 16, 64


def design(kind: str, fs: float, f: float, q: float | None = None) -> Biquad:
    """Coefficients of a `highpass`, `lowpass` or `notch` of second order, by the well-known audio cookbook."""
    w0 = 2 * np.pi * f / fs
    c = np.cos(w0)
    alpha = np.sin(w0) / (2 * (np.sqrt(0.5) if kind != "notch" else 30.0 if q is None else q))
    b = {"highpass": ((1 + c) / 2, -(1 + c), (1 + c) / 2), "lowpass": ((1 - c) / 2, 1 - c, (1 - c) / 2), "notch": (1.0, -2 * c, 1.0)}[kind]
    return tuple(float(x / (1 + alpha)) for x in (*b, -2 * c, 1 - alpha))


def reach(coefficients: Biquad) -> int:
    """Samples after which the filter's memory has decayed below 2^-60."""
    radius = float(np.abs(np.roots([1.0, coefficients[3], coefficients[4]])).max())
    if radius >= 1:
        raise ValueError("an unstable filter never forgets")
    return 2 if radius < 1e-9 else int(np.ceil(-60 * np.log(2) / np.log(radius))) + 2


def one_pass(x: np.ndarray, coefficients: Biquad) -> np.ndarray:
    """Forward filter with zero initial state. Runs of samples are filtered side by side from a state of zero; then the state
    at the beginning of each run follows from the run before it, and its response is added."""
    b0, b1, b2, a1, a2 = coefficients
    n = len(x)
    rows = -(-n // RUN) or 1
    padded = np.zeros(rows * RUN)
    padded[:n] = x
    h = np.zeros(RUN + 2)  # response of the recurrence to one, and before it to the two states
    h[2] = 1.0
    for i in range(3, RUN + 2):
        h[i] = -a1 * h[i - 1] - a2 * h[i - 2]
    h = h[2:]
    step = np.subtract.outer(np.arange(RUN), np.arange(RUN))
    alone = padded.reshape(rows, RUN) @ np.where(step >= 0, h[step.clip(0)], 0.0).T
    first = np.zeros((2, RUN + 2))  # response to (w[-1], w[-2])
    first[0, 1] = first[1, 0] = 1.0
    for i in range(2, RUN + 2):
        first[:, i] = -a1 * first[:, i - 1] - a2 * first[:, i - 2]
    first = first[:, 2:]
    states = np.zeros((rows, 2))
    w1 = w2 = 0.0
    (p11, p12), (p21, p22) = first[:, -1].tolist(), first[:, -2].tolist()
    for r, (e1, e2) in enumerate(zip(alone[:-1, -1].tolist(), alone[:-1, -2].tolist(), strict=True), 1):
        w1, w2 = e1 + p11 * w1 + p12 * w2, e2 + p21 * w1 + p22 * w2
        states[r] = w1, w2
    w = np.concatenate([[0.0, 0.0], (alone + states @ first).ravel()])
    return (b0 * w[2:] + b1 * w[1:-1] + b2 * w[:-2])[:n]


def zero_phase(x: np.ndarray, coefficients: Biquad) -> np.ndarray:
    """Forward, then backward, without padding."""
    return one_pass(one_pass(x, coefficients)[::-1], coefficients)[::-1]


def filtered(samples: DataFrame, chain: list[Biquad], both_ways: bool = True, block: int | None = None) -> DataFrame:
    """(channel, sample_idx, value, filtered) of samples (channel, sample_idx, value), numbered from 0 without gaps."""
    run = zero_phase if both_ways else one_pass
    halo = sum(map(reach, chain))
    size = block or max(BLOCK, 4 * halo)
    schema = samples.select("channel", "sample_idx", "value", samples["value"].cast("double").alias("filtered")).schema
    after = halo if both_ways else 0
    i = F.col("sample_idx")
    blocks = F.sequence(F.greatest(F.lit(0), F.floor((i - after) / size)), F.floor((i + halo) / size))
    dealt = samples.select("channel", "sample_idx", "value", F.explode(blocks).alias("block"))

    def group(key: tuple, data: pa.Table) -> pa.Table:
        data = data.sort_by("sample_idx").select(["channel", "sample_idx", "value"])
        x, at = data["value"].to_numpy().astype(np.float64), data["sample_idx"].to_numpy()
        own = np.flatnonzero(at // size == key[1].as_py())
        if len(own):
            for coefficients in chain:
                x = run(x, coefficients)
        low, high = (own[0], own[-1] + 1) if len(own) else (0, 0)
        return data.slice(low, high - low).append_column("filtered", pa.array(x[low:high]))

    return dealt.groupBy("channel", "block").applyInArrow(group, schema)
