"""Pose sidecars: joints by frame, samples of a pose at a time, and export."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SIDE = "format string, version int, fs double, n_frames int, n_joints int, duration_s double, positions struct<encoding:string,data:string>, valid string"
_FRAMES = "path string, fs double, frame_idx int, joint_idx int, x float, y float, z float, ok boolean"


def checked(files: DataFrame) -> DataFrame:
    """(path, error, s): the parsed sidecar, or why it can't be used."""
    s = files.select("path", F.from_json("text", _SIDE).alias("s"))
    size = F.octet_length(F.expr("try_to_binary(s.positions.data, 'base64')"))
    error = (
        F.when(F.col("s.format").isNull(), "no pose sidecar")
        .when(~(F.col("s.fs") > 0) | ~(F.col("s.n_frames") > 0) | ~(F.col("s.n_joints") > 0), "fs, n_frames and n_joints must be positive")
        .when(F.col("s.positions.encoding") != "base64-f32", "positions must be base64-f32")
        .when(size != F.col("s.n_frames") * F.col("s.n_joints") * 12, "positions have another length")
        .when(F.col("s.valid").isNotNull() & (F.octet_length(F.expr("try_to_binary(s.valid, 'base64')")) != F.col("s.n_frames")), "valid has another length")
    )
    return s.select("path", error.alias("error"), "s")


def frames(files: DataFrame) -> DataFrame:
    """(path, fs, frame_idx, joint_idx, x, y, z, ok) of usable sidecars. A frame that the mask excludes, or that holds a
    NaN, isn't ok."""
    good = checked(files).where(F.col("error").isNull()).select("path", "s.fs", "s.n_frames", "s.n_joints", F.unbase64("s.positions.data").alias("data"), F.unbase64("s.valid").alias("valid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, fs, n, joints, data, valid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                xyz = np.frombuffer(data, "<f4").reshape(n, joints, 3)
                ok = np.isfinite(xyz).all((1, 2)) & (np.frombuffer(valid, np.uint8) != 0 if valid is not None else True)
                flat = xyz.reshape(-1, 3)
                columns = [pa.array([path] * len(flat)), pa.array(np.full(len(flat), fs)), pa.array(np.repeat(np.arange(n, dtype=np.int32), joints)), pa.array(np.tile(np.arange(joints, dtype=np.int32), n)), *(pa.array(flat[:, k].copy()) for k in range(3)), pa.array(np.repeat(ok, joints))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "fs", "frame_idx", "joint_idx", "x", "y", "z", "ok"])

    return good.mapInArrow(run, _FRAMES)


def sidecar(xyz: np.ndarray, fs: float, valid: np.ndarray | None = None, kind: str = "pose") -> dict:
    """The sidecar of frames by joints by 3 numbers."""
    coded = lambda x: base64.b64encode(np.ascontiguousarray(x).tobytes()).decode()
    made = {"format": kind, "version": 1, "fs": fs, "n_frames": xyz.shape[0], "n_joints": xyz.shape[1], "positions": {"encoding": "base64-f32", "data": coded(xyz.astype("<f4"))}}
    return made | ({"valid": coded(valid.astype(np.uint8))} if valid is not None else {})


def _rotation(angle: Column, axis: Column, rest: Column) -> Column:
    """Twelve numbers, row by row: a turn by an angle about a unit axis through a point."""
    c, s = F.cos(angle), F.sin(angle)
    k, r = [F.get(axis, F.lit(i)) for i in range(3)], [F.get(rest, F.lit(i)) for i in range(3)]
    cross = [[F.lit(0.0), -k[2], k[1]], [k[2], F.lit(0.0), -k[0]], [-k[1], k[0], F.lit(0.0)]]
    turn = [[(c if i == j else F.lit(0.0)) + k[i] * k[j] * (1 - c) + cross[i][j] * s for j in range(3)] for i in range(3)]
    return F.array(*[x for i in range(3) for x in [*turn[i], r[i] - sum((turn[i][j] * r[j] for j in range(3)), F.lit(0.0))]])


def _composed(a: Column, b: Column) -> Column:
    """The affine map that is b, then a; both as twelve numbers."""
    at = lambda m, i, j: F.get(m, F.lit(4 * i + j))
    return F.array(*[sum((at(a, i, k) * at(b, k, j) for k in range(3)), at(a, i, 3) if j == 3 else F.lit(0.0)) for i in range(3) for j in range(4)])


def kinematics(angles: DataFrame, joints: DataFrame, first: int = 1) -> DataFrame:
    """(frame, bone, m): the affine frames that chains of joints come to, for J.skinned. angles (frame, chain, joint, angle); joints (chain,
    joint, axis, rest). Along a chain the turns are composed, from joint 0 on; frames after joint `first` and later ones are bones,
    numbered from 2 on in order of chain and joint; bones 0 and 1, root and wrist, don't move."""
    turned = angles.join(joints, ["chain", "joint"]).select("frame", "chain", "joint", _rotation(F.col("angle"), F.col("axis"), F.col("rest")).alias("m"))
    listed = turned.groupBy("frame", "chain").agg(F.array_sort(F.collect_list(F.struct("joint", "m"))).alias("ms"))
    still = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)])
    start = F.struct(still.alias("t"), F.array().cast("array<struct<joint:int,m:array<double>>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        t = _composed(a["t"], x["m"])
        return F.struct(t.alias("t"), F.concat(a["out"], F.array(F.struct(x["joint"].cast("int").alias("joint"), t.alias("m")))).alias("out"))

    chained = listed.select("frame", "chain", F.explode(F.aggregate("ms", start, step)["out"]).alias("x")).where(F.col("x.joint") >= first)
    each = F.size(F.array_distinct(F.collect_list("x.joint").over(Window.partitionBy("frame", "chain"))))
    bones = chained.withColumn("__n", each).select("frame", (2 + F.col("chain") * F.col("__n") + F.col("x.joint") - first).cast("int").alias("bone"), F.col("x.m").alias("m"))
    root = angles.select("frame").distinct().select("frame", F.explode(F.array(F.lit(0), F.lit(1))).alias("bone"), still.alias("m"))
    return root.unionByName(bones)
