import json

import numpy as np
from pyspark.sql import functions as F

from tracelake.operators import joins, pose, reports


def test_pose(spark):
    xyz = np.arange(24, dtype=float).reshape(4, 2, 3)
    xyz[2, 1, 0] = np.nan
    good = pose.sidecar(xyz, 10.0, np.array([1, 0, 1, 1]))
    bad = good | {"n_frames": 5}
    files = spark.createDataFrame([("a", json.dumps(good)), ("b", json.dumps(bad)), ("c", "no")], "path string, text string")
    assert {r["path"]: r["error"] for r in pose.checked(files).collect()} == {"a": None, "b": "positions have another length", "c": "no pose sidecar"}
    frames = pose.frames(files)
    got = {(r["frame_idx"], r["joint_idx"]): (r["x"], r["ok"]) for r in frames.collect()}
    assert len(got) == 8 and got[3, 1] == (21.0, True) and not got[1, 0][1] and not got[2, 0][1]
    one = frames.where("joint_idx = 0").withColumn("x", F.col("x").cast("double"))
    points = spark.createDataFrame([("a", 0.0), ("a", 0.3), ("a", 9.0), ("a", -1.0), ("a", 0.05)], "path string, t double")
    made = {r["t"]: r["value"] for r in joins.interpolated(points, one, "path", "t", 10.0, "frame_idx", "x", "ok").collect()}
    assert made[0.0] == made[-1.0] == 0.0 and made[9.0] == 18.0 and abs(made[0.3] - 18.0) < 1e-9 and made[0.05] is None


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(64, 5000.0, 2), (36, 250.0, 4), (256, 10000.0, 4), (0, 0.0, None)], "n int, fs double, b int")
    assert [r[0] for r in rows.select(reports.default_window(F.col("n"), F.col("fs"), F.col("b"))).collect()] == [2, 30, 2, 10]
    flags = spark.createDataFrame([(1, False), (2, True)], "c int, bad boolean")
    edits = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False)], "c int, at int, bad boolean")
    assert {tuple(r) for r in reports.overlaid(flags, edits, ["c"]).collect()} == {(1, False), (2, False)}
    reports.write_jsonl(flags, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert reports.markdown(flags.orderBy("c")).splitlines()[2] == "| 1 | False |"


def test_kinematics(spark):
    """Chains of turns against matrices multiplied one by one, and points moved by them."""
    import numpy as np

    from tracelake.operators import joins, pose

    rng = np.random.default_rng(2)
    axes, rests = rng.normal(0, 1, (5, 4, 3)), rng.normal(0, 1, (5, 4, 3))
    axes /= np.linalg.norm(axes, axis=2, keepdims=True)
    angle = rng.normal(0, 1, (3, 5, 4))

    def turn(a, k, r):
        cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        m = np.eye(4)
        m[:3, :3] = np.eye(3) + np.sin(a) * cross + (1 - np.cos(a)) * cross @ cross
        m[:3, 3] = r - m[:3, :3] @ r
        return m

    want = {(f, b): np.eye(4) for f in range(3) for b in (0, 1)}
    for f in range(3):
        for c in range(5):
            m = np.eye(4)
            for j in range(4):
                m = m @ turn(angle[f, c, j], axes[c, j], rests[c, j])
                if j:
                    want[f, 2 + 3 * c + j - 1] = m
    angles = spark.createDataFrame([(f, c, j, float(angle[f, c, j])) for f in range(3) for c in range(5) for j in range(4)], "frame int, chain int, joint int, angle double")
    joints = spark.createDataFrame([(c, j, axes[c, j].tolist(), rests[c, j].tolist()) for c in range(5) for j in range(4)], "chain int, joint int, axis array<double>, rest array<double>")
    bones = pose.kinematics(angles, joints)
    got = {(r["frame"], r["bone"]): np.array(r["m"]).reshape(3, 4) for r in bones.collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 17 and all(np.allclose(got[k], want[k][:3]) for k in want)
    rest = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "vertex int, x double, y double, z double")
    weights = spark.createDataFrame([(0, 4, 0.25), (0, 9, 0.75)], "vertex int, bone int, w double")
    p = np.array([1, 2, 3, 1.0])
    for r in joins.skinned(weights, bones, rest).collect():
        assert np.allclose([r["x"], r["y"], r["z"]], (0.25 * want[r["frame"], 4] @ p + 0.75 * want[r["frame"], 9] @ p)[:3])
