from pyspark.sql import functions as F

from tracelake.functions import scalars as X
from tracelake.sources import sidecars as S


def files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, text string")


def test_channels_and_events(spark):
    f = files(spark, ("a", "Name\ttype\tunits\tstatus\tlow_cutoff\n# note\nFp1\tEEG\tuV\tbad\t0.1\n\nFp2\tEEG\tn/a\t\tn/a\n\tEEG\tuV\tgood\t1\n"), ("b", "name type\nX  EEG\n"))
    got = {(r["path"], r["name"]): r for r in S.channels(f).collect()}
    assert set(got) == {("a", "Fp1"), ("a", "Fp2"), ("b", "X")}
    assert got["a", "Fp1"]["status"] == "bad" and got["a", "Fp2"]["status"] == "good" and got["a", "Fp2"]["units"] is None and got["a", "Fp1"]["low_cutoff"] == 0.1
    e = files(spark, ("a", "onset\tduration\ttrial_type\tvalue\tstim_file\n1.5\tn/a\tgo\t3\tx/cat.png\nn/a\t1\tno\t3\t\n2.5s\t1\tn/a\tstim_test,12,\tn/a\n"))
    assert [tuple(r)[2:] for r in S.events(e).orderBy("row").collect()] == [(1.5, 0.0, "go", None, "cat"), (2.5, 1.0, "stim_test,12,", None, "12")]


def test_electrodes_and_json(spark):
    f = files(spark, ("a", "name\tx\ty\tz\nA\t1\t2\t3\nB\t1e-2\tn/a\t3\nC\t1x\t2\t3\nA\t4\t5\t6\n"))
    got = S.electrodes(f).orderBy("row").collect()
    assert [(r["name"], r["x"], r["duplicate"], r["skipped"]) for r in got] == [("A", 1.0, True, 2), ("A", 4.0, True, 2)]
    j = files(spark, ("a", '{"EEGCoordinateSystem": "CapTrak", "MEGCoordinateSystem": "CTF", "MEGCoordinateUnits": "cm"}'), ("b", "{}"))
    assert {tuple(r) for r in S.coordinate_system(j, "MEG").collect()} == {("a", "CTF", "cm"), ("b", "Other", "n/a")}
    r = {x["path"]: x for x in S.recording_json(files(spark, ("a", '{"SamplingFrequency": 500, "Odd": 1}'), ("b", '{"SamplingFrequency": -1}'), ("c", "bad"))).select("path", "fs").collect()}
    assert r["a"]["fs"] == 500 and r["b"]["fs"] is None and r["c"]["fs"] is None


def test_inheritance(spark):
    recordings = spark.createDataFrame([("/d/sub-1/ses-2/eeg/sub-1_ses-2_task-x_eeg.edf",), ("/d/sub-2/eeg/sub-2_task-x_eeg.edf",)], "path string")
    tsv = spark.createDataFrame([("/d/task-x_events.tsv", 1), ("/d/events.tsv", 2), ("/d/sub-1/sub-1_ses-2_events.tsv", 3), ("/d/sub-1/events.tsv", 4)], "path string, id int")
    got = {r["path"][:8]: r["hit"]["id"] for r in S.inherited(recordings, tsv, "events.tsv").collect()}
    assert got == {"/d/sub-1": 3, "/d/sub-2": 1}


def test_manifest(spark):
    f = files(spark, ("m", '[{"path": "a", "size": 1, "url": "https://x/ds000001/a"}, {"path": "b", "size": 2, "url": "https://x/ds000002/b"}]'))
    assert [r["path"] for r in S.manifest(f, "ds000001").collect()] == ["a"]


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()[0]
    for v, want in ((0, 1), (-5, 1), (1, 1), (1.5, 2), (3.5, 5), (7.5, 10), (50, 50), (173, 200), (0.005, 0.005)):
        assert abs(pick(X.nice_round(F.lit(float(v)))) - want) < 1e-9
    for s, want in ((3599, "00:59:59"), (7322, "02:02:02"), (86400, "00:00:00"), (90000, "01:00:00")):
        assert pick(X.hhmmss(F.lit(float(s)))) == want
    assert pick(X.second_of_day(F.lit("2020-01-01T01:02:03"))) == 3723 and pick(X.second_of_day(F.lit("x"))) is None
    assert pick(X.float_prefix(F.lit("12abc"))) == 12 and pick(X.float_prefix(F.lit("abc"))) is None
    assert pick(X.round_half_away(F.lit(-1.5))) == -2 and pick(X.sign_extend24(F.lit(0xFFFFFF))) == -1
    assert pick(X.edf_start(F.lit("01.02.84"), F.lit("03.04.05"))) == "2084-02-01T03:04:05" and pick(X.edf_start(F.lit("01.02.85"), F.lit("03.04.05")))[:4] == "1985"
    assert pick(X.entities(F.lit("/sub-01/ses-a/eeg/sub-02_task-x_eeg.edf"))) == {"sub": "01", "ses": "a", "task": "x"}
    assert pick(X.is_dataset_id(F.lit("ds000001"))) and not pick(X.is_dataset_id(F.lit("ds1")))
