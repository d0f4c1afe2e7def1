"""Files that come in parts, cut after a line, give what they give whole; the queries over them have one file for each user."""

from pyspark.sql import functions as F

from tracelake.functions import texts as T
from tracelake.plans import registry
from tracelake.plans.registry import table
from tracelake.sources import sidecars

SF = "/root/testdata/sf0.001"


def cut(spark, path, text, sep, n):
    lines = text.split(sep)
    pieces = [sep.join(lines[i : i + n]) + (sep if i + n < len(lines) else "") for i in range(0, len(lines), n)]
    return spark.createDataFrame([(path, i, p) for i, p in enumerate(pieces)], "path string, part int, text string")


def found(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_markers_go_on_over_parts(spark):
    text = "1 2\nNUMBER\nNAME:\n\nA\nLIST OF SAMPLES:\n9 9\nLIST OF SAMPLES:\nTRIAL\tTIME\n+1\t+0.5\n+2\t+1.5\nNAME:\nB\nLIST OF SAMPLES:\n+3\t2\nNAME:\nC\n4 4\n"
    want = [("a", "A", 1, 0.5), ("a", "A", 2, 1.5), ("a", "B", 3, 2.0)]
    columns = ("path", "label", "trial", "onset")
    assert found(T.markers(spark.createDataFrame([("a", text)], "path string, text string")), *columns) == want
    for n in (1, 2, 3, 5):
        assert found(T.markers(cut(spark, "a", text, "\n", n)), *columns) == want
    assert found(T.markers(cut(spark, None, text, "\n", 2)), *columns) == [(None, *w[1:]) for w in want]


def test_tables_and_annotations_in_parts(spark):
    text = "# a\n\nname\tx\ty\tz\nA\t1\t2\t3\nB\tn/a\t2\t3\nC\t1\t2\t3\n\nA\t4\t5\t6\n"
    whole = spark.createDataFrame([("a", text)], "path string, text string")
    columns = ("path", "row", "name", "x", "duplicate", "skipped")
    want = found(sidecars.electrodes(whole), *columns)
    assert [w[4:] for w in want] == [(True, 1), (False, 1), (True, 1)] and [w[1] for w in want] == [0, 2, 3]
    for n in (1, 2, 4):
        assert found(sidecars.electrodes(cut(spark, "a", text, "\n", n)), *columns) == want
    text = "+0\x14\x14\x00+1\x152\x14x\x14y\x14\x00+3\x14z\x14\x00"
    assert found(T.annotations(cut(spark, "a", text, "\x00", 1)), "onset", "label") == [(1.0, "x"), (1.0, "y"), (3.0, "z")]


def test_a_file_for_each_user(spark, monkeypatch):
    from tracelake.plans import formats

    users = {f"u{r[0]}" for r in table(spark, SF, "events").select("user_id").distinct().collect()}
    for name in ("annotation_lists", "marker_files", "electrode_tables"):
        made = registry.QUERIES[name](spark, SF)
        whole = made.count(), made.agg(F.sum(F.xxhash64(*made.columns).cast("decimal(38,0)"))).first()[0]
        assert {r[0] for r in made.select("path").distinct().collect()} == users
        with monkeypatch.context() as m:
            m.setattr(formats, "PART", 7)
            made = registry.QUERIES[name](spark, SF)
            assert (made.count(), made.agg(F.sum(F.xxhash64(*made.columns).cast("decimal(38,0)"))).first()[0]) == whole
