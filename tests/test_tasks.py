"""Many small recordings are a bounded number of tasks, and paths are cut without patterns."""

from tracelake.plans import registry  # noqa: F401 - registers the queries
from tracelake.plans import recordings
from tracelake.sources import datasource, encoders


def test_headers_and_blocks_are_dealt_to_few_tasks(tmp_path):
    paths = [f"/nowhere/{i}.edf" for i in range(3000)]
    made = datasource._Headers({"paths": "\n".join(paths)}, False).partitions()
    assert len(made) == 47 and [p for m in made for p in m.items] == paths
    assert len(datasource._Headers({"paths": "\n".join(paths[:40])}, False).partitions()) == 20
    assert [r[0] for m in made[:2] for r in datasource._Headers({}, False).read(m)] == paths[:128]
    assert [len(m.items) for m in datasource._several(list("abcd"), [1, datasource.BLOCK_BYTES, 1, 1])] == [1, 1, 1, 1]


def test_a_stream_of_many_files_is_few_tasks(tmp_path):
    import numpy as np

    for i in range(100):
        encoders.edf(str(tmp_path / f"{i:03}.edf"), np.full((2, 200), i), 100, physical=1000)
    options = {"path": f"{tmp_path}/*.edf"}
    stream = datasource._Growing(options)
    end = stream.latestOffset()
    parts = stream.partitions({}, end)
    assert len(end) == 100 and len(parts) == 25 and sum(b.num_rows for p in parts for b in stream.read(p)) == 100 * 2 * 200
    assert sum(len(p.items) for p in datasource._Growing(options).partitions(end, end)) == 0
    assert len(datasource._Samples(options).partitions()) == 25


def test_names_of_folders(spark):
    df = spark.createDataFrame([("/a/b/edf/r-1/a.edf",)], "recording string")
    assert df.select(recordings._above(1), recordings._above(2)).first()[:] == ("r-1", "edf")
    assert "regexp" not in recordings._named(df)._jdf.queryExecution().optimizedPlan().toString()
