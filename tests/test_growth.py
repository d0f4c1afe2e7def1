"""Work of a row or a key is done once: what plans hold, and what operators give for it."""

from pyspark.sql import functions as F

from tracelake.functions import scalars as X
from tracelake.operators import joins as J
from tracelake.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_best_suffixes_of_ids_with_several_keys(spark, monkeypatch):
    keys = spark.createDataFrame([(1, "a/b"), (2, "a/b"), (3, "c/b"), (3, "a/b"), (3, "a/b"), (4, None), (5, "x"), (None, "a/b")], "id long, key string")
    names = spark.createDataFrame([(10, 2, "b"), (10, 1, "a/b"), (10, 1, "c/b"), (11, 3, "b"), (None, 1, "b")], "r long, p int, name string")
    first = [(10, i, 1, "a/b") for i in (1, 2, 3, None)]
    want = sorted([*first, *[(11, i, 3, "b") for i in (1, 2, 3, None)], *[(None, i, 1, "b") for i in (1, 2, 3, None)]], key=str)
    for few in (200_000, 1):
        monkeypatch.setattr(J, "FEW", few)
        assert sorted(map(tuple, J.best_suffixes(keys, "id", "key", names, "name", "r", "p").collect()), key=str) == want


def test_suffixes_are_ranked_before_they_go_to_ids(spark):
    made = registry.QUERIES["suffix_match_join"](spark, SF)
    top = plan(made).split("\n")[:2]
    assert not any("Aggregate" in line for line in top), top


def test_a_time_axis_is_chosen_once(spark):
    assert plan(registry.QUERIES["axis_ticks"](spark, SF)).count("30.0") <= 8
    one = spark.range(1).select(X.time_axis(F.lit(None).cast("double"), F.lit(1.0), F.lit(100)).alias("a")).select("a.step", "a.major").first()
    assert tuple(one) == (0.01, [])


def test_a_path_is_taken_apart_once(spark):
    text = plan(registry.QUERIES["sidecar_candidates"](spark, SF))
    assert text.count("regexp_extract(") + text.count("regexp_replace(") == 2
