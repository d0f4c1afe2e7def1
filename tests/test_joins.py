"""Joins and samples that the queries don't cover, against plain loops."""

import random

from pyspark.sql import functions as F

from tracelake.operators import audit as A
from tracelake.operators import joins as J


def test_suffixes_of_several_parts(spark):
    rng = random.Random(1)
    parts = ["a", "b", "b.tsv", "", "c"]
    keys = ["/".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(200)] + [None]
    names = [("/".join(rng.choice(parts) for _ in range(rng.randint(1, 3))), i) for i in range(40)] + [(None, 99)]
    got = sorted((r["k"], r["p"]) for r in J.suffix_matched(spark.createDataFrame(list(enumerate(keys)), "k long, key string"), "key", spark.createDataFrame(names, "name string, p long"), "name").collect())
    want = sorted((i, p) for i, key in enumerate(keys) for name, p in names if key is not None and name is not None and (key == name or key.endswith(f"/{name}")))
    assert got == want
    assert J.suffix_matched(spark.createDataFrame([(1, "a")], "k long, key string"), "key", spark.createDataFrame([], "name string"), "name").count() == 0


def test_stratified_samples_are_limited_before_the_shuffle(spark, capsys):
    rows = [("hot" if i % 10 else f"g{i % 7}", i) for i in range(2000)]
    made = A.stratified(spark.createDataFrame(rows, "g string, i long").repartition(5), ["g"], "i", 4, 3)
    made.explain("formatted")
    assert capsys.readouterr().out.count("WindowGroupLimit") >= 2
    got = {(r["g"], r["rank"]): r["i"] for r in made.collect()}
    chance = {r["i"]: r["h"] for r in spark.createDataFrame(rows, "g string, i long").withColumn("h", F.md5(F.concat(F.col("i").cast("string"), F.lit("#3")))).collect()}
    for g in {r[0] for r in rows}:
        own = sorted((i for h, i in rows if h == g), key=lambda i: (chance[i], i))[:4]
        assert [got.get((g, k + 1)) for k in range(len(own))] == own
