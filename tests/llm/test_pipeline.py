"""The pipeline against a plain version of each stage, on the smallest table."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_components, brute_leaks, brute_lines
from tracelake.llm import lang_id

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    kept = corpus_pipeline.language(spark, docs, SF).cache()
    scorer = lang_id.Scorer(lang_id.fit(docs, ~lang_id.held_out()))
    rows = docs.collect()
    judged = dict(zip([r["doc_id"] for r in rows], scorer.verdicts([r["text"] for r in rows]), strict=True))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (lang, score) in judged.items() if lang != "und" and score >= 0.5}

    lines = corpus_pipeline.lines(spark, kept, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = {i: text for i, text in brute_lines(list(texts.items())).items() if text.strip() or not texts[i].strip()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want and lines.columns == columns

    near = corpus_pipeline.near_duplicates(spark, lines, SF).cache()
    groups = brute_components(list(want.items()), 80, 5)
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, root) in groups.items() if i == root}

    clean = corpus_pipeline.benchmark(spark, near, SF).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {x[0] for x in brute_leaks([(r["doc_id"], r["text"]) for r in near.collect()], items)}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - leaks

    made = corpus_pipeline.tokens(spark, clean, SF)
    assert made.where(~F.col("round_trip")).count() == 0 and made.count() == clean.count()


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "tokens"]
