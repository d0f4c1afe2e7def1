"""Each query's columns, types and rules, on whole small tables, on odd rows and on empty tables."""

import hashlib
import re
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD
from tracelake.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_lines": {"doc_id": "bigint", "n_lines": "int", "n_kept": "int", "text": "string"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op6_image_copies": {"kind": "string", "id": "bigint", "other": "bigint", "inliers": "bigint"},
    "op7_decontamination": {"doc_id": "bigint", "item_id": "bigint", "n_item": "bigint", "n_shared": "bigint", "containment": "double"},
    "op8_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op11_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op12_mixture": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op13_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
}
TABLES = ("documents", "labels", "benchmark", "embeddings", "conversations")
PER_ROW = [q for q in COLUMNS if q not in ("op5_jaccard_join", "op6_image_copies", "op7_decontamination", "op11_repair")]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """The smallest tables with odd rows added, and columns whose names clash."""
    made = str(tmp_path_factory.mktemp("odd"))
    for name in TABLES:
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "documents":
            df = df.unionByName(spark.createDataFrame(ODD, df.schema))
        if name == "labels":
            df = df.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0), (2, 1, 0), (4, 0, 1)], df.schema))
        if name == "benchmark":
            df = df.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "no id"), (None, "a")], df.schema))
        if name == "conversations":
            df = df.unionByName(spark.createDataFrame([(None, None, None, None), (0, None, "user", ""), (0, 1, "", "a."), (0, 1, "tool", "b"), (9000, 4, None, "c")], df.schema))
        if name == "embeddings":
            df = df.unionByName(df.where("vec_id % 50 = 0")).unionByName(df.limit(3).withColumn("embedding", F.lit(None).cast(df.schema["embedding"].dataType))).unionByName(df.limit(1).withColumn("vec_id", F.lit(None).cast("long")))
        df.withColumns({c: F.lit("x") for c in ("score", "words", "h", "shard", "key", "tokens", "size", "h1", "family", "weight", "n")}).write.parquet(f"{made}/{name}.parquet")
    return made


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    made = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{made}/{name}.parquet")
    return made


@pytest.fixture(scope="module")
def results(spark, odd_dir):
    known = {}

    def get(name):
        if name not in known:
            known[name] = registry.QUERIES[name](spark, odd_dir).collect()
        return known[name]

    return get


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_empty_tables(spark, empty_dir, name):
    df = registry.QUERIES[name](spark, empty_dir)
    assert dict(df.dtypes) == COLUMNS[name] and df.count() == 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows(spark, odd_dir, results, name):
    rows = results(name)
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    if name in PER_ROW:
        assert len(rows) == docs.count()
    if name == "op5_jaccard_join":
        assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in docs.where("doc_id IS NOT NULL").select("doc_id").distinct().collect())
        assert all(r["component_id"] <= r["doc_id"] for r in rows)
    for r in rows:
        assert r.asDict().keys() == COLUMNS[name].keys()
        if "score" in COLUMNS[name]:
            assert 0 <= r["score"] <= 1
        if "held_out" in COLUMNS[name]:
            crc = zlib.crc32(str(r["doc_id"]).encode())
            assert r["held_out"] == (r["doc_id"] is not None and (crc % 5 == 0 if name == "op9_quality" else crc % 3 == 1))
        if "predicted" in COLUMNS[name]:
            assert r["predicted"] == int(r["score"] >= (0.3 if name == "op9_quality" else 0.7))


def test_undetermined(spark, odd_dir, results):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{odd_dir}/documents.parquet").where("doc_id > 8").select("doc_id", "text").collect()}
    langs = {r[0] for r in spark.read.parquet(f"{odd_dir}/documents.parquet").select("lang").distinct().collect()}
    for r in results("op1_language"):
        assert r["lang_pred"] in langs | {"und"}
        if r["doc_id"] in texts:
            letter = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == (not letter)


def test_shards(spark, odd_dir, results):
    rows = results("op4_sharding")
    per = {}
    for r in rows:
        per.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    sizes = [len(per.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    want = sorted(str((i, 8 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode()))) for i, t in spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in rows) == want


def test_licence_base(spark, odd_dir, results):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    want = []
    for i, text in spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        want.append(str((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))))
    rows = results("op8_licenses")
    assert sorted(str(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))) for r in rows) == sorted(want)
    for r in rows:
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(r["base_labels"].split(",")) - {""} <= set(labels)


def test_tokens(spark, odd_dir, results):
    import public_tokenizers
    import tiktoken

    from tracelake.llm import bpe

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, text in spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = own.encode_ordinary(text or "")
        want.append(str((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in results("op10_bpe")) == sorted(want)


def test_images(results):
    rows = results("op6_image_copies")
    members = [r for r in rows if r["kind"] == "member"]
    assert all(r["other"] <= r["id"] for r in members) and {r["kind"] for r in rows} <= {"member", "match"}


@pytest.mark.parametrize("which", ["odd_dir", "empty_dir"])
def test_pipeline(spark, request, which):
    """run() and every stage on odd rows and on empty tables; all stages but the last keep the columns."""
    sf_dir = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
    made = corpus_pipeline.run(spark, sf_dir)
    assert made.columns == ["doc_id", "n_tokens", "tokens", "round_trip"] and made.where(~F.col("round_trip")).count() == 0
    assert (made.count() > 0) == (which == "odd_dir")
