"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm import brute_repair
from tests.llm.test_operators import DOCS, ODD
from tracelake.llm import conversation_repair, merkle, mixing

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# 11 ------------------------------------------------------------------------------------------------------------------


def test_cheapest_edits():
    rng = random.Random(3)
    trie = conversation_repair.Trie(0)
    for _ in range(5000):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "", "user"]), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(0, 14))]
        trie.go("".join(conversation_repair.symbol(r[:1], f) for r, f in rows))
        assert trie.edits(conversation_repair.END)[:2] == brute_repair.cheapest(rows), rows


def test_layers_are_made_once_for_a_shared_prefix():
    trie = conversation_repair.Trie(0)
    for signature in ("suaua", "suauad", "suaux", "u"):
        trie.go(signature)
    assert trie.made == 5 + 1 + 1 + 1


def repaired(spark, df):
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.damaged(df), df).collect()}
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    damaged = brute_repair.damaged(rows)
    hashes = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(t,) for t in {r[3] for r in damaged}], "t string").select("t", F.xxhash64("t"), F.xxhash64(F.lit(11), "t")).collect()}
    assert got == brute_repair.repair(damaged, {r[0] for r in rows}, hashes.get)
    return got


def test_repair_of_the_table(spark):
    assert len(repaired(spark, spark.read.parquet(f"{SF}/conversations.parquet"))) > 0


def test_repair_of_odd_rows(spark):
    odd = [(None, None, None, None), (None, 1, "user", ""), (7, None, "user", "Hi."), (7, None, "assistant", "Yes."), (7, 3, "", "x."), (7, 3, "tool", "x"), (7, 9, "user", "  \n"), (7, -2, "system", "S!"), (8, 0, "user", "ok.  ")]
    odd += [(9, 5, "user", "same.")] * 7 + [(10, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(50)]
    df = spark.createDataFrame(odd, TURNS).withColumns({c: F.lit("x") for c in ("part", "row", "chunk", "fault", "audit", "conv")})
    assert len(repaired(spark, df)) == 5 and repaired(spark, df.limit(0)) == {}


@pytest.mark.parametrize("chunk", [1, 5])
def test_repair_of_long_conversations(spark, monkeypatch, chunk):
    """Conversations of many chunks and of blocks that are cut."""
    monkeypatch.setattr(conversation_repair, "CHUNK", chunk)
    monkeypatch.setattr(conversation_repair, "BLOCK", 64)
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "user", "assistant"]), rng.choice(["a.", "b", "", "c! ", "d?", "x" * 100]) + rng.choice(["", "1."])) for c, n in ((1, 160), (2, 13), (3, 3)) for t in range(n)]
    repaired(spark, spark.createDataFrame(rows, TURNS))


# 12 ------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, full = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in full}
        left = total - sum(full.values())
        made = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s for s, t in made.items() if t > 3 * sizes[s]}
        if not over:
            return full | made
        full |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice(["", "é", "Z", "src"]) + str(i): int(10 ** rng.uniform(0, 5)) for i in range(12)} | {None: 7, "": 40}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_tilts_solve_the_dual(spark):
    """Each source's words are its target at the tilt found, whether it shrinks, grows or stays; none is above the cap."""
    rng = random.Random(1)
    sized = [(s, int(rng.lognormvariate(4, 1.5)) + 1) for s in ("a", "b", "c", "d", "e", "f") for _ in range(300)]
    of = pd.DataFrame(sized, columns=["source", "size"])
    share = {"a": 1e-4, "b": 0.3, "c": 1.0, "d": 1.7, "e": 2.999, "f": 3.0}
    words = of.groupby("source")["size"].sum()
    counts = spark.createDataFrame(of.groupby(["source", "size"]).size().reset_index(name="n"))
    wanted = spark.createDataFrame([(s, int(words[s]), 300, float(share[s] * words[s])) for s in share], "source string, source_size long, docs long, target double")
    for r in mixing.balanced(counts, wanted).collect():
        rates = [min(3.0, math.exp(min(r["tilt"] * n, 9.0))) for s, n in sized if s == r["source"]]
        got = sum(x * n for x, n in zip(rates, of[of.source == r["source"]]["size"], strict=True))
        assert got == pytest.approx(r["target"], rel=1e-6), r
        assert (r["tilt"] > 0) == (share[r["source"]] > 1) and (r["tilt"] == 0) == (share[r["source"]] == 1)


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).toPandas()
    known = docs.select("doc_id", "source", "text").toPandas()
    known["size"] = [len(brute_words(t)) for t in known.text]
    sizes = known.groupby("source")["size"].sum().to_dict()
    targets = brute_targets(sizes)
    merged = got.merge(known[["doc_id", "source", "size"]], on="doc_id", suffixes=("", "_own"))
    assert len(merged) == len(known) and (merged["size"] == merged["size_own"]).all() and (merged.taken == merged.copies * merged["size"]).all()
    assert merged.copies.between(0, 3).all() and (merged.source_size == merged.source.map(sizes)).all()
    assert merged.target.to_dict() == pytest.approx(merged.source.map(targets).to_dict())
    for source, own in merged.groupby("source"):
        assert own.taken.sum() == pytest.approx(targets[source], rel=0.01), source
    again = mixing.mix(docs.repartition(7, F.rand())).toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, again.to_numpy().tolist()))


def brute_words(text):
    return [w for w in "".join(" " if c in brute_repair.SPACES else c for c in text or "").split(" ") if w]


def test_mix_of_odd_rows(spark):
    df = spark.createDataFrame([*ODD, *ODD[:3], (77, "a b", None, None, 0), (78, None, None, None, 0), (None, "c d e", None, "s", 0)], DOCS)
    df = df.withColumns({c: F.lit("x") for c in ("size", "target", "rank", "key", "tilt", "band", "bin")})
    got = mixing.mix(df).collect()
    assert len(got) == df.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    bare = mixing.mix(df.where("text is null")).collect()
    assert bare and all(r["size"] == r["taken"] == 0 and r["target"] == 0 for r in bare)


# 13 ------------------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes, fanout):
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([sha("".join(made[-1][i : i + fanout])) for i in range(0, len(made[-1]), fanout)])
    return made


def siblings(made, i, fanout):
    """(before, after) of each level."""
    out = []
    for nodes in made[:-1]:
        start = i - i % fanout
        out.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + fanout])))
        i //= fanout
    return out


def brute_manifest(rows, fanout):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d: sha("".join(field(d[f]) for f in merkle.FIELDS))
    by = {}
    for d in rows:
        by.setdefault(d["lang"], []).append(d)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d)))
        trees[lang] = own, tree([leaf(d) for d in own], fanout)
    top = tree([trees[lang][1][-1][0] for lang in langs], fanout)
    out = []
    for k, lang in enumerate(langs):
        own, made = trees[lang]
        for i, d in enumerate(own):
            proof = siblings(made, i, fanout) + siblings(top, k, fanout)
            bent = d["doc_id"] is not None and d["n_chars"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
            node = leaf(d | {"n_chars": d["n_chars"] + 1} if bent else d)
            for before, after in proof:
                node = sha(before + node + after)
            out.append((d["doc_id"], made[0][i], made[-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), node))
    return out


def shown(df):
    bent = merkle.leaf([(F.col("n_chars") + 1) if f == "n_chars" else f for f in merkle.FIELDS])
    return df.select(F.col("lang").alias("g"), F.col("doc_id").alias("id"), merkle.leaf(list(merkle.FIELDS)).alias("leaf"), F.when(merkle.tampered(), bent).alias("presented"))


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 2), (2, 8), (3, 9), (16, 16)])
def test_manifest(spark, monkeypatch, fanout, block):
    """Whole trees in one block, and in blocks of blocks with ragged ends."""
    monkeypatch.setattr(merkle, "BLOCK", block)
    df = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(ODD, DOCS)).repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("rank", "total", "g", "block", "id")})
    rows = [r.asDict() for r in df.collect()]
    got = merkle.manifest(shown(df), fanout).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest(rows, fanout)))
    assert merkle.manifest(shown(df.limit(0)), fanout).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_manifest_of_few_rows_and_many_languages(spark, n):
    df = spark.createDataFrame([(i, "t", None if i == 0 else f"l{i % n}", "s", 1) for i in range(3 * n)], DOCS)
    got = merkle.manifest(shown(df)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest([r.asDict() for r in df.collect()], 2)))


def test_equal_rows_are_leaves_each(spark):
    df = spark.createDataFrame([(1, "t", "en", "s", 1)] * 9 + [(None, None, None, None, None)] * 3, DOCS)
    got = merkle.manifest(shown(df)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_manifest([r.asDict() for r in df.collect()], 2)))
