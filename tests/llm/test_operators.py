"""Corpus operators against brute force, exact round trips and held-out accuracy; and their edge cases."""

import collections
import hashlib
import itertools
import os
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import bpe, contamination, image_copies, jaccard_join, lang_id, licenses, licence_texts, line_dedup, quality, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty and very long texts, ties, repeated rows, and columns with clashing names.
ODD = [
    (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n\t", None, "s", 3), (4, "a", "en", None, 1), (4, "a", "en", None, 1),
    (5, "word " * 20_000, "en", "s", 100_000), (6, "x" * 50_000, "fr", "s", 50_000), (7, "ÄÖ 漢字 🙂\x1c²½", None, "s", 9), (None, "no id", "en", "s", 5), (8, "1 2 3", None, None, 5),
]
CLASH = ["words", "h", "score", "tokens", "decoded", "lang_pred", "keys", "key", "shard", "slot", "size", "kind", "family", "u", "v", "part", "known", "hashes", "x", "label", "weight"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(n, seed=1, vocabulary=400, size=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, size))) for _ in range(n)]


# 10 ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def test_bpe_matches_the_library(codec):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    made = ["".join(rng.choice(["ab", "a", " the", "Ü", "é", "漢字", "🙂", "\x1c", "²", " 12", "!?", "\n\n", "'ll", "_"]) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    made += ["a" * 5_000, "", " " * 300, "x" * 70 + " " + "é" * 90]
    for text, (n, ids, decoded) in zip(made, codec.joined(made), strict=True):
        want = own.encode_ordinary(text)
        assert [int(i) for i in ids.split()] == want and n == len(want) and decoded == text.encode()
        assert codec.encode(text) == want and codec.decode(want) == text.encode()


def test_bpe_frames(spark, odd, none):
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.digests(odd).collect()}
    assert len(bpe.digests(odd).collect()) == len(ODD)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1, 0]["ids_sha256"] == got[2, 0]["decoded_sha256"] == empty
    assert bpe.digests(none).count() == 0
    back = bpe.decode(bpe.encode(odd)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert bpe.encoded(odd).where(~F.col("round_trip")).count() == 0


def test_bpe_natively(spark, codec):
    some = {p: r for p, r in codec.ranks.items() if r < 700}
    words = ["there", " the", "inging", "é", "", "x", "erere"]
    df = spark.createDataFrame([(w, bytearray(w.encode())) for w in words], "w string, b binary")
    for r in df.select("w", bpe.merged_natively(F.col("b"), bpe.rank_maps(some, 37)).alias("p")).collect():
        assert [some[bytes(p)] for p in r["p"]] == bpe.merge_word(r["w"].encode(), some)


# 7 -------------------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, n=5, t=0.8):
    import re

    def shingles(text, n):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    out = set()
    for i, a in items:
        size = min(n, len(re.findall(r"[^\W_]+", (a or "").lower())))
        own = shingles(a, size)
        out |= {(d, i, len(own), len(own & shingles(b, size))) for d, b in docs if own and len(own & shingles(b, size)) >= t * len(own) - 1e-9}
    return out


def test_leaks(spark):
    rng = random.Random(3)
    items = [(i, t) for i, t in enumerate(texts(30, 5, 3000, 50))] + [(100, None), (101, ""), (102, "too few words"), (103, "Zwei Wörter"), (104, "..."), (105, "rareword"), (3, texts(30, 5, 3000, 50)[3])]
    docs = []
    for d in range(120):
        words = texts(1, 100 + d, 3000, 200)[0].split()
        if d % 2:
            part = (items[rng.randrange(30)][1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            words[3:3] = part
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "too few"), (504, "rather TOO few, words"), (505, "zwei   wörter. rareword"), (506, "few too words"), (503, items[3][1].upper().replace(" ", ", "))]
    df, it = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in contamination.leaks(df, it).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 20
    assert {x[:2] for x in got if x[1] > 100} == {(504, 102), (505, 103), (505, 105)}
    kept = {r["doc_id"] for r in contamination.decontaminate(df, it).collect()}
    assert kept == {d for d, _ in docs} - {x[0] for x in got}


def test_leaks_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "word word word word word")], "item_id long, text string")
    assert [(r["doc_id"], r["n_item"]) for r in contamination.leaks(odd, items).collect()] == [(5, 1)]
    assert contamination.leaks(none, items).count() == 0 and contamination.leaks(odd, items.limit(0)).count() == 0
    assert contamination.decontaminate(odd, items).count() == len(ODD) - 1


# 5 -------------------------------------------------------------------------------------------------------------------


def brute_components(rows, percent, n):
    """doc_id: (size of its largest set, smallest doc_id reachable); a document has the links of all its texts."""
    sets = []
    for i, t in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x1c", "\0").split() if x]
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    label = {i: i for i, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, own) in enumerate(sets):
        for k, other in sets[a + 1 :]:
            o = len(own & other)
            if i != k and o and 100 * o >= percent * (len(own) + len(other) - o):
                low, high = sorted((root(i), root(k)))
                label[high] = low
    return {i: (max(len(s) for k, s in sets if k == i), root(i)) for i in label}


@pytest.mark.parametrize(("family", "percent", "n", "local"), [(1 << 30, 85, 4, 1 << 20), (1_500, 80, 5, 1 << 20), (1 << 30, 80, 5, 0), (400, 85, 4, 1 << 20)])
def test_jaccard_join(spark, monkeypatch, family, percent, n, local):
    monkeypatch.setattr(jaccard_join, "FAMILY", family)
    monkeypatch.setattr(jaccard_join, "LOCAL_TIES", local)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    passage = " ".join(rng.choice(words) for _ in range(50))
    rows += [(200 + i, passage + " " + " ".join(rng.choice(words) for _ in range(30))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, "A b"), (303, "a  B\t"), (304, "a"), (3, rows[3][1]), (302, None)]
    df = spark.createDataFrame([*rows, (None, "a b c d")], "doc_id long, text string").repartition(4)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.joined(df, percent, n).collect()}
    assert got == brute_components(rows, percent, n)


@pytest.mark.parametrize("backwards", [False, True])
def test_ids_with_several_texts(spark, backwards):
    """A doc_id with two texts, of equal and of unequal size, has the links of both, in any order of rows."""
    rng = random.Random(9)
    made = lambda size: [f"x{rng.randrange(10**6)}" for _ in range(size)]
    changed = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, d, e = made(60), made(60), made(90), made(60), made(40)
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, changed(a)), (9, changed(b))]
    rows += [(5, " ".join(c)), (10, " ".join(c)), (10, " ".join(d)), (11, changed(d))]
    rows += [(20, " ".join(e)), (20, " ".join(made(80))), (20, None), (21, changed(e)), (21, changed(e)), (22, " ".join(made(50)))]
    df = spark.createDataFrame(rows[::-1] if backwards else rows, "doc_id long, text string").repartition(3)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.joined(df, 85, 4).collect()}
    assert got == brute_components(rows, 85, 4) and got[9][1] == 7 and got[11][1] == 5 and got[21][1] == 20
    kept = [r["doc_id"] for r in jaccard_join.keep_one(df, 85, 4).collect()]
    assert sorted(kept) == [5, 7, 20, 22]


def test_jaccard_odd(spark, odd, none):
    got = {r["doc_id"]: r for r in jaccard_join.joined(odd).collect()}
    assert got[5]["n_shingles"] == 1 and got[1]["n_shingles"] == 0 and got[4]["component_id"] == 4 and len(got) == 8
    assert jaccard_join.joined(none).count() == 0
    assert jaccard_join.keep_one(odd).columns == odd.columns


def test_prefixes_tie_links_and_not_passages(spark):
    """Linked sets are connected; sets that share a passage alone aren't."""
    rng = random.Random(15)
    new = lambda: rng.getrandbits(63)
    sets = []
    for _ in range(12):
        base = [new() for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 6)):
            sets.append({new() if rng.random() < 0.08 else x for x in base})
    passage = [new() for _ in range(30)]
    first = len(sets)
    sets += [{*passage, *(new() for _ in range(60))} for _ in range(20)]
    rows = [(i, bytearray(np.array(sorted(s), np.int64).tobytes())) for i, s in enumerate(sets)]
    for percent in (80, 85):
        ties = {tuple(r) for r in jaccard_join._prefix_ties(spark.createDataFrame(rows, "fp long, hashes binary"), percent).collect()}
        label = list(range(len(sets)))
        for _ in sets:
            for u, v in ties:
                label[u] = label[v] = min(label[u], label[v])
        for a, b in itertools.combinations(range(len(sets)), 2):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                assert label[a] == label[b]
        assert not any(u >= first or v >= first for u, v in ties)


def test_signatures_lose_no_link():
    rng = random.Random(7)
    for _ in range(400):
        n = rng.choice([rng.randint(1, 40), rng.randint(40, 500)])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(rng.randint(0, max(1, n // 8))):
            if rng.random() < 0.5 and len(b) > 1:
                b.discard(min(b))
            else:
                b.add(rng.getrandbits(64))
        arrays = [np.array(sorted(x), np.uint64) for x in (a, b)]
        link = 100 * len(a & b) >= 85 * len(a | b)
        assert (jaccard_join.linked(arrays)[1] == 0) == link
        if link:
            some = np.array(sorted(rng.sample(sorted(a), rng.randint(0, len(a)))), np.uint64)
            for hot, percent in ((None, 85), (some, 85), (some, 80), (None, 75)):
                text, sig = jaccard_join.signatures(np.array([0, len(a), len(a) + len(b)]), np.concatenate(arrays), percent, hot)
                assert a == b or set(sig[text == 0].tolist()) & set(sig[text == 1].tolist())


@pytest.mark.parametrize("percent", [75, 80, 85, 95])
def test_signatures_are_few(percent):
    rng = np.random.default_rng(3)
    for n in (4, 6, 9, 30, 100, 151, 1000, 20_000):
        text, sig = jaccard_join.signatures(np.array([0, n]), np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64)), percent)
        assert len(sig) <= 12 * n


def test_t_occurrence():
    rng = random.Random(8)
    for _ in range(100):
        lists = [np.array(sorted(rng.sample(range(30), rng.randint(1, 25)))) for _ in range(rng.randint(1, 12))]
        t = rng.randint(1, len(lists))
        counts = collections.Counter(int(x) for own in lists for x in own)
        want = {(m, c) for m, c in counts.items() if c >= t and m != 3}
        got = set(jaccard_join.t_occurrence(lists, t, np.arange(30), 3))
        assert {m for m, _ in got} == {m for m, _ in want} and all(c >= t for _, c in got)


# 1 -------------------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "bb": 5}
    rng = np.random.default_rng(1)
    prob = rng.random((8, 2)) / 4
    prob[-1] = 0

    def brute(s, k):
        if not s:
            return 1.0
        total = 0.0
        for n in range(1, len(s) + 1):
            p = prob[pieces[s[:n]], k] if s[:n] in pieces else prob[6, k] if n == 1 else 0
            total += p * brute(s[n:], k)
        return total

    words = ["a", "ab", "abb", "bab", "xab"]
    for places, ids in lang_id.lattices(words, pieces):
        out = lang_id.forward(ids, prob)[:, -1]
        for i, row in zip(places, out, strict=True):
            assert np.allclose(row, [brute("▁" + words[i], k) for k in (0, 1)])


def test_language(spark, odd, none):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "th", "er", "on"], "fr": ["eau", "oi", "é", "ment", "re"], "de": ["sch", "ung", "ei", "ch", "keit"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 4))) for _ in range(30)), k, "s", 0) for i in range(300) for k in [rng.choice(list(parts))]]
    docs = spark.createDataFrame(rows, DOCS)
    model = lang_id.fit(docs, ~lang_id.held_out())
    got = lang_id.predict(docs, model).toPandas()
    assert (got.lang == got.lang_pred)[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]].mean() > 0.95
    assert got.score.between(0, 1).all()
    strange = {(r["doc_id"], r["lang_pred"], r["score"]) for r in lang_id.predict(odd, model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (8, "und", 0.0)} <= strange
    signs = ["½ ② ²", "Ⅷ ٣ 12", "\u0301\u0902", "_ - 🙂", "ª", "हिन्दी", None, ""]
    lettered = [r["lang_pred"] != "und" for r in lang_id.predict(spark.createDataFrame([(i, x) for i, x in enumerate(signs)], "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    assert lettered == [False, False, False, False, True, True, False, False]
    assert lang_id.found_words("हिन्दी और X½y") == ["हिन्दी", "और", "x", "y"]
    plain = "".join(map(chr, range(0x250))) + "Añadió 3½ mètres_de×long " + "x" * 70
    assert lang_id._PLAIN(plain) == lang_id._BY_REGEX(plain)
    assert lang_id.predict(none, model).count() == 0
    nothing = lang_id.fit(none, ~lang_id.held_out())
    assert {r["lang_pred"] for r in lang_id.predict(docs, nothing).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    big = [(i, "common words here again " * 5, "en", "s", 0) for i in range(40)]
    rare = [(100 + i, f"{chr(97 + i) * 3}ovka {chr(98 + i) * 2}zka", "zz", "s", 0) for i in range(4)]
    assert lang_id.fit(spark.createDataFrame(big + rare, DOCS), F.lit(True), words=4).languages == ["en", "zz"]
    long = [(200 + i, "dlouha slova " * 2_000, "yy", "s", 0) for i in range(3)]
    assert lang_id.fit(spark.createDataFrame(big + long, DOCS), F.lit(True), chars=20).languages == ["en", "yy"]


# 2 -------------------------------------------------------------------------------------------------------------------


def test_templates():
    a = line_dedup.keys("On 5 May the price of apples was 17 euros in Rome")
    b = line_dedup.keys("On 6 May the price of apples was 18 euros in Rome")
    c = line_dedup.keys("On 6 May the price of apples was 18 euros in Paris")
    assert a[:-1] == b[:-1] and a[-1] != b[-1] and a[0] != c[0] and set(a) & set(c)  # the last is the line itself
    assert not set(a) & set(line_dedup.keys("On 6 May the cost of pears was 18 pounds in Paris"))
    assert set(line_dedup.keys("Posted by Anna on Monday")) & set(line_dedup.keys("Posted by Bob on Monday"))
    assert not set(line_dedup.keys("Click here to read")) & set(line_dedup.keys("Click there to read"))
    assert line_dedup.keys("") == line_dedup.keys(" \t") == [] and len(line_dedup.keys("one")) == 1
    long = "these are eight words in one whole line"
    assert [k % 2 for k in line_dedup.keys(long)] == [0] * 6 + [1] and all(k % 2 == 0 for k in line_dedup.keys(long[6:]))


def brute_lines(rows, min_docs=3):
    """doc_id: text after dedup, and whether the document stays."""
    holders: dict[tuple, set[int]] = {}
    units = lambda x: [("t", t) for t in line_dedup.templates(x)] + [("w", w) for w in [line_dedup.literal(x)] if w is not None]
    for i, text in rows:
        for line in (text or "").split("\n"):
            for u in units(line):
                holders.setdefault(u, set()).add(i)
    gone = {u: min(ids) for u, ids in holders.items() if len(ids) >= (2 if u[0] == "w" else min_docs)}
    return {i: text if text is None else "\n".join(x for x in text.split("\n") if all(gone.get(u, i) == i for u in units(x))) for i, text in rows}


def test_drop_lines(spark, odd, none):
    footer = "All rights reserved by the owners of this site since {}"
    rows = [(i, f"own text of document number {chr(97 + i) * 3} with words {chr(98 + i) * 4}\n{footer.format(1990 + i)}\nshort {chr(97 + i)}\nClick here to read", "en", "s", 0) for i in range(5)]
    rows += [(10, "a line of nine words that stands here twice\nnot twice", "en", "s", 0), (11, "other\na line of nine words that stands here twice", "en", "s", 0)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_lines([r[:2] for r in rows])
    assert len(got[0].split("\n")) == 4 and all(got[i].split("\n")[1:] == [f"short {chr(97 + i)}"] for i in range(1, 5)) and got[11] == "other"
    strange = line_dedup.drop_lines(odd)
    assert strange.columns == odd.columns and sorted(map(str, strange.select("text").collect())) == sorted(map(str, odd.select("text").collect()))
    assert line_dedup.drop_lines(none).count() == 0 and line_dedup.keep_unrepeated(none).count() == 0
    copies = spark.createDataFrame([(i, footer.format(7), "en", "s", 0) for i in range(4)], DOCS)
    kept = line_dedup.keep_unrepeated(copies).collect()
    assert [(r["doc_id"], r["n_chars"]) for r in kept] == [(0, 0)]


def test_lines_and_sql_of_odd_tables(spark, tmp_path):
    """Repeated and null ids, other spaces, several texts of one id: the operator's rows are the SQL's."""
    line = "this very line of nine words stands in many"
    rows = [(5, f"{line} places\nown five"), (5, f"five again\n{line} places"), (9, f"nine\n{line} places now"), (None, f"x\n{line} places"), (None, f"x\n{line} places"), (None, f"y y\n{line} places"), (None, "only two of us without an id hold\nz"), (None, "only two of us without an id hold\nw")]
    rows += [(20 + i, f"nbsp\u00a0joined words here count as one token {i}\na\x1cb c d e f g h\nv\x0bt f\x0cf of seven or more tokens") for i in range(4)] + [(None, None), (30, None), (31, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = line_dedup.op2_lines(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(line_dedup.ORACLE).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    texts = [r["text"] for r in got if r["doc_id"] is None]
    assert sorted(t for t in texts if t) == ["only two of us without an id hold\nz", "w", "x", "x", "y y"] or sorted(t for t in texts if t) == ["only two of us without an id hold\nw", "x", "x", "y y", "z"]
    kept = {r["doc_id"]: r["text"] for r in got if r["doc_id"] == 9}
    assert kept == {9: "nine\n" + line + " places now"}


def test_unnamed_documents_are_decontaminated(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, f"before {item} after", "en", "s", 0), (None, "clean", "en", "s", 0), (None, None, "en", "s", 0), (1, item, "en", "s", 0), (2, "clean", "en", "s", 0)], DOCS)
    kept = contamination.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, [(None, "clean"), (None, None), (2, "clean")]))
    assert kept.columns == docs.columns


def test_hot_templates_are_joined_apart(spark, monkeypatch):
    rows = [(i, f"the same line of nine words for every one\nline {chr(97 + i % 26)} of {chr(97 + i % 7)} stands in some others here", "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    want = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs).collect()}
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 3)
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs).collect()} == want == brute_lines([r[:2] for r in rows])


# 4 -------------------------------------------------------------------------------------------------------------------


def test_place_is_balanced():
    points, owner = sharding.ring(7, 8)
    counts = np.random.default_rng(1).integers(0, 9, len(points))
    counts[5] = 300
    made = sharding.place(counts, owner, 7)
    n = int(counts.sum())
    assert [r for f, k, _ in made for r in range(f, f + k)] == list(range(n))
    load = [sum(k for _, k, s in made if s == x) for x in range(7)]
    assert max(load) - min(load) <= 1


def test_sharding(spark, odd, none):
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"text {i}", "en", "s", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sharding.assign(docs).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 600 and len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = sharding.assign(docs.repartition(3)).toPandas()
    assert got.set_index("doc_id").shard.equals(again.set_index("doc_id").shard.reindex(got.doc_id))
    by_id = got.set_index("doc_id")
    assert by_id.loc[1, "text_crc32"] == zlib.crc32(b"text 1") and by_id.loc[1, "size"] == 14 and by_id.loc[0, "size"] == 8
    more = sharding.assign(docs, 25).toPandas().set_index("doc_id")
    plain = [i for i, t, *_ in rows if t and t != "hot"]
    assert (more.loc[plain, "shard"] != by_id.loc[plain, "shard"]).mean() < 0.5
    assert sharding.assign(odd).count() == len(ODD) and sharding.assign(none).count() == 0


# 8 -------------------------------------------------------------------------------------------------------------------


def test_licences(spark, odd, none):
    rng = random.Random(6)
    words = sorted({w.decode() for t in [*licenses.BASE, *(t for _, t in licenses.TEMPLATES)] for w in licenses.split(t)}) + ["zzz"] * 40
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE)
    for _ in range(300):
        tokens = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            tokens[rng.randint(0, len(tokens)) : 0] = rng.choice(list(licenses.BASE)).split()
        n, places, _ = scanner.scan(", ".join(tokens).upper())
        want = {(i, i + len(p.split()), x) for p, x in licenses.BASE.items() for i in range(len(tokens)) if tokens[i : i + len(p.split())] == p.split()}
        assert n == len(tokens) and set(places) == want and len(places) == len(want)
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0


def test_statistics_of_every_place():
    rng = random.Random(6)
    sequences = [[rng.randrange(3) for _ in range(12)] for _ in range(4)]
    automaton = licenses.Automaton(sequences)
    text = [rng.randrange(4) for _ in range(300)]
    same = lambda i, t, e: next(k for k in range(13) if k == min(i + 1, e) or text[i - k] != sequences[t][e - 1 - k])
    for i, (state, length) in enumerate(automaton.statistics(text)):
        want = {(t, e): k for t in range(4) for e in range(1, 13) if (k := same(i, t, e))}
        assert length == max(want.values(), default=0)
        got = {(t, e): k or length for t, e, k in automaton.places[state]} if length else {}
        assert got == want


def test_chains_cover_most():
    """The first chain covers as many words as the best of all chains."""
    rng = random.Random(11)
    for _ in range(400):
        matches = [(s, s + k, low, low + k) for _ in range(rng.randint(1, 7)) for s, low, k in [(rng.randrange(40), rng.randrange(25), rng.randint(3, 8))]]

        def value(chain):
            total, before = 0, None
            for s, e, low, high in chain:
                new = e - s
                if before:
                    bs, be, bl, bh = before
                    new -= max(0, be - s, bh - low)
                    if s - be > licenses.GAP or e <= be or low < bl or high <= bh or new <= 0:
                        return 0
                total, before = total + new, (s, e, low, high)
            return total

        ordered = sorted(matches)
        best = max(value(c) for n in range(1, len(ordered) + 1) for c in itertools.combinations(ordered, n))
        found = licenses.chains(matches)
        assert found[0][1] == best
        spans = sorted(x[0][:2] for x in found)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_repeated_notices_take_linear_time():
    """Twice as many notices in one text take about twice the time."""
    scanner, took = licenses.Scanner(licenses.TEMPLATES, licenses.BASE), []
    for n in (5_000, 40_000):
        began = time.process_time()
        _, places, spans = scanner.scan("This file is released under the mit license and you may use it. " * n)
        took.append(time.process_time() - began)
        assert len(places) == len(spans) == n
    assert took[1] < 24 * took[0], took


def test_whole_licences():
    """Each whole text gives its label, with a header, other line breaks and a word in fifty changed as well."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE)
    labels = lambda text: {s[2] for s in scanner.scan(text)[2] if s[3] >= licenses.COVER}
    for label, text in licence_texts.whole_texts():
        words = text.split()
        assert len(words) > 900 and labels(text) == {label}, label
        assert labels("Copyright 1999 by nobody. " + "\n".join(words)) == {label}
        assert labels(" ".join(w if i % 50 else "zzz" for i, w in enumerate(words))) == {label}


def test_cover_is_best():
    rng = random.Random(12)
    for _ in range(300):
        spans = [(s, s + rng.randint(1, 9), i, rng.randint(1, 9), 1.0) for i in range(rng.randint(0, 7)) for s in [rng.randrange(20)]]
        free = lambda c: all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2))
        best = max(sum(x[3] for x in c) for n in range(len(spans) + 1) for c in itertools.combinations(spans, n) if free(c))
        got = licenses.cover(spans)
        assert free(got) and sum(x[3] for x in got) == best


def test_licences_are_told_apart():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE)
    labels = lambda text: [(s[2], round(s[3], 2)) for s in scanner.scan(text)[2] if s[3] >= licenses.COVER]
    for label, text in licenses.TEMPLATES:
        assert labels(f"Some words, before. {text.upper()} - some words after it")[0][0] == label, text
        words = licenses.split(text)
        if len(words) > 40:  # one word in twenty changed, and words put between
            spoilt = b" ".join(w if i % 20 else b"zzz yyy" for i, w in enumerate(words)).decode()
            assert {x for x, _ in labels(spoilt)} <= {label, label.split("-")[0]} and labels(spoilt)
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."
    assert labels(lesser) == [("lgpl-3", 1.0)]
    assert {x for x, _ in labels(f"{licenses.TEMPLATES[0][1]} and then {licenses.TEMPLATES[3][1]}")} == {"mit", "isc"}
    assert labels("the license you may use this software for any purpose") == [] and scanner.scan(None) == (0, [], [])
    _, _, spans = scanner.scan("Intro. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files. End")
    assert max(spans, key=lambda s: s[3])[2] == "mit"


# 3 and 9 -------------------------------------------------------------------------------------------------------------


def brute_kinds(symbols):
    """(place, kind) of the matches, by their definitions."""
    T = toxicity  # noqa: N806
    ends, out = (T.BREAK, T.LINE, T.COLON), []

    def near(i, step, what, reach):
        words, k = 0, i + step
        while 0 <= k < len(symbols) and symbols[k] not in ends and words < reach:
            if symbols[k] == what:
                return True
            words, k = words + (symbols[k] != T.QUOTE), k + step
        return False

    def reported(i):
        state = 0
        for s in symbols[:i]:
            if s == T.LINE or s == T.BREAK and state == 1 or s == T.QUOTE and state == 2:
                state = 0
            elif s == T.QUOTE and state == 1:
                state = 2
            elif s == T.REPORT and state == 0:
                state = 1
        if state:
            return True
        for s in symbols[:i:-1]:  # backwards: a verb, then in its clause the end of a quotation
            if s == T.LINE or s in ends and state == 1 or s == T.QUOTE and state == 2:
                state = 0
            elif s == T.QUOTE and state == 1:
                state = 2
            elif s == T.REPORT and state == 0:
                state = 1
        return state == 2

    for i, s in enumerate(symbols):
        if s in (T.INSULT, T.THREAT):
            aimed = near(i, -1, T.TARGET, T.REACH) or near(i, 1, T.TARGET, T.REACH)
            if reported(i):
                out.append((i, T.REPORTED))
            elif near(i, -1, T.NEGATION, 3):
                out.append((i, T.NEGATED))
            elif s == T.THREAT:
                out += [(i, T.THREATENED)] * aimed
            else:
                out.append((i, T.TARGETED if aimed else T.PILED if near(i, -1, T.INSULT, T.REACH) else T.PLAIN))
    return out


def test_grammar_against_its_definitions():
    words = {toxicity.OTHER: "calm", toxicity.BREAK: ".", toxicity.LINE: "\n", toxicity.COLON: ":", toxicity.QUOTE: '"', toxicity.INSULT: "idiot", toxicity.THREAT: "kill", toxicity.INTENT: "will", toxicity.TARGET: "you", toxicity.NEGATION: "not", toxicity.REPORT: "said"}
    m = toxicity.Matcher({})
    for n in range(1, 5):
        for symbols in itertools.product(words, repeat=n):
            if toxicity.INSULT in symbols or toxicity.THREAT in symbols:
                assert [(i, k) for i, k, _ in m.matches(" ".join(map(words.get, symbols)))] == brute_kinds(symbols), symbols
    rng = random.Random(1)
    for _ in range(20_000):
        symbols = rng.choices(list(words), [6, 1, 1, 1, 3, 4, 3, 1, 2, 1, 2], k=rng.randint(5, 16))
        assert [(i, k) for i, k, _ in m.matches(" ".join(map(words.get, symbols)))] == brute_kinds(symbols), symbols


def test_grammar():
    m = toxicity.Matcher({"blorg": 1.0, "snarf*": 1.0, "snarfing*": 0.0})
    kinds = lambda t: [k for _, k, _ in m.matches(t)]
    assert kinds("the blorg came") == [toxicity.PLAIN] and kinds("you are a blorg") == [toxicity.TARGETED]
    assert kinds("it is not blorg") == [toxicity.NEGATED] and kinds("he wrote that all was blorg") == [toxicity.REPORTED]
    assert kinds("i will kill you") == kinds("you i kill") == kinds("kill a b c you") == [toxicity.THREATENED]
    assert m.matches("i will kill you")[0][2] > m.matches("kill you")[0][2]
    assert kinds("blorg, you came") == [toxicity.TARGETED] and kinds("kill you blorg") == [toxicity.THREATENED, toxicity.TARGETED]
    assert kinds("idiots are you") == [toxicity.TARGETED] and kinds("a blorg and moron") == [toxicity.PLAIN, toxicity.PILED]
    assert kinds("kill. you") == kinds("kill a b c d you") == kinds("i will kill") == [] and kinds("blorg! you came") == [toxicity.PLAIN]
    assert kinds("he said i will kill you") == [toxicity.REPORTED] and kinds("i will not kill you") == [toxicity.NEGATED]
    assert kinds("he said: you are an idiot") == kinds("he said \u201cfine. you idiot\u201d") == kinds('"you idiot", he said') == [toxicity.REPORTED]
    assert kinds("he said so. you are an idiot") == kinds("he said \u201cfine\u201d. you idiot") == kinds("he said\nyou idiot") == [toxicity.TARGETED]
    assert kinds("snarfed snarfingly calm") == [toxicity.PLAIN] and kinds(None) == kinds("") == kinds("calm words") == []


def labelled(spark, n, text, seed):
    rng = random.Random(seed)
    rows = [(i, text(rng, i % 3 == 0), "en", "s", 0) for i in range(n)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd, none):
    neutral = [f"n{chr(97 + i)}{chr(97 + j)}o" for i in range(26) for j in range(10)]
    docs, labels = labelled(spark, 600, lambda r, bad: " ".join(r.choice(neutral) for _ in range(40)) + (" grumpf." if bad else "."), 3)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = toxicity.score(docs, model).toPandas().set_index("doc_id").score
    assert min(got[i] for i in range(0, 600, 3)) > 0.7 > max(got[i] for i in range(600) if i % 3)
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == len(ODD) and toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, labels.limit(0), F.lit(True)).lexicon == {}


def test_quality(spark, odd, none):
    good = lambda r: " ".join(r.choice(["calm", "river", "stone", "walks", "under", "Trees"]) + str(r.random())[2:3] * 0 for _ in range(40)) + "."
    docs, labels = labelled(spark, 900, lambda r, bad: " ".join(["###", "BUY!!", "$$$"] * 20) if bad else good(r), 4)
    model = quality.fit(docs, labels, F.col("doc_id") % 5 != 0)
    assert 0.5 < model.prior < 0.85
    got = quality.score(docs, model).toPandas().set_index("doc_id").score
    assert max(got[i] for i in range(0, 900, 3)) < 0.3 < min(got[i] for i in range(900) if i % 3)
    assert quality.score(odd, model).where("score between 0 and 1").count() == len(ODD) and quality.score(none, model).count() == 0
    assert quality.score(odd, quality.fit(none, labels.limit(0), F.lit(True))).where("score = 0.5").count() == len(ODD)


# 6 -------------------------------------------------------------------------------------------------------------------


def test_image_copies(spark):
    rng = np.random.default_rng(1)

    def picture():
        x = np.zeros((96, 96))
        for _ in range(40):
            a, b = rng.integers(0, 86, 2)
            h, w = rng.integers(5, 30, 2)
            x[a : a + h, b : b + w] += rng.normal(0, 60)
        return np.clip(x + 128, 0, 255).astype(np.uint8)

    rows = []
    for i in range(10):
        p = picture()
        rows += [(50 * i, 96, 96, p.tobytes()), (50 * i + 1, 76, 76, p[10:86, 14:90].tobytes()), (50 * i + 2, 96, 96, np.clip(p * 0.7 + 30, 0, 255).astype(np.uint8).tobytes()), (50 * i + 3, 96, 96, np.rot90(p).copy().tobytes()), (50 * i + 7, 96, 96, picture().tobytes())]
    rows += [(5001, 96, 96, rows[0][3]), (5002, None, 3, None), (5003, 10, 10, b"x" * 100), (5004, 96, 96, b"\0" * 9216), (5005, 5, 5, b"bad")]
    df = spark.createDataFrame([(a, b, c, None if d is None else bytearray(d)) for a, b, c, d in rows], "id long, width int, height int, pixels binary")
    got = image_copies.copies(df, F.col("id") % 50 == 0).toPandas()
    members, found = got[got.kind == "member"], got[got.kind == "match"]
    assert len(members) == len(rows) and members.set_index("id").other[5001] == 0
    assert {(r.id, r.other) for r in found.itertuples()} >= {(50 * i, 50 * i + k) for i in range(10) for k in (1, 2)}
    assert all(r.other // 50 == r.id // 50 and r.other % 50 in (0, 1, 2, 3) for r in found.itertuples())
    assert len(found) >= 27 and image_copies.copies(df.limit(0), F.lit(True)).count() == 0


def test_all_near_descriptors_meet(spark):
    """Every pair of descriptors within DISTANCE bits is met once, by shuffle and in tables of a task."""
    rng = np.random.default_rng(5)
    base = rng.random((40, image_copies.BITS)) < 0.5
    bits = np.concatenate([base, *(np.array([b ^ np.isin(np.arange(image_copies.BITS), rng.permutation(image_copies.BITS)[:k]) for b in base]) for k in range(20))])
    rows = [(i, 0, 0, 0.0, 0.0, 0, 0.0, *map(int, x)) for i, x in enumerate(zip(*image_copies.packed(bits), strict=True))]
    made = spark.createDataFrame(rows, image_copies._COLUMNS)
    apart = (bits[:40, None] != bits[None]).sum(2)
    want = {(q, i) for q in range(40) for i in range(len(bits)) if q != i and apart[q, i] <= image_copies.DISTANCE}
    found = image_copies.near(made, made.where("id < 40")).select("q_id", "id").collect()
    assert len(want) == 40 * 16 and len(found) == len(want) and {tuple(r) for r in found} == want
    words = np.stack(image_copies.packed(bits), 1)
    tables = image_copies.Tables((np.arange(40), *[np.zeros(40)] * 6, *words[:40].T))
    met = list(zip(*(x.tolist() for x in tables.met(words)), strict=True))
    assert len(met) == len(set(met)) and {(q, i) for q, i in met if q != i} == want


def turned(x, degrees, zoom=1.0):
    """x turned about its centre and resized, bilinearly; what lies outside is the middle grey."""
    h, w = (round(s * zoom) for s in x.shape)
    a = np.radians(degrees)
    yy, xx = np.mgrid[:h, :w]
    dy, dx = (yy - (h - 1) / 2) / zoom, (xx - (w - 1) / 2) / zoom
    sy, sx = np.cos(a) * dy + np.sin(a) * dx + (x.shape[0] - 1) / 2, -np.sin(a) * dy + np.cos(a) * dx + (x.shape[1] - 1) / 2
    inside = (sy >= 0) & (sx >= 0) & (sy <= x.shape[0] - 1) & (sx <= x.shape[1] - 1)
    y0, x0 = sy.clip(0, x.shape[0] - 2).astype(int), sx.clip(0, x.shape[1] - 2).astype(int)
    fy, fx = sy - y0, sx - x0
    v = (x[y0, x0] * (1 - fy) + x[y0 + 1, x0] * fy) * (1 - fx) + (x[y0, x0 + 1] * (1 - fy) + x[y0 + 1, x0 + 1] * fy) * fx
    return np.where(inside, v, 128).round().clip(0, 255).astype(np.uint8)


EDITS = {
    "crop": lambda x, rng: x[20:100, 50:150],
    "small crop of a large picture": lambda x, rng: x[100:170, 90:160],
    "brightness": lambda x, rng: (x * 0.7 + 30).astype(np.uint8),
    "noise": lambda x, rng: (x + rng.normal(0, 3, x.shape)).clip(0, 255).astype(np.uint8),
    "quarter turn": lambda x, rng: np.ascontiguousarray(np.rot90(x)),
    "turn by 17 degrees": lambda x, rng: turned(x, 17),
    "turn by 45 degrees": lambda x, rng: turned(x, 45),
    **{f"resized to {z}": lambda x, rng, z=z: turned(x, 0, z) for z in (0.9, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5, 0.4, 1.2, 1.5)},
    "resized to 0.8 and turned by 30 degrees": lambda x, rng: turned(x, 30, 0.8),
    "resized to 0.8, in blocks of 8 grey values": lambda x, rng: turned(x, 0, 0.8) // 8 * 8,
    "crop of a tenth": lambda x, rng: x[60:124, 60:124],
    "crop at 0.8": lambda x, rng: turned(x[20:160, 30:170], 0, 0.8),
}


def textured(rng, side=200):
    noise = rng.normal(0, 1, (1, side, side))
    for _ in range(4):
        noise = image_copies._smooth(noise)
    return (noise[0] / noise.std() * 50 + 128).clip(0, 255).astype(np.uint8)


def test_edited_copies_are_found(spark):
    """Recall by kind of edit, on pictures of which every one matches its copies alone."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(6):
        p = textured(rng)
        rows += [(50 * i, p)] + [(50 * i + 1 + k, edit(p, rng)) for k, edit in enumerate(EDITS.values())]
    df = spark.createDataFrame([(i, x.shape[1], x.shape[0], bytearray(np.ascontiguousarray(x).tobytes())) for i, x in rows], "id long, width int, height int, pixels binary").repartition(4)
    found = image_copies.copies(df, F.col("id") % 50 == 0).where("kind = 'match'").collect()
    assert all(r["id"] // 50 == r["other"] // 50 for r in found)
    recall = {name: sum((50 * i, 50 * i + 1 + k) in {(r["id"], r["other"]) for r in found} for i in range(6)) / 6 for k, name in enumerate(EDITS)}
    print(recall)
    assert all(r >= 0.9 for r in recall.values()), recall


@pytest.mark.parametrize("most", [10**6, 0])
def test_consensus_against_brute_force(spark, monkeypatch, most):
    """The matches are those of a comparison of all pairs of corners, bit by bit."""
    monkeypatch.setattr(image_copies, "QUERY_DESCRIPTORS", most)
    rng = np.random.default_rng(9)
    base = [textured(rng, 96) for _ in range(8)]
    pictures = base + [(x * 0.8 + y * 0.2).astype(np.uint8) for x, y in zip(base, base[1:] + base[:1], strict=True)] + [turned(x, 10) for x in base]
    df = spark.createDataFrame([(i, 96, 96, bytearray(x.tobytes())) for i, x in enumerate(pictures)], "id long, width int, height int, pixels binary")
    got = {(r["id"], r["other"]): r["inliers"] for r in image_copies.copies(df, F.col("id") < 8).where("kind = 'match'").collect()}
    made = [image_copies.described(x[None]) for x in pictures]
    want = {}
    room = max(image_copies.SHIFT, 96 * image_copies.SPREAD)
    both = lambda v, wide, around=0: [(h, int(np.floor(v / wide + h / 2)) % (around or 1 << 60)) for h in (0, 1)]
    for q in range(8):
        _, qx, qy, ql, qa, qb = image_copies.described(pictures[q][None], between=True)
        for i in range(len(pictures)):
            _, x, y, level, a, b = made[i]
            votes, near = {}, np.argwhere((qb[:, None] != b[None]).sum(2) <= image_copies.DISTANCE) if q != i else []
            for m, n in near:
                turn, s = (a[n] - qa[m]) % 360, 2.0 ** ((level[n] - ql[m]) / 4)
                t = np.radians(turn)
                dx, dy = x[n] - s * (np.cos(t) * qx[m] - np.sin(t) * qy[m]), y[n] - s * (np.sin(t) * qx[m] + np.cos(t) * qy[m])
                for cell in itertools.product(both(level[n] - ql[m], image_copies.SCALE), both(turn, image_copies.TURN, 9), both(dx, room), both(dy, room)):
                    votes.setdefault(cell, set()).add(m)
            most = max((len(v) for v in votes.values()), default=0)
            if most >= image_copies.INLIERS or most >= max(image_copies.FEW, image_copies.SHARE * len({m for m, _ in near})):
                want[q, i] = most
    assert len(want) >= 8
    wrong = {k for k in got.keys() | want.keys() if got.get(k) != want.get(k)}
    assert len(wrong) <= 0.1 * len(want), wrong  # 32-bit places may fall on the other side of a bound


def written(spark):
    """The files in Spark's local folders and in the checkpoint folder, with their bytes."""
    local = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    tops = [*local, spark.conf.get("spark.checkpoint.dir")]
    return {f"{d}/{x}": os.path.getsize(f"{d}/{x}") for top in tops for d, _, names in os.walk(top) for x in names}


@pytest.mark.parametrize("most", [10**6, 300])
def test_pictures_are_not_shuffled(spark, monkeypatch, most):
    """However many queries there are, disk takes hashes and the queries' descriptors, neither pictures nor all descriptors."""
    monkeypatch.setattr(image_copies, "QUERY_DESCRIPTORS", most)
    rng = np.random.default_rng(11)
    pictures = [textured(rng, 80) for _ in range(600)]
    for i in range(0, 600, 100):
        pictures[i + 1], pictures[i + 2] = (pictures[i] * 0.8 + 20).astype(np.uint8), pictures[i]
    df = spark.createDataFrame([(i, 80, 80, bytearray(x.tobytes())) for i, x in enumerate(pictures)], "id long, width int, height int, pixels binary").repartition(4).localCheckpoint()
    before = written(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of any size
    try:
        rows = image_copies.copies(df, F.col("id") % 100 == 0).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    took = sum(size for file, size in written(spark).items() if file not in before)
    assert {(r["id"], r["other"]) for r in rows if r["kind"] == "match"} == {(i, i + 1) for i in range(0, 600, 100)}
    assert {(r["id"], r["other"]) for r in rows if r["kind"] == "member" and r["id"] != r["other"]} == {(i + 2, i) for i in range(0, 600, 100)}
    assert took < 600 * 6400 / 4, took


@pytest.mark.parametrize("rows, join", [(10**6, "LeftAnti, BuildRight"), (8, "LeftSemi, BuildRight"), (0, "LeftSemi, BuildRight")])
def test_classes_are_told_apart_without_moving_pictures(spark, monkeypatch, rows, join):
    """Copies or other images go to all tasks, or what pictures are drawn from is shuffled: the result is the same."""
    monkeypatch.setattr(image_copies, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(12)
    v = rng.normal(0, 1, (6, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v[i % 6].tolist()) for i in range(18)] + [(50, (v[1] + 0.003).tolist())], "vec_id long, embedding array<float>").repartition(3)
    plans, search = [], image_copies.searched_in_groups
    monkeypatch.setattr(image_copies, "searched_in_groups", lambda images, asked: plans.append(images._jdf.queryExecution().toString()) or search(images, asked))
    got = image_copies.copies(df.withColumnRenamed("vec_id", "id"), F.col("id") % 50 == 13, lambda x: image_copies.drawn(x.withColumnRenamed("id", "vec_id"))).collect()
    assert sorted((r["id"], r["other"]) for r in got if r["kind"] == "member") == sorted([(i, i % 6) for i in range(18)] + [(50, 50)])
    assert {(r["id"], r["other"]) for r in got if r["kind"] == "match"} == {(1, 50)}
    lines = plans[0].partition("== Physical Plan ==")[2].splitlines()
    at = next(i for i, x in enumerate(lines) if join in x)
    assert ("BroadcastHashJoin" if rows else "ShuffledHashJoin") in lines[at]
    assert rows or any("ArrowEvalPython" in x for x in lines[:at])
    assert not rows or not any("Exchange hashpartitioning" in x for x in lines[:at])


def test_near_bits_and_runs():
    rng = np.random.default_rng(13)
    numbers = rng.integers(0, 1 << 24, 50)
    known = np.zeros(1 << 24, bool)
    known[numbers] = True
    near = np.unpackbits(image_copies._near_bits(np.packbits(known, bitorder="little")), bitorder="little")
    assert set(np.flatnonzero(near).tolist()) == {int(n) ^ f for n in numbers for f in (0, *(1 << k for k in range(24)))}
    assert list(image_copies._runs(np.array([1, 2, 9, 0, 3, 1]), 4)) == [(0, 2), (2, 3), (3, 6)]
    assert list(image_copies._runs(np.array([], np.int64), 4)) == []


@pytest.mark.parametrize("compared, looked", [(1, 1), (50, 2000)])
def test_tables_in_small_pieces(monkeypatch, compared, looked):
    """Matches don't depend on how many pairs are compared or looked through at once."""
    rng = np.random.default_rng(14)
    pictures = np.stack([textured(rng, 80) for _ in range(6)])
    noisy = (pictures + rng.normal(0, 2, pictures.shape)).clip(0, 255).astype(np.uint8)
    image, x, y, level, angle, bits = image_copies.described(pictures, True)
    tables = image_copies.Tables((image.astype(np.int64), None, None, x, y, level, angle, *image_copies.packed(bits)))
    image, x, y, level, angle, bits = image_copies.described(noisy)
    seen = (image.astype(np.int64) + 100, np.full(len(image), 80), x, y, level, angle, np.stack(image_copies.packed(bits), 1))
    want = sorted(tables.agreed(*seen))
    monkeypatch.setattr(image_copies, "COMPARED", compared)
    monkeypatch.setattr(image_copies, "LOOKED", looked)
    assert [r[:2] for r in want] == [(i, i + 100) for i in range(6)] and sorted(tables.agreed(*seen)) == want


def test_drawn_vectors(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(0, 1, (6, 64))
    v = np.concatenate([v, v + rng.normal(0, 0.03, v.shape)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(20, None), (21, []), (22, [1.0, None]), (0, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = image_copies.copies(image_copies.drawn(df), F.col("id") < 6)
    assert {(r["id"], r["other"]) for r in got.where("kind = 'match'").collect()} == {(i, i + 6) for i in range(6)}
    assert got.where("kind = 'member'").count() == len(rows)


# Brute force of the learned models and of the ring -------------------------------------------------------------------


def test_expected_counts_of_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "bb": 5}
    rng = np.random.default_rng(2)
    prob = rng.random((8, 1)) / 4
    prob[-1] = 0

    def cuts(s):
        if not s:
            yield 1.0, []
        for n in range(1, len(s) + 1):
            i = pieces.get(s[:n], 6 if n == 1 else None)
            if i is not None:
                for p, rest in cuts(s[n:]):
                    yield p * prob[i, 0], [i, *rest]

    words, weight = ["abb", "aab", "bbx"], np.array([3.0, 1.0, 2.0])
    want = np.zeros(8)
    for w, k in zip(words, weight, strict=True):
        all_cuts = list(cuts("▁" + w))
        total = sum(p for p, _ in all_cuts)
        for p, ids in all_cuts:
            for i in ids:
                want[i] += k * p / total
    got = sum(lang_id.expected(ids, weight[places], prob) for places, ids in lang_id.lattices(words, pieces))
    assert np.allclose(got, want)


def test_learning_raises_the_likelihood():
    words = collections.Counter("the cat sat on the mat and the rat sat on that hat".split())
    pieces = {p: i for i, p in enumerate(sorted({w[i:j] for w in [f"▁{w}" for w in words] for i in range(len(w)) for j in range(i + 1, min(len(w), i + 4) + 1)}))}

    def likelihood(model):
        return sum(words[w] * np.log(lang_id.forward(ids, model.prob)[k, -1, 0]) for places, ids in lang_id.lattices(list(words), pieces) for k, w in enumerate(np.array(list(words))[places]))

    found = [likelihood(lang_id.learn({"en": dict(words)}, pieces, rounds)) for rounds in (1, 2, 4, 8)]
    assert found == sorted(found)


def test_verdicts_are_posteriors():
    model = lang_id.learn({"xx": {"aba": 5, "ab": 3}, "yy": {"bab": 5, "ba": 3}}, {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba"])})
    scorer = lang_id.Scorer(model)
    for text in ("ab aba", "bab", "ab ba bab aba q"):
        total = np.zeros(2)
        for w in text.split():
            (_, ids), = lang_id.lattices([w], model.pieces)
            total += np.log(lang_id.forward(ids, model.prob)[0, -1])
        p = np.exp(total) / np.exp(total).sum()
        (lang, score), = scorer.verdicts([text])
        assert lang == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-9
    tied = lang_id.Scorer(lang_id.learn({"b": {"a": 1}, "a": {"a": 1}}, {"▁": 0, "a": 1}))
    assert list(tied.verdicts(["a"])) == [("a", 0.5)]


def test_risk_and_its_gradient(monkeypatch):
    """The descent follows the gradient of the non-negative risk, by finite differences; and steps back where that is negative."""
    rng = np.random.default_rng(4)
    p, u = rng.normal(1, 1, (60, 4)), rng.normal(0, 1, (80, 4))
    caught = []
    monkeypatch.setattr(quality, "_descend", lambda gradient, size: caught.append(gradient) or np.zeros(size))
    quality.minimised(p, u, 0.4)
    loss = lambda z: np.log1p(np.exp(-z))

    def parts(w):
        return 0.4 * loss(p @ w).mean(), loss(-(u @ w)).mean() - 0.4 * loss(-(p @ w)).mean()

    seen = set()
    for k in range(60):
        w = rng.normal(0, 0.1 + k / 10, 4)
        positive, negative = parts(w)
        seen.add(negative < 0)
        numeric = np.array([(lambda a, b: (sum(a) - sum(b) if negative >= 0 else b[1] - a[1]) / 2e-6)(parts(w + e), parts(w - e)) for e in np.eye(4) * 1e-6])
        assert np.allclose(caught[0](w), numeric, atol=1e-5)
    assert False in seen


def test_prior_is_found():
    rng = np.random.default_rng(5)
    for prior in (0.2, 0.5, 0.8):
        p = np.c_[rng.normal(2, 1, (3000, 2)), np.ones(3000)]
        mixed = rng.random(3000) < prior
        u = np.c_[np.where(mixed[:, None], rng.normal(2, 1, (3000, 2)), rng.normal(-2, 1, (3000, 2))), np.ones(3000)]
        assert abs(quality.estimated_prior(p, u) - prior) < 0.06


def test_ring_against_single_rows():
    """Runs of rows are placed as row after row would be: owners first, then what overflows, clockwise."""
    rng = random.Random(3)
    for shards in (1, 2, 5, 24):
        points, owner = sharding.ring(shards, 8)
        counts = np.array([rng.choice([0, 0, 1, 5, 60]) for _ in range(len(points) + 1)])
        own = np.append(owner, owner[0])
        rows = [a for a, n in enumerate(counts) for _ in range(n)]
        room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
        want: list = [None] * len(rows)
        for r, a in enumerate(rows):
            if room[own[a]]:
                room[own[a]] -= 1
                want[r] = int(own[a])
        for r, a in enumerate(rows):
            at = a
            while want[r] is None:
                at = (at + 1) % len(own)
                if room[own[at]]:
                    room[own[at]] -= 1
                    want[r] = int(own[at])
        got = [s for _, n, s in sharding.place(counts, own, shards) for _ in range(n)]
        assert got == want


def test_one_more_shard_moves_few():
    points = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50_000))
    placed = []
    for shards in (24, 25):
        at, owner = sharding.ring(shards)
        counts = np.bincount(np.searchsorted(at, points, "left"), minlength=len(at) + 1)
        placed.append(np.array([s for _, n, s in sharding.place(counts, np.append(owner, owner[0]), shards) for _ in range(n)]))
    assert 1 / 25 <= (placed[0] != placed[1]).mean() < 0.1
