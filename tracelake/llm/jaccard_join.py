"""N-gram Jaccard join with exact components: which texts share nearly all of their word shingles.

A document's set is its distinct shingles of four words (the whole sequence if it is shorter), as 64-bit hashes. Two
documents link when |A ∩ B| / |A ∪ B| reaches the threshold; the result has the set size and the component of each.

1. *Candidates, without a list of pairs.* Sets are cut into m disjoint hash ranges. Linked sets of sizes a and b differ
   in at most k = a + b - 2 * need(a + b) shingles, so with m > k ranges at least m - k ranges agree exactly. m depends
   on a size class; a document takes part in its own class and, where a smaller partner could lie in the class below, in
   that one too. A range that agrees gives the same signature, a hash of the range's content; empty ranges give none,
   and a document with too many empty ranges for the argument takes part again under further cuts. Shingles that at
   least HOT of all documents hold, as passages that many share, are left out of the content first, which keeps the
   argument and keeps strangers apart; a document that has too few others falls back on its whole content.
2. *Stars.* The nodes are distinct sets, by a fingerprint: equal texts are one node, whatever their number. Within a batch
   and then within a bucket of signatures, every holder of a signature is tied to the least fingerprint that holds it, so a
   signature held by a third of all documents costs one row per holder and batch at most.
3. *Families.* Connected components of these ties, by min-label propagation over tables.
4. *T-occurrence search in each family.* An inverted index over the family's sets; each set queries it with the overlap T
   that its partner's size requires: short lists are heap-merged, the longest are binary-probed (DivideSkip), and those
   reaching T are links. Partners already in the same component are passed over, so copies don't cost all pairs.
   Families of more than FAMILY shingles are first cut up by rare shingles, see :func:`_prefix_ties`, and those that are
   still as large are thinned by leaders, see :func:`_thinned`.
5. *Documents.* The sets of one doc_id are tied to each other, and a component is named after the smallest doc_id in it.

Everything is exact up to 64-bit hash collisions; no candidate, partner or bucket is capped.

Defined results: null and blank texts have n_shingles 0 and are their own component. Rows that repeat a doc_id count as
one document: its links are those of all its texts, and n_shingles is that of the largest set. Rows whose doc_id is null
are left out. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import cut, held, slices, small, table, tidy

WORDS, PERCENT = 4, 85
#: Share of documents from which a shingle is hot. There are at most (mean set size) / HOT such shingles, whatever the
#: number of documents; which of them are known affects the work, never the result.
HOT, HOT_MOST = 0.001, 500_000
#: Cuts tried without hot shingles; ties that one task may connect by itself (16 bytes each).
COLD_CUTS, LOCAL_TIES = 3, 2_000_000
#: Members of short lists that are merged by a heap; more by a sort that merges runs.
HEAP = 64
#: Shingles of a family that one task searches by itself, about 50 bytes each; larger families are dealt into parts.
FAMILY = 200_000
#: Bytes of text that are hashed together, and signatures that are grouped together before they leave a task.
CHUNK, HELD = 1 << 17, 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    made = _POWERS.get(int(base))
    if made is None or len(made) < n:
        made = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 1 << 16), base))])
        _POWERS[int(base)] = made
    return made


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the text that each belongs to."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.array([len(x) + 1 for x in raw])
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    if not len(starts):
        return np.zeros(0, np.uint64), owner
    value = mix(_LOWER[data] + np.uint64(1))
    out = ends - starts
    hashed = mix(out.astype(np.uint64))
    for base in (_BASE, _BASE2):  # sum of byte value times a power that counts from the word's start, by runs
        place = np.arange(len(data)) - np.repeat(np.concatenate([[0], ends]), np.diff(np.concatenate([[0], ends, [len(data)]])))
        first = starts - np.concatenate([[0], ends[:-1]])
        inside = ~space
        power = _powers(base, int(out.max()) + 1)
        at = (place - np.repeat(np.concatenate([first, [0]]), np.diff(np.concatenate([[0], ends, [len(data)]]))))[inside]
        term = value[inside] * power[at]
        bounds = np.concatenate([[0], np.cumsum(out)[:-1]])
        hashed = mix(hashed ^ np.add.reduceat(term, bounds))
    return hashed, owner


def shingle_sets(raw: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): text i has the sorted distinct hashes[offsets[i]:offsets[i + 1]]."""
    hashed, owner = word_hashes(raw)
    count = np.bincount(owner, minlength=len(raw))
    if not len(hashed):
        return np.zeros(len(raw) + 1, np.int64), np.zeros(0, np.uint64)
    made, own = [], []
    if len(hashed) >= n:
        whole = np.flatnonzero(owner[: len(hashed) - n + 1] == owner[n - 1 :])
        h = np.full(len(whole), n, np.uint64)
        for k in range(n):
            h = mix(h * _BASE + hashed[whole + k])
        made.append(h)
        own.append(owner[whole])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            h = np.full(len(short), size, np.uint64)
            for k in range(size):
                h = mix(h * _BASE + hashed[first[short] + k])
            made.append(h)
            own.append(short)
    h, o = np.concatenate(made), np.concatenate(own)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    h, o = h[fresh], o[fresh]
    return np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(raw)))]), h


def fingerprints(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set, from all its hashes."""
    total = np.concatenate([[np.uint64(0)], np.add.accumulate(mix(hashes ^ _BASE))])
    return mix((total[offsets[1:]] - total[offsets[:-1]]) ^ mix(np.diff(offsets).astype(np.uint64))).view(np.int64)


def need(total: np.ndarray | int, percent: int = PERCENT):
    """Least overlap of two linked sets whose sizes add up to total: 100 * o >= percent * (total - o)."""
    return -(-percent * total // (100 + percent))


def classes(percent: int = PERCENT, top: int = 1 << 40) -> np.ndarray:
    """Least set size of each size class; classes grow by half, so no partner is more than one class away."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2, -(-out[-1] * 100 // percent)))
    return np.array(out, np.int64)


_CLASSES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _plan(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per class of the smaller partner: its least size, the most shingles k in which partners differ, and m ranges."""
    if percent < 75:
        raise ValueError("a similarity of less than 0.75 leaves too little in common for signatures")
    if percent not in _CLASSES:
        least = classes(percent)
        small_most = np.append(least[1:] - 1, least[-1])
        big_most = small_most * 100 // percent
        # the difference a + b - 2 * need(a + b) grows with a + b but for steps of 2
        k = np.maximum(small_most + big_most - 2 * need(small_most + big_most, percent), small_most + big_most - 1 - 2 * need(small_most + big_most - 1, percent))
        k = np.maximum(k, 0)
        # so many ranges that a set of the class fills more than k of them as a rule: m * (1 - exp(-least / m)) of them
        m, wanted = k + 2, k + 1 + np.sqrt(k)
        while (thin := (m * -np.expm1(-least / m) < wanted) & (m < 4 * least)).any():
            m = np.where(thin, m + np.maximum(1, m // 32), m)
        _CLASSES[percent] = least, k, m
    return _CLASSES[percent]


def signatures(offsets: np.ndarray, hashes: np.ndarray, percent: int = PERCENT, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) rows such that linked texts have one in common. hot: sorted hashes to leave out where possible."""
    least, ks, ms = _plan(percent)
    size = np.diff(offsets)
    texts, found = [], []
    own = np.searchsorted(least, size, "right") - 1
    cold_offsets, cold = offsets, hashes
    if hot is not None and len(hot):
        keep = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] != hashes
        cold, cold_offsets = hashes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    for below in (0, 1):
        c = own - below
        lowest = -(-size * percent // 100)  # least size of a partner
        part = np.flatnonzero((size > 0) & (c >= 0) & ((below == 0) | (lowest < least[np.maximum(own, 0)])))
        part = part[ks[c[part]] > 0]  # else partners have equal sets
        for salt in range(1 << 30):
            if not len(part):
                break
            at, content = (cold_offsets, cold) if salt < COLD_CUTS else (offsets, hashes)
            m, k, reps = ms[c[part]], ks[c[part]], np.diff(at)[part]
            ends = np.cumsum(reps)
            if not ends[-1]:
                continue
            h = content[np.arange(int(ends[-1])) - np.repeat(ends - reps, reps) + np.repeat(at[part], reps)]
            slot = h if salt in (0, COLD_CUTS) else mix(h ^ mix(np.full(1, salt, np.uint64)))
            bucket = ((slot >> np.uint64(32)) * np.repeat(m, reps).astype(np.uint64)) >> np.uint64(32)
            row = np.repeat(np.arange(len(part)), reps)
            body = mix(h ^ _BASE2)
            if salt not in (0, COLD_CUTS):
                order = np.lexsort((bucket, row))
                bucket, row, body = bucket[order], row[order], body[order]
            start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
            total, row, bucket = np.add.reduceat(body, start), row[start], bucket[start]
            sig = mix(total ^ mix(bucket * _BASE ^ (c[part][row].astype(np.uint64) << np.uint64(40)) ^ np.uint64(salt)))
            texts.append(part[row])
            found.append(sig)
            full = np.bincount(row, minlength=len(part))
            part = part[full <= k]  # all agreeing ranges could be empty ones
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(texts), np.concatenate(found)


def _frequent(percent: int, n: int):
    """Texts to (h, n): shingles that stand out within each HELD shingles, with the number of texts that hold them."""

    def flush(held: list[np.ndarray], docs: int) -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(held), return_counts=True)
        often = count >= max(4, HOT * docs)
        return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(count[often])], ["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard_join", dict)  # lets go of what other operators kept
        parts, docs, count = [], 0, 0
        for batch in slices(batches):
            for ids, raw in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = shingle_sets(raw, n)[1]
                parts.append(hashes)
                docs, count = docs + len(ids), count + len(hashes)
                if count >= 4 * HELD:
                    yield flush(parts, docs)
                    parts, docs, count = [], 0, 0
        if parts:
            yield flush(parts, docs)

    return run


def hot_shingles(docs: DataFrame, percent: int, n: int) -> np.ndarray:
    """Sorted hashes of the hot shingles of all documents."""
    total = docs.count()
    counted = docs.mapInArrow(tidy(_frequent(percent, n)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, HOT * total))
    found = counted.orderBy(F.desc("n"), "h").limit(HOT_MOST).toPandas()["h"].to_numpy(np.int64)  # at most HOT_MOST, see HOT
    return np.sort(found.view(np.uint64))


def _chunks(ids: list, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """ids and encoded texts, so many bytes at a time."""
    held, raw, size = [], [], 0
    for i, text in zip(ids, texts, strict=True):
        held.append(i)
        raw.append((text or "").encode())
        size += len(raw[-1])
        if size >= CHUNK:
            yield np.array(held, np.int64), raw
            held, raw, size = [], [], 0
    if held:
        yield np.array(held, np.int64), raw


def stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, centre, doc) in order of key: each holder with the smallest holder of its key."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    if not len(key):
        return key, doc, doc
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key, np.repeat(doc[start], np.diff(np.append(start, len(key)))), doc


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (smallest member, member) with the same components as the ties (u, v)."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            away = label != np.arange(len(ids))
            return ids[label[away]], ids[away]
        label = after


#: Kinds of rows: sizes and fingerprints of documents; ties of fingerprints; signatures on their way to a bucket.
SIZE, TIE, SIGNED = 0, 1, 2
_ROW = "bucket int, kind int, a binary, b binary, c binary"


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _signed(buckets: int, percent: int, n: int, hot):
    """Texts to rows of _ROW, grouped within each HELD signatures already."""

    def flush(docs: list, sizes: list, fps: list, owners: list, sigs: list) -> Iterator[pa.RecordBatch]:
        doc = np.concatenate(docs)
        some = int(doc[0]) % buckets
        out = [(some, SIZE, doc, np.concatenate(sizes), np.concatenate(fps))]
        if sigs:
            key, centre, tied = stars(np.concatenate(sigs), np.concatenate(owners))
            away = centre != tied
            if away.any():
                out.append((some, TIE, *forest(centre[away], tied[away]), doc[:0]))
            # the centre of a signature goes on
            fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            key, centre = key[fresh], centre[fresh]
            bucket = _bucket(key, buckets)
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else fresh
            out += [(int(bucket[s]), SIGNED, key[s:e], centre[s:e], doc[:0]) for s, e in zip(start, [*start[1:], len(key)], strict=False)]
        arrays = [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), *(pa.array([r[i].tobytes() for r in out], pa.binary()) for i in (2, 3, 4))]
        yield pa.RecordBatch.from_arrays(arrays, ["bucket", "kind", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard_join", dict)
        parts: list[list] = [[], [], [], [], []]
        count = 0
        for batch in slices(batches):
            for ids, raw in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                offsets, hashes = shingle_sets(raw, n)
                size = np.diff(offsets)
                fp = fingerprints(offsets, hashes)
                _, first = np.unique(fp, return_index=True)  # equal sets have the same signatures
                lead = np.zeros(len(ids), bool)
                lead[first] = True
                text, sig = signatures(offsets, hashes, percent, hot.value)
                keep = lead[text]
                for to, x in zip(parts, (ids, size, fp, fp[text[keep]], sig[keep]), strict=True):
                    to.append(x)
                count += int(keep.sum())
                if count >= HELD:
                    yield from flush(*parts)
                    parts, count = [[], [], [], [], []], 0
        if parts[0]:
            yield from flush(*parts)

    return run


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _ROW in order of bucket, to (kind, u, v, w): documents as (SIZE, doc, size, fingerprint), ties as (TIE, u, v, 0)."""

    def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], ["kind", "u", "v", "w"])

    def grouped(signed: list) -> None:
        nonlocal count
        if signed:
            _, centre, tied = stars(np.concatenate([p[0] for p in signed]), np.concatenate([p[1] for p in signed]))
            away = centre != tied
            ties.append((centre[away], tied[away]))
            count += int(away.sum())

    def joined_ties() -> Iterator[pa.RecordBatch]:
        nonlocal count
        if count:
            u, v = forest(np.concatenate([x[0] for x in ties]), np.concatenate([x[1] for x in ties]))
            yield out(TIE, u, v, np.zeros(len(u), np.int64))
        ties.clear()
        count = 0

    at, signed, ties, count = None, [], [], 0
    for batch in batches:
        for bucket, kind, a, b, c in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != at:
                grouped(signed)
                at, signed = bucket, []
                if count >= HELD:
                    yield from joined_ties()
            if kind == TIE:
                ties.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))
                count += len(a) // 8
            elif kind == SIZE:
                yield out(SIZE, *(np.frombuffer(x, np.int64) for x in (a, b, c)))
            else:
                signed.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)))
    grouped(signed)
    yield from joined_ties()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) ties of a task to (doc, root)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        root, doc = forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        top = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([doc, top])), pa.array(np.concatenate([root, top]))], ["doc", "root"])


def components(ties: DataFrame) -> DataFrame:
    """(doc, root): smallest member reachable, of every document in (u, v) ties.

    Up to LOCAL_TIES ties, by a count, are connected in one task; more by min-label propagation with shortcuts.
    """
    ties = cut(ties.select("u", "v").distinct())
    if ties.limit(LOCAL_TIES + 1).count() <= LOCAL_TIES:
        return cut(ties.coalesce(1).mapInArrow(tidy(_forests), "doc long, root long"))
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = cut(ties.select(F.inline(both)))
    roots = cut(edges.groupBy(F.col("u").alias("doc")).agg(F.min("v").alias("root")).select("doc", F.least("doc", "root").alias("root")))
    while True:
        # a document takes the least root among its neighbours' and its own, then the root of that root
        offered = edges.join(roots, edges["v"] == roots["doc"]).select(F.col("u").alias("doc"), "root").union(roots)
        low = cut(offered.groupBy("doc").agg(F.min("root").alias("root")))
        jump = low.select(F.col("doc").alias("root"), F.col("root").alias("further"))
        after = cut(low.join(jump, "root", "left").select("doc", F.least("root", F.coalesce("further", "root")).alias("root")))
        changed = after.join(roots.withColumnRenamed("root", "before"), "doc").where(F.col("root") != F.col("before")).limit(1).count()
        roots = after
        if not changed:
            return roots


def t_occurrence(lists: list[np.ndarray], t: int, labels: np.ndarray, own: int, mu: float = 0.01) -> Iterator[tuple[int, int]]:
    """DivideSkip: members of at least t of the sorted lists whose label isn't `own`, with their number of occurrences.

    The longest lists are set aside; the rest are heap-merged for members that occur at least t minus so many times, and
    those are binary-probed in the lists set aside.
    """
    lists = sorted(lists, key=len)
    aside = min(t - 1, max(0, int(t / (mu * np.log2(max(len(lists[-1]), 2)) + 1)))) if lists else 0
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    short = [x[labels[x] != own] for x in short]
    if sum(map(len, short)) <= HEAP:
        merged = np.fromiter(heapq.merge(*(x.tolist() for x in short)), np.int64)
    else:
        merged = np.sort(np.concatenate(short), kind="stable")  # merges the sorted runs, as the heap does
    member, count = np.unique(merged, return_counts=True)
    reached = count >= t - aside
    member, count = member[reached], count[reached]
    for left, x in zip(range(len(long), 0, -1), reversed(long), strict=True):
        able = count + left >= t
        member, count = member[able], count[able]
        if not len(member):
            return
        k = np.searchsorted(x, member)  # binary probes of all members at once
        count = count + (x[np.minimum(k, len(x) - 1)] == member)
    done = count >= t
    yield from zip(member[done].tolist(), count[done].tolist(), strict=True)


def linked(sets: list[np.ndarray], labels: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """Label of each set: the position of the first set of its component. Sets are sorted arrays of hashes; labels may
    say which sets are known to be connected."""
    sizes = np.array([len(s) for s in sets])
    labels = np.arange(len(sets)) if labels is None else labels.copy()
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    end, keys = np.append(start[1:], len(flat)), flat[start]
    shared = end - start > 1
    for i in range(len(sets)):
        # a pair is met from its smaller side, where an overlap of need(2 * size) is a must
        at = np.searchsorted(keys, sets[i])
        at, t = at[shared[at]], max(1, int(need(2 * sizes[i], percent)))
        if len(at) < t:
            continue
        for j, common in t_occurrence([owner[start[k] : end[k]] for k in at.tolist()], t, labels, labels[i]):
            if 100 * common >= percent * (sizes[i] + sizes[j] - common) and labels[j] != labels[i]:
                low, high = sorted((labels[i], labels[j]))
                labels[labels == high] = low
    return labels


def _families(percent: int):
    """(family, part, known, fp, hashes) in order of family and part, to (u, v): exact links, by component."""

    def solved(rows: dict[int, tuple[int, bytes]]) -> pa.RecordBatch:
        fp = np.array(sorted(rows), np.int64)
        known = np.array([rows[x][0] for x in fp.tolist()], np.int64)
        first = np.unique(known, return_index=True, return_inverse=True)
        labels = linked([np.frombuffer(rows[x][1], np.uint64) for x in fp.tolist()], first[1][first[2]], percent)
        away = fp[labels] != fp
        return pa.RecordBatch.from_arrays([pa.array(fp[labels[away]]), pa.array(fp[away])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard_join", dict)
        at, rows = None, {}
        for batch in batches:
            for family, part, known, fp, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, part) != at:
                    if len(rows) > 1:
                        yield solved(rows)
                    at, rows = (family, part), {}
                rows[fp] = known, blob
        if len(rows) > 1:
            yield solved(rows)

    return run


def _blobs(n: int):
    """(doc_id, fp, family, text) to (fp, family, hashes) of the texts that have the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard_join", dict)
        for batch in slices(batches):
            at = 0
            for ids, raw in _chunks(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                offsets, hashes = shingle_sets(raw, n)
                own = np.flatnonzero(fingerprints(offsets, hashes) == batch.column(1).slice(at, len(ids)).to_numpy())
                blobs = [hashes[offsets[i] : offsets[i + 1]].tobytes() for i in own]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(at, len(ids)).take(pa.array(own)) for k in (1, 2)] + [pa.array(blobs, pa.binary())], ["fp", "family", "hashes"])
                at += len(ids)

    return run


def _searched(rows: DataFrame, percent: int) -> DataFrame:
    """(family, part, known, fp, hashes) to exact links (u, v), each (family, part) in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("family", "part", "known", "fp", "hashes").repartition(parts, "family", "part").sortWithinPartitions("family", "part")
    return dealt.mapInArrow(tidy(_families(percent)), "u long, v long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, hashes) to (h, fp, n): each shingle of a set, with the set's size."""
    for batch in batches:
        for fp, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h = np.frombuffer(blob, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), fp, np.int64)), pa.array(np.full(len(h), len(h), np.int64))], ["h", "fp", "n"])


def _prefix_ties(sets: DataFrame, percent: int) -> DataFrame:
    """Ties (u, v) of sets (fp, hashes) such that linked sets are connected, by the prefix principle: with shingles in one order for
    all sets, linked sets have one in common among the first n - ceil(n * percent / 100) + 1 of each. In the order rare
    shingles come first, so sets that share but a passage, however many do, aren't tied."""
    tokens = sets.select("fp", "hashes").mapInArrow(tidy(_tokens), "h long, fp long, n long")
    known = tokens.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # of each set the shingles that others have too; its own ones come before them
    shared = tokens.join(known, "h").groupBy("fp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("ts"))
    asked = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("ts"))
    prefix = cut(shared.where(asked > 0).select("fp", F.explode(F.slice("ts", F.lit(1), asked.cast("int"))).alias("t")).select("fp", F.col("t.h").alias("h")))
    centres = prefix.groupBy("h").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("h", "u")
    return prefix.join(centres, "h").where(F.col("fp") != F.col("u")).select("u", F.col("fp").alias("v"))


def _thinned(sets: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """Exact links (u, v) that yield the components of families too large for one task; no pair of sets goes unexamined
    unless both are known to be in one component. weights: (family, weight), the shingles of each family.

    First, a family is dealt into parts of about FAMILY shingles, with the same few leaders in each: nearly all copies
    join their leader's component. The sets outside the family's largest component, in chunks of FAMILY shingles, are then
    searched against every part.
    """
    salt = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    sized = cut(sets.join(small(weights.select("family", F.ceil(F.col("weight") / FAMILY).cast("int").alias("parts"))), "family"))
    # some eight leaders, however many parts there are
    counted = cut(sized.groupBy("family").agg(F.count("*").alias("n")))
    leaders = cut(sized.select("family", "fp").join(small(counted), "family").where(F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n")) < 8).select("family", "fp"))
    led = sized.join(small(leaders), ["family", "fp"], "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = sized.withColumn("part", salt).unionByName(led).withColumn("known", F.col("fp"))
    links = cut(_searched(first, percent))
    roots = components(links)
    rooted = cut(sized.select("family", "fp", "parts", F.octet_length("hashes").alias("size")).join(small(roots.withColumnRenamed("doc", "fp")), "fp", "left").withColumn("known", F.coalesce("root", "fp")).drop("root"))
    largest = rooted.groupBy("family", "known").count().groupBy("family").agg(F.max_by("known", F.struct("count", "known")).alias("largest"))
    rest = cut(rooted.join(small(cut(largest)), "family").where(F.col("known") != F.col("largest")).select("family", "fp", "size"))
    chunks = cut(rest.groupBy("family").agg(F.ceil(F.sum("size") / (8 * FAMILY)).cast("int").alias("chunks")))
    known = sized.join(small(rooted.select("fp", "known")), "fp").join(small(chunks), "family")
    chunk = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("chunks")).cast("int")
    told = known.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: salt * F.col("chunks") + c)))
    asked = known.join(small(rest.select("family", "fp")), ["family", "fp"], "left_semi").withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p * F.col("chunks") + chunk)))
    return links.unionByName(_searched(told.unionByName(asked), percent))


def joined(docs: DataFrame, percent: int = PERCENT, n: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = spark.sparkContext.broadcast(hot_shingles(docs, percent, n))
    signed = docs.mapInArrow(tidy(_signed(4 * parts, percent, n, hot)), _ROW)
    tied = cut(signed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_tied), "kind int, u long, v long, w long"))
    rows = tied.where(F.col("kind") == SIZE).select(F.col("u").alias("doc_id"), F.col("v").alias("n_shingles"), F.when(F.col("v") > 0, F.col("w")).alias("fp"))
    sets = cut(rows.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("n")))
    family = components(tied.where(F.col("kind") == TIE)).select(F.col("doc").alias("fp"), F.col("root").alias("family"))
    members = cut(sets.join(small(family), "fp").select("fp", "doc_id", "n_shingles", "family"))
    weights = cut(members.groupBy("family").agg(F.sum("n_shingles").alias("weight")))
    some = members.join(small(weights), "family").select("doc_id", "fp", "family", "weight")
    blobs = lambda which: docs.join(small(cut(some.where(which).drop("weight"))), "doc_id").select("doc_id", "fp", "family", "text").mapInArrow(tidy(_blobs(n)), "fp long, family long, hashes binary")
    links = _searched(blobs(F.col("weight") <= FAMILY).withColumn("part", F.lit(0)).withColumn("known", F.col("fp")), percent)
    if weights.where(F.col("weight") > FAMILY).limit(1).count():
        whole = cut(blobs(F.col("weight") > FAMILY).select("fp", "hashes").dropDuplicates(["fp"]))
        parted = components(_prefix_ties(whole, percent)).select(F.col("doc").alias("fp"), F.col("root").alias("family"))
        sized = cut(whole.join(small(parted), "fp").select("fp", "family", (F.octet_length("hashes") / 8).cast("long").alias("n")))
        weights = cut(sized.groupBy("family").agg(F.sum("n").alias("weight")))
        chosen = cut(sized.join(small(weights), "family").select("fp", "family", "weight"))
        of = lambda which: whole.join(small(chosen.where(which).select("fp", "family")), "fp").select("fp", "family", "hashes")
        links = links.unionByName(_searched(of(F.col("weight") <= FAMILY).withColumn("part", F.lit(0)).withColumn("known", F.col("fp")), percent))
        large = weights.where(F.col("weight") > FAMILY)
        if large.limit(1).count():
            links = links.unionByName(_thinned(cut(of(F.col("weight") > FAMILY)), large, percent))
    # the sets of one document are in one component
    several = rows.groupBy("doc_id").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).where(F.col("u") != F.col("top")).select("doc_id", "u")
    own = rows.join(small(several), "doc_id").where(F.col("fp") != F.col("u")).select("u", F.col("fp").alias("v"))
    roots = components(cut(links.unionByName(own))).select(F.col("doc").alias("fp"), "root")
    # the name of each set's component, where it isn't the one document that has it
    first = cut(sets.join(small(roots), "fp", "left").where((F.col("n") > 1) | F.col("root").isNotNull()).select("fp", F.coalesce("root", "fp").alias("root"), "doc_id"))
    named = cut(first.join(small(first.groupBy("root").agg(F.min("doc_id").alias("component_id"))), "root").select("fp", "component_id"))
    found = rows.join(small(named), "fp", "left").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """docs without near duplicates: of each component one row of the smallest doc_id stays, of several such rows the one of the
    greatest text. Rows of a null doc_id stay."""
    found = joined(docs, percent, n)
    gone = cut(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    kept = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    repeated = cut(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.limit(1).count():
        return kept
    # a table with a key has no such rows; elsewhere only they are compared
    order = F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns))
    several = kept.join(small(repeated), "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), order).alias("r")).select("r.*")
    return kept.join(small(repeated), "doc_id", "left_anti").unionByName(several).select(docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM e JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT r.u AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.v) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.u GROUP BY r.u
"""
