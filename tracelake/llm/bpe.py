"""Byte-level BPE encoding and decoding with a fixed public rank table.

A text is split by the tokenizer's pattern. Each *distinct* word is encoded once per task: its bytes are folded into
pieces by always merging the adjacent pair of lowest rank, found in a literal rank map. Decoding concatenates the binary
pieces of the ids. The rank table has a fixed size (about 50,000 entries), so it travels with the task.

Defined results: a null text counts as empty; an empty text has no ids; lone surrogates cannot occur in a Spark string.
Extra columns are ignored by :func:`digests` and kept by :func:`encode`. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import by_text, held, slices

#: Distinct words whose encoding a task remembers; then it starts anew. About 300 bytes each.
MEMO_WORDS = 400_000
#: Words with more bytes use a heap instead of repeated scans.
LONG_WORD = 64
#: Texts whose words are learned together, and words folded together.
LEARN_TEXTS, FOLD_WORDS = 1_000, 4_096
NONE = 1 << 30


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The rank table of a .tiktoken file: piece -> rank, which is its id too."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Fold ranked merges over the bytes of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    scores = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        best, at = None, -1
        for i, score in enumerate(scores):
            if score is not None and (best is None or score < best):
                best, at = score, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        if at < len(scores):
            scores[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            scores[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold in n log n: a heap of candidate merges over a linked list of pieces, leftmost first among equals."""
    n = len(word)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
            if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


#: Texts made of these characters alone are split by the standard library's engine with PLAIN, which gives the same
#: words as public_tokenizers.PATTERN there and takes about half the time; other texts by the regex module.
OTHER = r"[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af\u2010-\u2027\u2030-\u205e]"
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


class Codec:
    """Encoder and decoder of one process, with a bounded memo of distinct words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import public_tokenizers
        import regex

        self.ranks = ranks
        self.by_regex = regex.compile(pattern).findall
        plain = pattern == public_tokenizers.PATTERN
        self.by_re, self.other = re.compile(PLAIN).findall if plain else self.by_regex, re.compile(OTHER).search
        self.pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(ranks[left] << 20 | ranks[right], rank) for piece, rank in ranks.items() for i in range(1, len(piece)) if (left := piece[:i]) in ranks and (right := piece[i:]) in ranks]
        made = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_key, self.pair_rank = np.append(made[:, 0], np.iinfo(np.int64).max), np.append(made[:, 1], NONE)

    def split(self, text: str) -> list[str]:
        return self.by_regex(text) if self.other(text) else self.by_re(text)

    def encode(self, text: str | None) -> list[int]:
        return [i for word in self.split(text or "") for i in merge_word(word.encode(), self.ranks)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def fold(self, words: list[bytes]) -> list[list[int]]:
        """merge_word for many short words at once: in each round, every word merges its pair of lowest rank."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for start in range(0, len(order), FOLD_WORDS):
            rows = np.array(order[start : start + FOLD_WORDS])
            size = np.array([len(words[i]) for i in rows])
            wide = max(int(size.max()), 1)
            flat = np.frombuffer(b"".join(words[i].ljust(wide, b"\0") for i in rows), np.uint8).reshape(len(rows), wide)
            ids, column = self.single[flat], np.arange(wide)
            while len(rows):
                key = ids[:, :-1] << 20 | ids[:, 1:]
                at = np.searchsorted(self.pair_key, key)
                rank = np.where((self.pair_key[at] == key) & (column[1:] < size[:, None]), self.pair_rank[at], NONE)
                best = rank.argmin(1) if wide > 1 else np.zeros(len(rows), np.int64)
                low = rank[np.arange(len(rows)), best] if wide > 1 else np.full(len(rows), NONE)
                done = low == NONE
                for k in np.flatnonzero(done).tolist():
                    out[rows[k]] = ids[k, : size[k]].tolist()
                rows, size, ids, best, low = (x[~done] for x in (rows, size, ids, best, low))
                moved = np.concatenate([ids[:, 1:], ids[:, -1:]], 1)
                ids = np.where(column > best[:, None], moved, ids)
                ids[np.arange(len(rows)), best] = low
                size = size - 1
        return out

    def learn(self, words: set[str]) -> None:
        """Remember what the words encode and decode to."""
        if len(self.ids) + len(words) > MEMO_WORDS:
            self.ids.clear()
            self.decoded.clear()
        known = self.ids.keys()
        short = [w for w in words if w not in known and len(w) <= LONG_WORD // 4]
        folded = self.fold([w.encode() for w in short])
        longer = [w for w in words if w not in known and len(w) > LONG_WORD // 4]
        folded += [merge_word(w.encode(), self.ranks) for w in longer]
        for word, ids in zip(short + longer, folded, strict=True):
            self.ids[word] = b" ".join([b"%d" % i for i in ids])
            self.decoded[word] = self.decode(ids)

    def joined(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, bytes]]:
        """Of each text: number of ids, the ids as decimals joined by one space, and the bytes that they decode to."""
        for start in range(0, len(texts), LEARN_TEXTS):
            split = [self.split(x or "") for x in texts[start : start + LEARN_TEXTS]]
            self.learn(set().union(*split))
            ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
            for words in split:
                made = b" ".join(map(ids, words))
                yield made.count(b" ") + 1 if words else 0, made, b"".join(map(decoded, words))

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        for n, ids, decoded in self.joined(texts):
            yield n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _codec(path: str, pattern: str, ranks: dict[bytes, int]) -> Codec:
    """One codec per Python process, kept while the process serves further tasks."""
    return held(("bpe", path, pattern), lambda: Codec(ranks, pattern))


def _paths(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text. One narrow pass, no shuffle."""
    path, pattern = _paths(ranks_path, pattern)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern, ranks.value)
        for batch in slices(batches, LEARN_TEXTS):
            made = list(codec.digests(batch.column(1).to_pylist()))
            columns = list(zip(*made, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, text: str = "text", to: str = "tokens", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with an array of ids added in column `to`."""
    path, pattern = _paths(ranks_path, pattern)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    docs = docs.drop(to)
    at = docs.columns.index(text)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern, ranks.value)
        for batch in slices(batches, LEARN_TEXTS):
            ids = [np.array(made.split(), np.int32) for _, made, _ in codec.joined(batch.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


def decode(frame: DataFrame, tokens: str = "tokens", to: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """frame with the bytes that its ids stand for added in column `to`, as a string."""
    path, pattern = _paths(ranks_path, None)
    ranks = frame.sparkSession.sparkContext.broadcast(read_ranks(path))

    frame = frame.drop(to)
    at, schema = frame.columns.index(tokens), frame.select("*", F.lit(None).cast("string").alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern, ranks.value)
        for batch in slices(batches, LEARN_TEXTS):
            texts = [None if ids is None else codec.decode(ids).decode("utf-8", "replace") for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    return frame.mapInArrow(run, schema)


def rank_maps(ranks: dict[bytes, int], buckets: int) -> Column:
    """The rank table as a literal array of maps from piece to rank, dealt by crc32, so that a lookup scans one small map."""
    parts: list[dict[bytes, int]] = [{} for _ in range(buckets)]
    for piece, rank in ranks.items():
        parts[zlib.crc32(piece) % buckets][piece] = rank
    none = F.create_map(F.lit(b""), F.lit(NONE))
    return F.array(*[F.map_from_arrays(F.array(*[F.lit(p) for p in part]), F.array(*[F.lit(r) for r in part.values()])) if part else none for part in parts])


def merged_natively(word: Column, maps: Column) -> Column:
    """The same fold by Spark's higher-order functions: the pieces (array of binary) of a binary word, with the maps of
    :func:`rank_maps`. For few words: see the README for figures."""
    none = F.lit(NONE)
    rank = lambda pair: F.coalesce(F.try_element_at(F.get(maps, F.pmod(F.crc32(pair), F.size(maps)).cast("int")), pair), none)

    def step(parts: Column, _: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.concat(F.get(parts, i), F.get(parts, i + 1)))
        found = F.transform(joined, rank)
        at = F.array_position(found, F.array_min(found)).cast("int")
        merged = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.get(joined, at - 1)), F.slice(parts, at + 2, F.size(parts)))
        return F.when((F.size(parts) < 2) | (F.array_min(found) == none), parts).otherwise(merged)

    n = F.octet_length(word)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, 1))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), single, step)).otherwise(F.array().cast("array<binary>"))


def encoded(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip): the ids of every text, and whether decoding them gives the text again. Both in one
    pass, so that a task needs one Python worker only."""
    path, pattern = _paths(ranks_path, pattern)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = pa.struct([("tokens", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def make():
        codec = _codec(path, pattern, ranks.value)

        def judge(texts: list[str | None]) -> pa.Array:
            made = [(np.array(ids.split(), np.int32), decoded == (text or "").encode()) for text, (_, ids, decoded) in zip(texts, codec.joined(texts), strict=True)]
            return pa.StructArray.from_arrays([pa.array([x for x, _ in made], kind[0].type), pa.array([x for _, x in made], kind[1].type)], fields=list(kind))

        return judge

    found = docs.select("doc_id", by_text(make, "tokens array<int>, round_trip boolean")(F.col("text")).alias("found"))
    return found.select("doc_id", F.size("found.tokens").cast("long").alias("n_tokens"), "found.tokens", "found.round_trip")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm._common import table

    return digests(table(spark, sf_dir, "documents"))
