"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces. For each language, expectation maximisation learns how probable each piece
is; a forward algorithm sums the probability of every way to cut a word into pieces, so no single segmentation is
trusted. A text's log-likelihood is the sum over all its words, and the score is the posterior of the best language.

A word is a run of letters (Unicode category L) with the marks that stand after them, lower-cased; runs of more than 32
characters are taken 32 at a time. The whole text counts.

Defined results: a null text, an empty text and a text without a letter are `und` with score 0; with nothing to learn
from, every text is. Ties go to the language first in alphabetical order. Repeated rows give repeated rows. Columns of
the input that bear the name of a result are replaced; others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm._common import by_text, crc_mod, held, table, uniform

#: Characters of whole training texts that each language may contribute, in expectation; and its distinct words.
SAMPLE_CHARS, SAMPLE_WORDS = 800_000, 200_000
#: Documents of each language that are sampled however long they are: all if it has no more, else so many in expectation
#: (then none at all with a chance of 2e-9).
LEAST_DOCS = 20
ROUNDS = 3
PIECE, WORD = 8, 32
UNKNOWN = 1e-7
START = "▁"
UNDETERMINED = "und"
MEMO_WORDS = 300_000
#: Words, in the same way for Java's engine, which learns, and for regex, which scores.
WORDS = r"\p{L}[\p{L}\p{M}]{0,%d}" % (WORD - 1)
_BY_REGEX = regex.compile(WORDS).findall
#: Texts without characters from U+0250 on have no marks, and their letters are these: the same words in half the time.
_BEYOND, _PLAIN = re.compile("[^\x00-\u024f]").search, re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]{1,%d}" % WORD).findall


def found_words(text: str) -> list[str]:
    text = text.lower()
    return _BY_REGEX(text) if _BEYOND(text) else _PLAIN(text)


@dataclass
class Model:
    """prob[i, k]: probability of piece i in language k; the last two rows stand for an unknown letter and for no piece."""

    languages: list[str]
    pieces: dict[str, int]
    prob: np.ndarray


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Pieces of letters of a public tokenizer, lower-cased, with or without the mark of a word's start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return {p: i for i, p in enumerate(sorted(p for p in found if len(p) <= PIECE and (p.removeprefix(START).isalpha() or p == START)))}


def lattices(words: list[str], pieces: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the words of each length: their places in the list, and ids[word, end, length] of the pieces that end there."""
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    unknown, none, get = len(pieces), len(pieces) + 1, pieces.get
    for size, places in by_size.items():
        n = size + 1
        for start in range(0, len(places), 20_000):
            part = places[start : start + 20_000]
            flat: list[int] = []
            for i in part:
                s = START + words[i]
                flat += [get(s[j - k : j], none if k > 1 else unknown) if k <= j else none for j in range(1, n + 1) for k in range(1, PIECE + 1)]
            yield np.array(part), np.array(flat, np.int32).reshape(len(part), n, PIECE)


def forward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]: probability of all segmentations of the first `end` characters."""
    count, n, _ = ids.shape
    alpha = np.zeros((count, n + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n + 1):
        for k in range(1, min(PIECE, j) + 1):
            alpha[:, j] += alpha[:, j - k] * prob[ids[:, j - 1, k - 1]]
    return alpha


def expected(ids: np.ndarray, weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all segmentations of the words of one language."""
    count, n, _ = ids.shape
    alpha = forward(ids, prob)[:, :, 0]
    beta = np.zeros((count, n + 1))
    beta[:, n] = 1
    out = np.zeros(len(prob))
    scale = weight / np.maximum(alpha[:, n], 1e-300)
    for j in range(n, 0, -1):
        for k in range(1, min(PIECE, j) + 1):
            step = prob[ids[:, j - 1, k - 1], 0] * beta[:, j]
            out += np.bincount(ids[:, j - 1, k - 1], alpha[:, j - k] * step * scale, len(prob))
            beta[:, j - k] += step
    return out


def learn(counts: dict[str, dict[str, int]], pieces: dict[str, int], rounds: int = ROUNDS) -> Model:
    """counts: words of each language with how often they occur."""
    languages = sorted(counts)
    prob = np.zeros((len(pieces) + 2, len(languages)))
    for k, language in enumerate(languages):
        words = sorted(counts[language])
        weight = np.array([counts[language][w] for w in words], float)
        made = [(weight[at], ids) for at, ids in lattices(words, pieces)]
        p = np.full((len(pieces) + 2, 1), 1 / max(len(pieces), 1))
        p[-2], p[-1] = UNKNOWN, 0
        for _ in range(rounds):
            got = sum(expected(ids, w, p) for w, ids in made)[: len(pieces)] + 0.01
            p[: len(pieces), 0] = got / got.sum()
        prob[:, k] = p[:, 0]
    return Model(languages, pieces, prob)


def fit(docs: DataFrame, trained_on: Column, chars: int = SAMPLE_CHARS, words: int = SAMPLE_WORDS) -> Model:
    """Learn from whole texts of the rows that `trained_on` admits: of each language a repeatable sample of about `chars` characters,
    or LEAST_DOCS documents if that is more; of each language the `words` most frequent words of those."""
    labelled = docs.where(trained_on & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("docs")).collect()
    if not sizes:
        return Model([], {}, np.zeros((2, 0)))
    share = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max(chars / r["n"], LEAST_DOCS / r["docs"])))]), F.col("lang"))
    sample = labelled.where(uniform("doc_id") < share)
    worded = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))).alias("word"))
    # the window sees the words of a bounded sample
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    counted = worded.groupBy("lang", "word").count().withColumn("rank", rank).where(F.col("rank") <= words).drop("rank")
    counts: dict[str, dict[str, int]] = {}
    for r in counted.toPandas().itertuples(index=False):
        counts.setdefault(r[0], {})[r[1]] = int(r[2])
    return learn(counts, vocabulary())


class Scorer:
    """Log-likelihoods of the words seen by one process, and the verdict on a text."""

    def __init__(self, model: Model):
        self.model, self.at, self.seen = model, {}, np.zeros((0, len(model.languages)))

    def know(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.at]
        if len(self.at) + len(fresh) > MEMO_WORDS:
            self.at, self.seen, fresh = {}, self.seen[:0], list(words)
        made = np.zeros((len(fresh), len(self.model.languages)))
        for places, ids in lattices(fresh, self.model.pieces):
            made[places] = np.log(np.maximum(forward(ids, self.model.prob)[:, -1], 1e-300))
        self.at.update(zip(fresh, range(len(self.seen), len(self.seen) + len(fresh)), strict=True))
        self.seen = np.concatenate([self.seen, made])

    def verdicts(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        if not self.model.languages:
            yield from ((UNDETERMINED, 0.0) for _ in texts)
            return
        for start in range(0, len(texts), 1_000):
            split = [found_words(x) if x else [] for x in texts[start : start + 1_000]]
            self.know(set().union(*split))
            for words in split:
                if not words:
                    yield UNDETERMINED, 0.0
                    continue
                total = self.seen[list(map(self.at.__getitem__, words))].sum(0)
                best = int(total.argmax())
                yield self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


_JUDGED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. One narrow pass, to which only the texts go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = shared.value
        scorer = held(("lang_id", id(known)), lambda: Scorer(known))
        return lambda texts: pa.array([{"lang_pred": lang, "score": score} for lang, score in scorer.verdicts(texts)], _JUDGED)

    judged = by_text(make, "lang_pred string, score double")(F.col(text))
    docs = docs.drop("lang_pred", "score")
    return docs.withColumn("__judged", judged).select(*docs.columns, F.col("__judged.lang_pred").alias("lang_pred"), F.col("__judged.score").alias("score"))


def held_out() -> Column:
    return crc_mod("doc_id", 3) == 1


def keep_identified(docs: DataFrame, floor: float = 0.5) -> DataFrame:
    """docs without those whose language can't be told: `und`, or no language with a posterior of at least `floor`."""
    judged = predict(docs, fit(docs, ~held_out()))
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= floor)).select(docs.columns)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = predict(docs.drop("lang"), fit(docs, ~held_out()))
    return judged.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
