"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes (insult, threat, intent, target, negation, reported speech, other) by a lexicon: a few fixed
seeds, and words and stems (the first four to nine letters) that the training labels show to mark toxic texts, each with a
weight by its log-odds. A word has the entry of its longest stem with enough evidence, be it for or against. Over each text
in which an insult or threat stands run transducers in composition, first backwards, then forwards:

- *insult* marks an insult that piles on another one of its clause, *threat* a threat that is announced ("will kill");
- *target* marks either near the person addressed, up to REACH words after or before it;
- *negation* marks one that stands within three words after a negation;
- *report* marks one that follows a verb of reported speech in its clause, over a colon too, or stands in quotation marks
  that such a verb opens or, backwards, closes.

Clauses end at `. ! ? ; :`, everything ends with the line. A text thus yields matches of the kinds plain, targeted,
negated, reported, threatened and piled. A threat without a target is none. Logistic weights of the kinds, drawn towards
fixed prior weights, turn the matches of a whole text into a score. An insult of which no transducer says anything is a
plain match and has a weight too: in the tables at hand most toxic texts hold nothing else, see the README.

The model is learned from a bounded sample of labelled rows: the weights from two halves, each scored with the lexicon
of the other, and the final lexicon from both.

Defined results: null and empty texts, and texts without a match, get the score of no match; without labels the prior
weights hold. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import crc_mod, cut, held, slices, table, uniform

#: Labelled rows of each label that the model is learned from, in expectation; and lexicon entries at most.
SAMPLE_ROWS, ENTRIES = 5_000, 5_000
#: Least share of toxic texts among those with a lexicon entry; chance of one false entry among all, as a logarithm.
PRECISION, DOUBT = 0.5, 4.6
#: Letters of a stem, and least texts that a stem below a toxic one must stand in to count as evidence of its own.
STEMS, EVIDENCE = (4, 5, 6, 7, 8, 9), 5
THRESHOLD = 0.7
#: Words from a target to an insult or threat at most, on either side.
REACH = 4
OTHER, BREAK, LINE, COLON, QUOTE, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = range(11)
PLAIN, TARGETED, NEGATED, REPORTED, THREATENED, PILED = range(6)
#: Seeds of the lexicon. Fixed values.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum worthless pathetic disgusting imbecile",
    THREAT: "kill murder strangle stab hurt",
    INTENT: "will shall gonna going i'll we'll",
    TARGET: "you your yourself u thou him her them he she they",
    NEGATION: "not no never isn't aren't wasn't don't nicht kein keine pas jamais nunca",
    REPORT: "said says wrote quoted claimed reported alleged called sagte schrieb dit dijo",
}
#: Prior weights: none, then one for each kind of match.
PRIOR = np.array([-3.0, 3.0, 3.5, 0.8, 0.8, 4.0, 3.2])
#: Weight of a threat that nothing announces.
BARE = 0.8
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”„«»]")
_SIGNS = {c: BREAK for c in ".!?;"} | {":": COLON, "\n": LINE} | {c: QUOTE for c in '"“”„«»'}


class Transducer:
    """A deterministic finite-state transducer: arcs[state][symbol] = (next state, symbol out). `step` gives them by rule."""

    def __init__(self, states: int, symbols: Iterable[int], step):
        self.arcs = [{s: step(q, s) for s in symbols} for q in range(states)]

    def __rshift__(self, after: Transducer) -> Transducer:
        """Composition: what this one puts out, `after` reads."""
        n = len(after.arcs)

        def step(q: int, s: int) -> tuple[int, int]:
            to, out = self.arcs[q // n][s]
            then, final = after.arcs[q % n][out]
            return to * n + then, final

        return Transducer(len(self.arcs) * n, self.arcs[0], step)


#: Marks added to INSULT and THREAT as they pass.
_TARGETED, _NEGATED, _REPORTED, _PILED, _ANNOUNCED = 16, 32, 64, 128, 256
_SYMBOLS = range(11)
_ENDS = (BREAK, LINE, COLON)


def _hit(s: int) -> bool:
    return s % 16 in (INSULT, THREAT)


def _after(what: int, mark: int, reach: int, marked: tuple[int, ...] = (INSULT, THREAT)):
    """Marks hits up to `reach` words after a word of class `what` in the same clause. State: words since, reach for none."""

    def step(q: int, s: int) -> tuple[int, int]:
        if s in _ENDS:
            return reach, s
        if s == QUOTE:
            return q, s
        out = s | mark if s % 16 in marked and q < reach else s
        return 0 if s % 16 == what else min(q + 1, reach), out

    return reach + 1, step


def _report(q: int, s: int) -> tuple[int, int]:
    """State: 1 after a verb of reported speech in its clause, 2 in the quotation marks that follow it."""
    out = s | _REPORTED if _hit(s) and q else s
    if s == LINE or s == BREAK and q == 1 or s == QUOTE and q == 2:
        return 0, out
    return (2, out) if s == QUOTE and q == 1 else (max(q, 1), out) if s == REPORT else (q, out)


def _closed(q: int, s: int) -> tuple[int, int]:
    """Backwards. State: 1 after a verb of reported speech, 2 in the quotation marks before it."""
    out = s | _REPORTED if _hit(s) and q == 2 else s
    if s == LINE or s in _ENDS and q == 1 or s == QUOTE and q == 2:
        return 0, out
    return (2, out) if s == QUOTE and q == 1 else (max(q, 1), out) if s == REPORT else (q, out)


def grammar() -> tuple[Transducer, int, Transducer, int]:
    """The composed transducer that reads backwards and its first state; the one that reads forwards what that puts out, likewise."""
    made = []
    symbols: Iterable[int] = _SYMBOLS
    target = _after(TARGET, _TARGETED, REACH)
    forwards = (_after(INSULT, _PILED, REACH, (INSULT,)), _after(INTENT, _ANNOUNCED, REACH, (THREAT,)), target, _after(NEGATION, _NEGATED, 3), (3, _report))
    for parts in ((target, (3, _closed)), forwards):
        whole, start = None, 0
        for states, step in parts:
            part = Transducer(states, symbols, step)
            symbols = sorted({out for arcs in part.arcs for _, out in arcs.values()})
            whole = part if whole is None else whole >> part
            start = start * states + (0 if states == 3 and step in (_report, _closed) else states - 1)
        made += [whole, start]
    return tuple(made)


def kind(out: int) -> int | None:
    """The kind of match that an output symbol stands for; reported and negated matches count as such before all else. A threat
    without a target is no match."""
    if out % 16 == THREAT and not out & (_TARGETED | _REPORTED | _NEGATED):
        return None
    for mark, found in ((_REPORTED, REPORTED), (_NEGATED, NEGATED), (_TARGETED, THREATENED if out % 16 == THREAT else TARGETED), (_PILED, PILED)):
        if out & mark:
            return found
    return PLAIN


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)  # words, and stems followed by *, with weights of 0 to 1
    weights: np.ndarray = field(default_factory=PRIOR.copy)


class _Memo(dict):
    """Symbols of the words seen; an unknown word is looked up in the lexicon first."""

    def __init__(self, matcher: Matcher):
        self.matcher = matcher

    def __missing__(self, token: str) -> int:
        return self.matcher.symbol(token)


class Matcher:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.seeds = {w: c for c, words in SEEDS.items() for w in words.split()}
        self.backwards, self.last, self.forwards, self.first = grammar()
        self.memo = _Memo(self)
        self.weight: dict[str, float] = {}

    def symbol(self, token: str) -> int:
        found = _SIGNS[token] if token in _SIGNS else self.seeds.get(token, OTHER)
        if found == OTHER:
            entries = [token, *(token[:n] + "*" for n in reversed(STEMS) if len(token) > n)]
            weight = next((self.lexicon[e] for e in entries if e in self.lexicon), 0.0)
            if weight > 0:
                found = INSULT
                self.weight[token] = weight
        if len(self.memo) >= 400_000:
            self.memo.clear()
        self.memo[token] = found
        return found

    def matches(self, text: str | None) -> list[tuple[int, int, float]]:
        """(token, kind, weight) of the matches of a whole text."""
        tokens = TOKEN.findall((text or "").lower())
        symbols = list(map(self.memo.__getitem__, tokens))
        if INSULT not in symbols and THREAT not in symbols:
            return []
        state, arcs = self.last, self.backwards.arcs
        for i in range(len(symbols) - 1, -1, -1):
            state, symbols[i] = arcs[state][symbols[i]]
        out, state, arcs = [], self.first, self.forwards.arcs
        for i, s in enumerate(symbols):
            state, made = arcs[state][s]
            if _hit(made) and (k := kind(made)) is not None:
                weight = self.weight.get(tokens[i], 1.0) if made % 16 == INSULT else 1.0 if made & _ANNOUNCED else BARE
                out.append((i, k, weight))
        return out

    def features(self, text: str | None) -> np.ndarray:
        x = np.zeros(len(PRIOR))
        x[0] = 1
        for _, k, weight in self.matches(text):
            x[1 + k] += weight
        x[1:] = np.log2(1 + x[1:])
        return x


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pull: float = 0.5) -> np.ndarray:
    """Logistic weights by Newton's method, drawn towards PRIOR."""
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        grad = x.T @ (weight * (p - y)) + pull * (w - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w = w - step.clip(-2, 2)
    return w


def sampled(docs: DataFrame, labels: DataFrame, label: str, trained_on: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label, weight): a repeatable sample of labelled rows, about so many of each label, with the inverse
    of their share as weight. A document with labels of both kinds counts as the larger."""
    known = labels.where(trained_on & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, rows / max(sizes.get(1, 1), 1))).otherwise(min(1.0, rows / max(sizes.get(0, 1), 1)))
    chosen = known.withColumn("share", share).where(uniform("doc_id") < F.col("share"))
    # at most about 2 * rows rows: a bounded side
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", (1 / F.col("share")).alias("weight"))


def _stems(n: int) -> Column:
    """The first n letters of the longer words of column words, followed by *."""
    return F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def _lexicon(counted: DataFrame, parts: tuple[str, ...], base: dict[str, tuple[float, float]]) -> dict[str, float]:
    """The lexicon that the named parts of the sample show. base: rows and toxic rows of each part."""
    rows, toxic_rows = (sum(base[k][i] for k in parts) for i in (0, 1))
    if not 0 < toxic_rows < rows:
        return {}
    p = toxic_rows / rows
    t, n, wt, w = (sum((F.col(f"{x}{k}") for k in parts), F.lit(0)) for x in ("t", "n", "wt", "w"))
    shown = counted.select("entry", t.alias("t"), n.alias("n"), wt.alias("wt"), w.alias("w")).where("n > 0")
    other = F.col("n") - F.col("t")
    gain = F.col("t") * F.log(F.col("t") / (F.col("n") * p)) + F.when(other > 0, other * F.log(other / (F.col("n") * (1 - p)))).otherwise(0.0)
    words = shown.where(~F.endswith("entry", F.lit("*"))).count()
    toxic = shown.where((F.col("t") >= 3) & (F.col("t") / F.col("n") > p) & (F.col("wt") / F.col("w") >= PRECISION) & (gain >= float(np.log(max(words, 1))) + DOUBT))
    found = toxic.orderBy(F.desc(gain), "entry").limit(ENTRIES).collect()
    stems = [r["entry"] for r in found if r["entry"].endswith("*")]
    if stems:  # what is known of longer stems and words below the toxic stems, for or against
        of_stem = F.lit(False)
        for k in STEMS:
            of_stem = of_stem | (F.concat(F.substring("entry", 1, k), F.lit("*")).isin(stems) & (F.length(F.rtrim(F.col("entry"), F.lit("*"))) > k))
        found += shown.where((F.col("n") >= EVIDENCE) & of_stem).orderBy(F.desc("n"), "entry").limit(10 * ENTRIES).collect()
    odds = {r["entry"]: np.log((r["t"] + 0.5) / (r["n"] - r["t"] + 0.5)) - np.log(p / (1 - p)) for r in found}
    return {entry: float(np.clip((x - 1) / 5, 0, 1)) for entry, x in odds.items()}


def fit(docs: DataFrame, labels: DataFrame, trained_on: Column) -> Model:
    sample = cut(sampled(docs, labels, "toxic", trained_on).withColumn("part", F.when(uniform("doc_id", 11) < 0.5, "a").otherwise("b")))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    worded = sample.select("part", "label", "weight", words.alias("words"))
    shown = worded.select("part", "label", "weight", F.explode(F.array_distinct(F.concat("words", *[_stems(n) for n in STEMS]))).alias("entry"))
    per_part = lambda x, k: F.sum(F.when(F.col("part") == k, x).otherwise(0))
    sums = [per_part(x, k).alias(f"{name}{k}") for k in "ab" for name, x in (("t", F.col("label")), ("n", F.lit(1)), ("wt", F.col("label") * F.col("weight")), ("w", F.col("weight")))]
    counted = cut(shown.groupBy("entry").agg(*sums))
    base = {k: (0.0, 0.0) for k in "ab"} | {r["part"]: (r["n"], r["t"]) for r in sample.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("t")).collect()}
    found = []
    for own, other in (("a", "b"), ("b", "a")):  # each part is scored by the lexicon of the other
        matcher = Matcher(_lexicon(counted, (other,), base))
        found.append(_features(sample.where(F.col("part") == own), matcher, ["label", "weight"]).toPandas())  # seven numbers for each row of the sample
    rows = pd.concat(found)
    model = Model(_lexicon(counted, ("a", "b"), base))
    if len(rows):
        model.weights = fitted(np.stack(rows["x"].map(np.asarray).tolist()), rows["label"].to_numpy(float), rows["weight"].to_numpy(float))
    return model


def _features(docs: DataFrame, matcher: Matcher, keep: list[str]) -> DataFrame:
    """(*keep, x): the features of column text."""
    lexicon = docs.sparkSession.sparkContext.broadcast(matcher.lexicon)
    docs = docs.select(*keep, "text")
    schema = docs.select(*keep, F.lit(None).cast("array<double>").alias("x")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        matcher = held(("toxicity", id(known)), lambda: Matcher(known))
        for batch in slices(batches):
            x = [matcher.features(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(x, pa.list_(pa.float64()))], schema.names)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, kinds): kinds are the weighted matches of each kind."""
    found = _features(docs, Matcher(model.lexicon), ["doc_id"])
    total = sum((F.get("x", F.lit(i)) * float(w) for i, w in enumerate(model.weights)), F.lit(0.0))
    return found.select("doc_id", (1 / (1 + F.exp(-total))).alias("score"), F.slice("x", 2, len(PRIOR) - 1).alias("kinds"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
