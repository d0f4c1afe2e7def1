"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of all licence templates. A text's words are streamed through it, which gives
matching statistics: for each word, the longest run of template words that ends there, and for each place in a template
the longest run that ends at that place. Runs that can't be extended at their place are the matches. The matches of a
template are chained, forwards in the text and in the template, so that a chain covers as many words of the template as
possible; of the chains that cover the share COVER of their template, those that together cover most words of the text
without overlapping give their labels. Thus a notice of one licence isn't taken for its near relative. Base phrases are
templates too: they are found where the statistics reach their length.

Words are runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased. Whole texts are read.

Defined results: null and empty texts have no words and score 0; of chains that cover equally many words the one of the
larger share wins, then the earlier, then the template that stands first. Repeated rows give repeated rows; other columns
are ignored by :func:`scan`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm._common import held, slices, table
from tracelake.llm.licence_texts import TEMPLATES

#: Phrases whose every place counts, with their labels. Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Least words of a match; most words of the text between chained matches; share of a template that gives its label.
MATCH, GAP, COVER = 3, 12, 0.75
#: Templates of more words than LONG only count matches of LONG_MATCH words or more: shorter ones are common phrases.
LONG, LONG_MATCH = 400, 8
_WORDS = bytes(b if chr(b).isascii() and chr(b).isalnum() and chr(b) == chr(b).lower() or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

#: A match or chain: start and end in the text, start and end in the template.
Match = tuple[int, int, int, int]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several token sequences. places[state]: the places (sequence, end) where the runs of a state end,
    each with the length of the longest run that ends there, or 0 where that is the run read so far; runs of less than
    least[sequence] tokens are left out."""

    def __init__(self, sequences: list[list[int]], least: list[int] | None = None):
        least = least or [1] * len(sequences)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = {}
        for template, tokens in enumerate(sequences):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                ends.setdefault(last, []).append((template, i + 1))
        order = sorted(range(1, len(self.link)), key=lambda s: self.length[s])
        for state in reversed(order):
            ends.setdefault(self.link[state], []).extend(ends[state])
        self.places: list[list[tuple[int, int, int]]] = [[] for _ in self.link]
        for state in order:  # a place of a shorter run is one of the longer run too, where that doesn't end there itself
            if self.length[state] >= min(least):
                own, above = set(ends[state]), self.link[state]
                shorter = [(t, e, k or self.length[above]) for t, e, k in self.places[above] if (t, e) not in own]
                self.places[state] = [(t, e, 0) for t, e in sorted(own) if self.length[state] >= least[t]] + [x for x in shorter if x[2] >= least[x[0]]]

    def _extend(self, last: int, token: int) -> int:
        """The state of the sequence so far with the token added."""
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, token)
        state = self._new(self.length[last] + 1, {})
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            to = self.next[at][token]
            self.link[state] = to if self.length[to] == self.length[at] + 1 else self._clone(at, to, token)
        return state

    def _new(self, length: int, arrows: dict[int, int]) -> int:
        self.next.append(arrows)
        self.length.append(length)
        self.link.append(0)
        return len(self.link) - 1

    def _clone(self, at: int, to: int, token: int) -> int:
        """Split off the part of state `to` that is reached from `at`."""
        copy = self._new(self.length[at] + 1, dict(self.next[to]))
        self.link[copy], self.link[to] = self.link[to], copy
        while at >= 0 and self.next[at].get(token) == to:
            self.next[at][token] = copy
            at = self.link[at]
        return copy

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest run of template tokens that ends at each token."""
        state, length = 0, 0
        arrows, link, longest = self.next, self.link, self.length
        for token in tokens:
            while state and token not in arrows[state]:
                state = link[state]
                length = longest[state]
            to = arrows[state].get(token)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield state, length


def chains(matches: list[Match]) -> list[tuple[Match, int]]:
    """Chains of one template's matches, each with the number of template words that it covers: the best one first taken, then
    the best to the left and to the right of it, and so on. In a chain, matches go forward in the text, with GAP words between
    them at most, and in the template; of overlapping ones only what is new counts.

    A heap holds the best chain that ends in each match. What is taken cuts the matches in two; a chain that began before a cut
    is made again from the matches after it when it comes up, so that each match is looked at a few times, however many there are.
    """
    part = sorted(matches)
    starts = [m[0] for m in part]
    reach, furthest = [], -1  # the furthest end so far: before it, no match can be chained
    for m in part:
        furthest = max(furthest, m[1])
        reach.append(furthest)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * len(part)  # words covered, less start of the text, of the template

    def chain(j: int, left: int) -> tuple[int, int, int]:
        start, end, low, high = part[j]
        top = (end - start, -start, -low)
        for i in range(j - 1, -1, -1):
            s, e, lo, hi = part[i]
            if s < left or reach[i] < start - GAP:
                break
            new = end - start - max(0, e - start, hi - low)
            if start - e <= GAP and end > e and low >= lo and high > hi and new > 0:
                top = max(top, (best[i][0] + new, best[i][1], best[i][2]))
        return top

    heap = []
    for j in range(len(part)):
        best[j] = chain(j, 0)
        heap.append((-best[j][0], -best[j][1], -best[j][2], j))
    heapify(heap)
    out, froms, tos = [], [], []  # what is taken, in order
    while heap:
        covered, start, low, j = heappop(heap)
        if (-covered, -start, -low) != best[j]:
            continue
        k = bisect_right(froms, part[j][0])
        left = tos[k - 1] if k else 0
        if part[j][0] < left or k < len(froms) and part[j][1] > froms[k]:
            continue  # it overlaps what is taken
        if start < left:
            first = bisect_left(starts, left)
            for i in range(first, j + 1):
                if -best[i][1] < left:
                    best[i] = chain(i, left)
                    heappush(heap, (-best[i][0], -best[i][1], -best[i][2], i))
            continue
        if -covered >= MATCH:
            out.append(((start, part[j][1], low, part[j][3]), -covered))
        froms.insert(k, start)
        tos.insert(k, part[j][1])
    return out


#: A span of the text: start, end, template, words covered, share of the template.
Span = tuple[int, int, int, int, float]


def cover(spans: list[Span]) -> list[Span]:
    """The spans, none overlapping another, that cover most words in all."""
    spans = sorted(spans, key=lambda x: (x[1], x[0], -x[4], x[2]))
    ends = [x[1] for x in spans]
    best, back = [(0, 0.0)], [(0, -1)]  # the most up to each span, and (what came before, the span taken)
    for k, (start, _, _, covered, share) in enumerate(spans):
        i = bisect_right(ends, start, hi=k)
        made = (best[i][0] + covered, best[i][1] + share)
        best.append(max(best[-1], made))
        back.append((i, k) if made > best[-2] else (k, -1))
    out, at = [], len(spans)
    while at:
        at, k = back[at]
        if k >= 0:
            out.append(spans[k])
    return out[::-1]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], base: dict[str, str]):
        self.labels = [label for label, _ in templates]
        texts = [split(text) for _, text in templates] + [phrase.encode().split() for phrase in base]
        self.ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        sequences = [[self.ids[w] for w in t] for t in texts]
        self.templates = [[*s, -1] for s in sequences[: len(templates)]]
        self.leasts = [LONG_MATCH if len(s) > LONG else MATCH for s in sequences]
        self.automaton = Automaton(sequences, self.leasts)
        self.phrases: dict[int, list[tuple[list[int], str]]] = {}
        for tokens, label in zip(sequences[len(templates) :], base.values(), strict=True):
            self.phrases.setdefault(tokens[-1], []).append((tokens, label))
        self.least = min([MATCH, *(len(s) for s in sequences[len(templates) :])])

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """Number of words; base places (start, end, label); covered spans (start, end, label, share of the template)."""
        words = split(text)
        get = self.ids.get
        known = [get(w, 0) for w in words]
        ids = np.array(known, np.int32)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
        places, matches, templates, n = [], {}, self.templates, len(self.templates)
        for start, end in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if end - start < self.least:
                continue
            run = [*known[start:end], 0]
            for i, (state, length) in enumerate(self.automaton.statistics(run[:-1])):
                if length < self.least:
                    continue
                for tokens, label in self.phrases.get(run[i], ()):
                    if length >= len(tokens) and run[i + 1 - len(tokens) : i + 1] == tokens:
                        places.append((start + i + 1 - len(tokens), start + i + 1, label))
                if length >= MATCH:
                    for template, last, size in self.automaton.places[state]:
                        if template < n and templates[template][last] != run[i + 1]:  # it ends here
                            size = size or length
                            if size < self.leasts[template]:
                                continue
                            matches.setdefault(template, []).append((start + i + 1 - size, start + i + 1, last - size, last))
        spans = [(s, e, t, covered, covered / (len(templates[t]) - 1)) for t, found in matches.items() for (s, e, _, _), covered in chains(found)]
        sure = cover([x for x in spans if x[4] >= COVER])
        until = [y[1] for y in sure]
        last = [y[0] for y in sure] + [len(words)]
        free = [x for x in spans if x[4] < COVER and last[bisect_right(until, x[0])] >= x[1]]
        return len(words), places, [(s, e, self.labels[t], share) for s, e, t, _, share in sorted([*sure, *cover(free)])]


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner(TEMPLATES, BASE)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places, spans): base places and covered spans, in words from 0, with labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held("licenses", _scanner)
        place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
        span = pa.struct([*place, ("share", pa.float64())])
        for batch in slices(batches):
            made = [scanner.scan(x) for x in batch.column(1).to_pylist()]
            places = [[{"start": s, "end": e, "label": x} for s, e, x in m[1]] for m in made]
            spans = [[{"start": s, "end": e, "label": x, "share": c} for s, e, x, c in m[2]] for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.int64()), pa.array(places, pa.list_(place)), pa.array(spans, pa.list_(span))], ["doc_id", "n_words", "places", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, places array<struct<start:long,end:long,label:string>>, spans array<struct<start:long,end:long,label:string,share:double>>")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    labelled = F.transform(F.filter("spans", lambda s: s["share"] >= COVER), lambda s: s["label"])
    starts, base = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, labelled)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0))).alias("score"),
    )
