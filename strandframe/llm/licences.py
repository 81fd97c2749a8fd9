"""Licence scans with a generalised suffix automaton of licence tokens.

The templates' words form one automaton whose paths are all their substrings. A text's words are fed
through it; the state's depth is, at each word, the longest run ending there that stands in any
template (the matching statistics), and its suffix links lead to the longest run of every other place
in the templates. Runs of ``MIN_MATCH`` words or more that cannot be extended at their place are
matches, whatever the other templates hold; those of one template are chained in order, in the text and
in the template, into spans, and the words that a chain covers, against the template's length, are its
coverage. A template of coverage ``COVERED`` or more gives the text its label. Templates of different
labels share words (GPL-2 and GPL-3 notices, BSD-2 and BSD-3), so a word of the text speaks for one label
only: the chain with most words covered, less those missing, takes its words, and the others are chained
anew without them. In a notice, all words that tell variants apart (``TELLING`` and numbers) must be covered,
and a chain does not skip such a word, which its template lacks. The whole texts are in ``licence_texts``. Words that no template has end every run, so only runs of
known words are fed; nothing is shuffled.

Base labels come from three phrases, wherever their words stand one after another.

Defined results: null or empty text has no words, no label and score 0; repeated rows are scanned
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import slices, table

MIN_MATCH, COVERED, GAP = 4, 0.6, 40
#: Templates up to this many words are notices; in longer ones the telling words are left to the coverage.
NOTICE = 300
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words that tell variants apart; ``library`` also names what is licensed, so it need not be covered.
TELLING = {"lesser", "affero", "noncommercial", "noderivatives", "noderivs", "sharealike", "nc", "nd", "sa"}
NOT_SKIPPED = TELLING | {"library"}

#: Licences without a notice or text of their own here, which short identifiers still name.
NAMED_ONLY = ("ecl-2.0", "ipl-1.0", "lppl-1.3c", "mit-0", "upl-1.0")
_HERE = Path(__file__).parent


def _templates() -> list[tuple[str, str]]:
    """(label, text): the notices, the whole texts, and a line of the form ``SPDX-License-Identifier`` for every label."""
    notices = [tuple(line.split("\t", 1)) for line in (_HERE / "licence_notices.txt").read_text("utf-8").splitlines() if not line.startswith("#")]
    texts = [(f.stem, f.read_text("utf-8")) for f in sorted((_HERE / "licence_texts").glob("*.txt"))]
    labels = dict.fromkeys([label for label, _ in notices + texts if label != "bsd"] + list(NAMED_ONLY))
    return notices + texts + [(label, f"SPDX-License-Identifier: {label}") for label in labels]


TEMPLATES: list[tuple[str, str]] = _templates()


def words_of(text: str | None) -> list[bytes]:
    """Whole text, A-Z lowered, cut at every ASCII character that is neither digit nor letter."""
    return _WORDS(text.encode("utf-8", "surrogatepass").lower()) if text else []


class SuffixAutomaton:
    """All substrings of several sequences; each state knows one end per sequence that holds it, those of ``least`` tokens or more all places."""

    def __init__(self, sequences: list[list[int]], least: int = MIN_MATCH) -> None:
        self.least = least
        self.next: list[dict[int, int]] = [{}]
        self.link, self.depth = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for n, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].setdefault(n, i + 1)
        self.places: list[list[tuple[int, int]]] = [list(e.items()) for e in self.ends]
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.depth[s]):
            up = self.ends[self.link[state]]
            for n, end in self.ends[state].items():
                up[n] = min(up.get(n, end), end)
            if self.depth[self.link[state]] >= least:
                self.places[self.link[state]] += self.places[state]

    def _new(self, depth: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.depth.append(depth)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, state: int, token: int, target: int) -> int:
        """A copy of ``target`` at the depth that ``state`` allows, which takes over the shorter runs."""
        copy = self._new(self.depth[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.depth[known] == self.depth[last] + 1 else self._split(last, token, known)
        new, state = self._new(self.depth[last] + 1, {}, 0), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][token]
            self.link[new] = target if self.depth[target] == self.depth[state] + 1 else self._split(state, token, target)
        return new

    def matches(self, tokens: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
        """(end, length, state) of the runs of ``least`` tokens or more that the next token does not extend."""
        out, state, length = [], 0, 0
        for i, token in enumerate(tokens):
            before = (i, length, state)
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.depth[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                state, length = 0, 0
            if before[1] >= least and length <= before[1]:
                out.append(before)
        if length >= least:
            out.append((len(tokens), length, state))
        return out

    def matches_by_place(self, tokens: list[int]) -> list[tuple[int, int, int, int]]:
        """(end, length, sequence, end there) of the runs of ``least`` tokens or more, at every place of every sequence, that the next token does not extend at that place."""
        out, state, length, before = [], 0, 0, {}
        for i, token in enumerate(tokens):
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.depth[state]
            state, length = (self.next[state][token], length + 1) if token in self.next[state] else (0, 0)
            now: dict[tuple[int, int], int] = {}
            at, run = state, length
            while run >= self.least:
                for place in self.places[at]:
                    now.setdefault(place, run)
                at = self.link[at]
                run = self.depth[at]
            out += [(i, run, n, stop) for (n, stop), run in before.items() if (n, stop + 1) not in now]
            before = now
        return out + [(len(tokens), run, n, stop) for (n, stop), run in before.items()]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        self.labels = [label for label, _ in templates]
        texts = [words_of(t) for _, t in templates]
        self.ids: dict[bytes, int] = {}
        named = [w.encode() for w in sorted(NOT_SKIPPED)]
        for words in [*texts, named, *(p.encode().split() for p in phrases)]:
            for w in words:
                self.ids.setdefault(w, len(self.ids))
        self.lengths = [len(t) for t in texts]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in t] for t in texts])
        self.named = {self.ids[w] for w in named}
        self.held = [{self.ids[w] for w in t} for t in texts]
        self.needed = [{self.ids[w] for w in t if w.isdigit() or w.decode("utf-8", "replace") in TELLING} if len(t) <= NOTICE else set() for t in texts]
        self.phrases = [(label, [self.ids[w] for w in p.encode().split()]) for p, label in phrases.items()]

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words] if len(words) < 64 else list(map(get, words)), dtype=np.float32)
        known = np.flatnonzero(ids >= 0)  # unknown words are NaN or -1
        places, base = [], []
        if len(known):
            for label, phrase in self.phrases:
                at = known[ids[known] == phrase[0]]
                at = at[at + len(phrase) <= len(ids)]
                for k, token in enumerate(phrase[1:], 1):
                    at = at[ids[at + k] == token]
                if len(at):
                    places.append(at)
                    base.append(label)
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        if len(known) >= MIN_MATCH:
            cuts = np.flatnonzero(np.diff(known) != 1) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(known))
            for s in np.flatnonzero(ends - starts >= MIN_MATCH):
                first = int(known[starts[s]])
                run = ids[first : first + int(ends[s] - starts[s])].astype(np.int64).tolist()
                for end, length, n, stop in self.automaton.matches_by_place(run):
                    spans.setdefault(n, []).append((first + end - length, first + end, stop - length, stop))
        best, kept = self.explain(words, ids, spans)
        own = sorted({self.labels[n] for n, _, _ in kept})
        starts_ = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
        return {
            "n_words": len(words), "n_base": len(starts_), "first_word": int(starts_.min()) if len(starts_) else None, "last_word": int(starts_.max()) if len(starts_) else None,
            "base_labels": ",".join(sorted(set(base))), "labels": ",".join(sorted({*base, *own})), "score": best,
            "spans": [(self.labels[n], a, b) for n, a, b in sorted(kept)],
        }

    def explain(self, words: list[bytes], ids: np.ndarray, spans: dict[int, list[tuple[int, int, int, int]]]) -> tuple[float, list[tuple[int, int, int]]]:
        """The greatest coverage of any template, and (template, start, stop) of those that give their label; each word speaks for one label."""
        named = [int(i) for i in np.flatnonzero(np.isin(ids, list(self.named)))] if spans else []

        def parted(n: int, start: int, stop: int) -> bool:
            return words[start - 1].isdigit() and words[start].isdigit() or any(start <= i < stop and int(ids[i]) not in self.held[n] for i in named)

        def chained(n: int) -> tuple[int, list[tuple[int, int]]]:
            return chain(spans[n], (lambda start, stop: parted(n, start, stop)) if self.lengths[n] <= NOTICE else None)

        found, kept = {n: chained(n) for n in spans}, []
        share = lambda n: found[n][0] / self.lengths[n]
        best = float(max(map(share, found), default=0.0))
        while good := [n for n in found if share(n) >= COVERED]:
            n = max(good, key=lambda n: (2 * found[n][0] - self.lengths[n], -n))
            taken, others = found[n][1], [n]
            if self.needed[n] <= {int(ids[i]) for a, b in taken for i in range(a, b)}:
                kept.append((n, taken[0][0], taken[-1][1]))
                others += [m for m in found if self.labels[m] != self.labels[n]]
            for m in others:
                rest = without(spans[m], taken)
                if rest != spans[m]:
                    spans[m] = rest
                    found[m] = chained(m)
        return best, kept


def chain(spans: list[tuple[int, int, int, int]], parted: Callable[[int, int], bool] | None = None, gap: int = GAP) -> tuple[int, list[tuple[int, int]]]:
    """Most words covered by spans that follow one another in text and template, ``gap`` words apart at most, and where they lie; no step over words of the text that are ``parted``."""
    spans = sorted(set(spans))
    covered: list[tuple[int, int, int]] = []  # words covered by the best chain that ends in the span, less its start, and the span before
    near: list[int] = []
    for i, (a, b, ta, tb) in enumerate(spans):
        near = [j for j in near if spans[j][1] + gap >= a]
        own = (b - a, -a, -1)
        for j in near:
            _, pb, _, ptb = spans[j]
            more = (b - a) - max(pb - a, ptb - ta, 0)  # a word of the text, and one of the template, counts once
            if more > 0 and (covered[j][0] + more, covered[j][1]) > own[:2] and not (parted and pb < a and parted(pb, a)):
                own = (covered[j][0] + more, covered[j][1], j)
        covered.append(own)
        near.append(i)
    i = max(range(len(spans)), key=lambda i: (covered[i][0], -i), default=-1)
    most, places = covered[i][0] if spans else 0, []
    while i >= 0:
        places.append(spans[i][:2])
        i = covered[i][2]
    return most, places[::-1]


def without(spans: list[tuple[int, int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """What is left of the spans, in runs of ``MIN_MATCH`` words or more, when those words of the text are taken."""
    for x, y in taken:
        left = []
        for a, b, ta, tb in spans:
            if b <= x or y <= a:
                left.append((a, b, ta, tb))
                continue
            if x - a >= MIN_MATCH:
                left.append((a, x, ta, tb - (b - x)))
            if b - y >= MIN_MATCH:
                left.append((y, b, ta + y - a, tb))
        spans = left
    return spans


@lru_cache(maxsize=2)
def scanner_of(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    """Built once per Python worker."""
    return Scanner(list(templates), dict(phrases))


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Words, phrase places, labels, score and the covered text spans of every document."""

    given = tuple(map(tuple, templates)), tuple(phrases.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(*given)
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in slices(batches, "text"):
            out = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            col = lambda k, t: pa.array([r[k] for r in out], t)
            spans = pa.array([[{"label": s[0], "start": s[1], "stop": s[2]} for s in r["spans"]] for r in out], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(col(k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")), col("base_labels", pa.string()), col("labels", pa.string()), col("score", pa.float64()), spans],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCANNED)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
