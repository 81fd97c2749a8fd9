"""Benchmark decontamination by pigeonhole edit matching.

Texts and items become lower-case words with single blanks between them. Every run of ``WINDOW`` words of
an item is a window, so that a passage quoted in part is found too; so are runs of ``LONG`` words, one every
``LONG_STRIDE``, whose greater budget lets edits lie close together. A window of ``m`` characters may differ
by ``e = floor(m * RATE)`` edits; cut into ``e + 1`` pieces, at least one piece of it stands unchanged in
any text that holds it within budget. Or it may differ by up to ``WORD_EDITS`` whole words, replaced, put
in or left out; then a run of ``GRAM`` of its words stands unchanged. Both kinds of pieces form one
Aho-Corasick automaton; every hit fixes a place in the text, and Myers' bit-parallel algorithm finds the
window's least edit distance there, in characters or in words. A document is contaminated by an item if
any of its windows lies within a budget.

The items are the query set: they are broadcast in blocks of about ``BLOCK_BYTES`` of text, and each
block meets every document, whole, where it is read. Nothing is shuffled. A block's automaton is built in
each task and leaves with it, since Python workers outlive their tasks and would each keep one; it is bounded
by the block, so the number of passes over the documents grows with the items.

Where a script has no blanks between words (Chinese, Japanese, Thai and others), every letter is a word.

Defined results: null or empty texts and items match nothing; items of fewer than ``MIN_WORDS`` words match
unchanged and at word borders only; repeated documents and items give their rows each; of a window's equally
good places the first counts; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import forget_encoders, renamed, slices, table

WINDOW, STRIDE, MIN_WORDS, RATE = 13, 1, 6, 0.06
LONG, LONG_STRIDE = 20, 10
WORD_EDITS, GRAM = 2, 4
BLOCK_BYTES = 1 << 20
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD, _LETTER = re.compile(r"[^\W_]+"), re.compile(f"[^\\W_{_UNSPACED}]+|[^\\W_]")
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")

FOUND = "doc_id long, item_id long, n_windows long, distance long, at long"


def normalised(text: str | None) -> str:
    if not text:
        return ""
    word = _LETTER if not text.isascii() and _ANY_UNSPACED.search(text) else _WORD
    return " ".join(word.findall(text.lower()))


def windows(text: str | None, window: int = WINDOW, stride: int = STRIDE) -> list[str]:
    """Windows of an item, the shorter ones first; the last one of either length ends with it."""
    words = normalised(text).split()
    if not words:
        return []
    found: dict[str, None] = {}
    for size, step in ((window, stride), (max(window, LONG), LONG_STRIDE)):
        starts = list(range(0, max(1, len(words) - size + 1), step))
        if starts[-1] + size < len(words):
            starts.append(len(words) - size)
        found |= dict.fromkeys(" ".join(words[s : s + size]) for s in starts)
    return list(found)


def word_budget(n: int) -> int:
    """Whole words that may differ in a window of ``n``: so many that ``GRAM`` words in a row are still the same."""
    return min(WORD_EDITS, max(0, n // GRAM - 1))


def budget(m: int, rate: float = RATE) -> int:
    return int(m * rate)


def pieces(pattern: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets."""
    k = errors + 1
    cuts = [i * len(pattern) // k for i in range(k + 1)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: Sequence[str], text: Sequence[str], errors: int) -> tuple[int, int] | None:
    """(distance, end) of the pattern's best match anywhere in ``text`` within ``errors``; the earliest of equals."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = mask, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = vn | ~(d0 | vp) & mask
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & mask
        hn = hn << 1 & mask
        vp = hn | ~(d0 | hp) & mask
        vn = d0 & hp
        if score <= errors and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, stride: int = STRIDE, rate: float = RATE) -> None:
        import ahocorasick

        self.patterns: list[tuple[int, str, int]] = []
        self.words: list[list[str]] = []
        at: dict[str, list[tuple[int, int]]] = {}
        grams: dict[str, list[tuple[int, int]]] = {}
        short: dict[str, list[int]] = {}
        for row, (_, text) in enumerate(items):
            for p in windows(text, window, stride):
                e, words, n = budget(len(p), rate), p.split(" "), len(self.patterns)
                if len(words) < MIN_WORDS:
                    e = 0
                    short.setdefault(f" {p} ", []).append(n)
                for offset, piece in pieces(p, e) if len(words) >= MIN_WORDS else ():
                    at.setdefault(piece, []).append((n, offset))
                if errors := word_budget(len(words)):
                    cuts = [i * len(words) // (errors + 1) for i in range(errors + 2)]
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        grams.setdefault(" " + " ".join(words[x:y]) + " ", []).append((n, x))
                self.patterns.append((row, p, e))
                self.words.append(words)
        self.items = [i for i, _ in items]
        self.auto = ahocorasick.Automaton()
        for piece in at.keys() | grams.keys() | short.keys():
            self.auto.add_word(piece, (len(piece), at.get(piece, []), grams.get(piece, []), short.get(piece, [])))
        if self.patterns:
            self.auto.make_automaton()

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, windows found, least distance, where the first of that distance ends) per item, in normalised text."""
        t = normalised(text)
        if not t or not self.patterns:
            return []
        seen: set[tuple[int, int]] = set()
        near: set[tuple[int, int]] = set()  # windows and words of the text where they may start
        blanks: list[int] = []
        found: dict[int, dict[int, tuple[int, int]]] = {}

        def note(w: int, distance: int, end: int) -> None:
            best = found.setdefault(self.patterns[w][0], {})
            best[w] = min(best.get(w, (distance, end)), (distance, end))

        for end, (length, places, grams, whole) in self.auto.iter(" " + t + " "):
            for w in whole:
                note(w, 0, end - 1)
            for w, offset in places:
                _, p, e = self.patterns[w]
                start = end - length - offset
                band = start // (e + 1)
                if (w, band) in seen:
                    continue
                seen.add((w, band))
                low = max(0, band * (e + 1) - e)
                high = min(len(t), band * (e + 1) + 2 * e + len(p) + 1)
                exact = t.find(p, low, high)
                hit = (0, exact + len(p) - low) if exact >= 0 else myers(p, t[low:high], e)
                if hit is not None:
                    note(w, hit[0], low + hit[1])
            if grams:
                blanks = blanks or [m.start() for m in re.finditer(" ", t + " ")]
                first = bisect_left(blanks, end - length)
                first += end - length >= 0
                near.update((w, first - offset) for w, offset in grams)
        if near:
            self._by_words(t, blanks, near, found, note)
        return [(self.items[row], len(best), *min(best.values())) for row, best in sorted(found.items())]

    def _by_words(self, t: str, blanks: list[int], near: set[tuple[int, int]], found: dict[int, dict[int, tuple[int, int]]], note: Callable[[int, int, int], None]) -> None:
        """The windows, not found yet, that differ by whole words."""
        words = t.split(" ")
        for w, start in sorted(near):
            row, p, _ = self.patterns[w]
            if w in found.get(row, {}):
                continue
            own, e = self.words[w], word_budget(len(self.words[w]))
            low, high = max(0, start - e), min(len(words), start + len(own) + e)
            hit = myers(own, words[low:high], e)
            if hit is not None:
                stop = low + hit[1]
                begin = max(0, stop - len(own) - e)
                distance, _ = myers(p, " ".join(words[begin:stop]), len(p))
                note(w, distance, blanks[stop - 1])


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded block at a time."""
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r.item_id, r.text) for r in part.collect()]


def contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item whose passage it holds."""
    sc, parts = docs.sparkSession.sparkContext, []
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    for block in blocks(items, block_bytes):
        shared = sc.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forget_encoders()
            matcher = Matcher(shared.value)
            for batch in slices(batches, "text"):
                out = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in matcher.find(t)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "n_windows", "distance", "at"])

        parts.append(rows.mapInArrow(find, FOUND))
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], FOUND)


def clean(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the contaminated ones, columns as they are; decided where each document is read."""
    sc = docs.sparkSession.sparkContext
    out, names = renamed(docs)
    schema, text = out.schema, names["text"]
    for block in blocks(items, block_bytes):
        shared = sc.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forget_encoders()
            matcher = Matcher(shared.value)
            for batch in slices(batches, text):
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(text).to_pylist()], pa.bool_()))

        out = out.mapInArrow(keep, schema)
    return out.toDF(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
