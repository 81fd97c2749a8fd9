"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that are no letters counts as one blank. The 1- to
4-grams of code points are hashed into ``BUCKETS`` counters. Training counts n-grams per language in
every partition (a ``languages x BUCKETS`` table at most comes out of a task) and adds them up; the
driver turns the sum into smoothed log-probabilities and broadcasts the matrix, whose size is checked.

Scoring takes many documents at once: their n-grams are one array of matrix rows, sparse but for the
counts, which are gathered and added up per document by ``np.add.reduceat``. Log-probabilities are held as
integers of ``1 / SCALE``, so that sums are exact, and a document's score is the same in any batch. A text of
any length is scored whole, a piece at a time.

The model is fitted on a bounded sample of labelled rows: about ``SAMPLE`` documents of each language,
taken by a hash of doc_id, so that fitting costs the same at any scale. More than ``MOST_LANGUAGES`` labels
are an error, as the matrix, the counts and the broadcast grow with them.

Defined results: null text, or text without a letter: ``und`` with score 0. No labelled row at all:
``und`` for every document. Ties go to the language whose name comes first. Repeated rows are
predicted alike; columns other than doc_id, text, lang are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import forget_encoders, renamed, slices, table

BUCKETS, GRAMS, SMOOTHING = 1 << 15, (1, 2, 3, 4), 0.5
#: Documents of each language that are fitted on, about.
SAMPLE = 3000
#: The score is the posterior of the mean n-gram log-likelihood times this many n-grams at most, so that it still tells sure from unsure texts.
EVIDENCE = 200
#: Code points that are scored at once.
PIECE = 1 << 16
SCALE, MOST_LANGUAGES = 1 << 16, 512

_LETTERS: np.ndarray | None = None
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Which of all code points are letters; built once per worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def codes(text: str | None) -> np.ndarray:
    """Lower-cased letters with single blanks between runs, a blank at either end; empty without letters."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = _letters()[c]
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint32)
    c = np.where(is_letter, c, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    c = c[keep]
    return np.concatenate([[32] if c[0] != 32 else [], c, [32] if c[-1] != 32 else []]).astype(np.uint32)


def buckets(c: np.ndarray) -> np.ndarray:
    """Hashed n-grams of one text."""
    wide, out = c.astype(np.uint64) + np.uint64(1), []
    h = np.zeros(len(c), dtype=np.uint64)
    for n in GRAMS:
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * _MIX) ^ wide[n - 1 :]
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append((h >> np.uint64(64 - 15)).astype(np.int32) if BUCKETS == 1 << 15 else (h % np.uint64(BUCKETS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def gram_starts(c: np.ndarray, n: int, doc: np.ndarray) -> np.ndarray:
    """Where the n-grams of ``buckets`` begin that lie within one document, given each code point's document."""
    return doc[: len(c) - n + 1] == doc[n - 1 :]


class Model:
    """Languages and the log-probability matrix, ``BUCKETS x languages``, in integers of ``1 / SCALE``."""

    def __init__(self, languages: list[str], log_prob: np.ndarray, prior: np.ndarray) -> None:
        self.languages, self.log_prob, self.prior = languages, log_prob, prior

    def totals(self, c: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities and numbers of n-grams of documents whose code points lie in ``c``, one after another."""
        k = len(ends)
        total, count = np.zeros((k, len(self.languages)), dtype=np.int64), np.zeros(k, dtype=np.int64)
        doc = np.repeat(np.arange(k), np.diff(ends, prepend=0))
        b, at = buckets(c), 0
        for n in GRAMS:
            width = max(0, len(c) - n + 1)
            if not width:
                break
            inside = gram_starts(c, n, doc)
            rows, owner = b[at : at + width][inside], doc[:width][inside]
            at += width
            if len(rows):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                total[owner[first]] += np.add.reduceat(self.log_prob[rows], first, axis=0, dtype=np.int64)
                count += np.bincount(owner, minlength=k)
        return total, count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        k = len(texts)
        total, count = np.zeros((k, len(self.languages)), dtype=np.int64), np.zeros(k, dtype=np.int64)
        held: list[np.ndarray] = []
        names: list[int] = []

        def flush() -> None:
            if held:
                t, n = self.totals(np.concatenate(held), np.cumsum([len(x) for x in held]))
                np.add.at(total, names, t)
                np.add.at(count, names, n)
                held.clear()
                names.clear()

        size = 0
        for i, text in enumerate(texts if self.languages else ()):
            c = codes(text)
            for start in range(0, len(c), PIECE):
                part = c[start : start + PIECE + max(GRAMS) - 1]
                if start + PIECE < len(c):  # n-grams that begin in the piece, and no others
                    b, per = buckets_at(c, start, start + PIECE), self.log_prob
                    total[i] += per[b].sum(axis=0, dtype=np.int64)
                    count[i] += len(b)
                    continue
                held.append(part)
                names.append(i)
                size += len(part)
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        sums, n = total / SCALE, np.maximum(count, 1)[:, None]
        best = (sums + self.prior).argmax(axis=1) if self.languages else np.zeros(k, dtype=np.int64)
        x = sums * np.minimum(1.0, EVIDENCE / n) + self.prior
        p = np.exp(x - x.max(axis=1, keepdims=True)) if self.languages else x
        return [(self.languages[j], float(p[i, j] / p[i].sum())) if m else ("und", 0.0) for i, (j, m) in enumerate(zip(best.tolist(), count.tolist(), strict=True))]


def buckets_at(c: np.ndarray, start: int, end: int) -> np.ndarray:
    """N-grams that begin in ``[start, end)``."""
    piece = c[start : min(len(c), end + max(GRAMS) - 1)]
    b = buckets(piece)
    out, at = [], 0
    for n in GRAMS:
        count = max(0, len(piece) - n + 1)
        out.append(b[at : at + min(count, end - start)])
        at += count
    return np.concatenate(out)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``labelled(doc_id, text, lang)``; null languages and texts are left out by the caller."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{len(sizes)} languages are more than the model holds; the most are {MOST_LANGUAGES}")
    languages = sorted(sizes)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, sample / sizes[k]) * (1 << 31))))])
    taken = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.element_at(share, F.col("lang")))
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in slices(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                b = buckets(codes(text))
                np.add.at(table_[index[lang]], b, 1) if len(b) < 2000 else table_[index[lang]].__iadd__(np.bincount(b, minlength=BUCKETS))
        at = np.flatnonzero(table_.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([zlib.compress(table_[i].tobytes(), 1) for i in at], pa.binary())], names=["language", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("language").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                c = np.frombuffer(zlib.decompress(raw), dtype=np.int64)
                sums[i] = sums[i] + c if i in sums else c
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["language", "counts"])

    kind = "language long, counts binary"
    counted = taken.select("text", "lang").mapInArrow(count, kind)
    merged = counted.repartition(min(16, len(languages)), "language").mapInArrow(add, kind)
    counts = np.zeros((len(languages), BUCKETS))
    for r in merged.collect():  # one row of fixed size per language
        counts[r.language] += np.frombuffer(zlib.decompress(bytes(r.counts)), dtype=np.int64)
    smooth = counts + SMOOTHING
    log_prob = np.rint(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T * SCALE).astype(np.int32)
    n = np.array([sizes[k] for k in languages], dtype=np.float64)
    return Model(languages, np.ascontiguousarray(log_prob), np.log(n / n.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; needs doc_id and text, keeps those two and ``held_out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        m = shared.value
        for batch in slices(batches, "text"):
            found = m.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """``docs`` in a language the model knows, with at least ``min_score``; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain, name = renamed(docs)
    text = name["text"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        m = shared.value
        for batch in slices(batches, text):
            found = m.predict(batch.column(text).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= min_score for lang, score in found], pa.bool_()))

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(training_rows(docs)))
