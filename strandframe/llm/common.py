"""Shared plumbing of the training-data operators: table access, the shared folder, whole-text tokenisation.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from strandframe.sources.shared import discard, fresh_path, shared_dir, stash

__all__ = ["WordCachedEncoder", "discard", "encoder", "forget_encoders", "fresh_path", "renamed", "shared_dir", "slices", "stash", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark only, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., and each name's new one: names with dots, or that clash with an operator's own, do no harm."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most_bytes`` a slice, one row at least."""
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


class WordCachedEncoder:
    """Encode whole texts with a ``tokenizers`` model, remembering the ids of the chunks between blanks.

    Both public vocabularies split a text into words before they merge bytes, and a single blank or
    newline between two other characters is always a word boundary. So a text's ids are its chunks'
    ids, one after another. Texts whose white space is of another kind, or that hold one of the vocabulary's
    control strings (which the library gives their special ids), go to the library as they are.
    The memory is bounded: it is emptied at ``most`` chunks.
    """

    def __init__(self, path: str, drops_space: bool, most: int = 300_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.drops_space, self.most = drops_space, most
        self.known: dict[str, bytes] = {}
        self._plain = Tokenizer(self.model.model)
        self._plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._edges = np.zeros(1 << 16, dtype=bool)
        for token, i in self.model.get_vocab().items():
            self._edges[i] = token.endswith("</w>") if drops_space else token.startswith("\u0120")
        self._line = b"" if drops_space else self._ids("\n").tobytes()
        self._stops = {k: self._ids(k).tobytes() for k in (",", ".")}

    def _stem(self, stem: str) -> str | None:
        """A run of Latin letters as the model spells it; None: it is no such run."""
        if not stem.isalpha():
            return None
        if not stem.isascii():
            if max(stem) > "\u024f":
                return None
            stem = stem.lower() if self.drops_space else stem
            return stem.encode().decode("latin-1").translate(_BYTE_CHARS) if stem.isalpha() else None
        return stem.lower() if self.drops_space else stem

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks.

        Runs of letters, with a stop behind them or not, are words for the model as they are: they go to
        a copy of the tokenizer that only splits at blanks, and the marks of a word's begin or end in the
        vocabulary tell its ids apart. Other chunks go to the whole tokenizer, many in one text, told
        apart by a separator that is always tokens of its own.
        """
        new, rest, line = self.known, [], self._line
        words: list[str] = []
        names: list[tuple[str, bytes]] = []
        for c in chunks:
            stop = self._stops.get(c[-1], b"")
            stem = self._stem(c[:-1] if stop else c)
            if stem is None:
                rest.append(c)
            else:
                words.append(stem)
                names.append((c, stop))
        for start in range(0, len(words), 2000):
            part = words[start : start + 2000]
            text = " ".join(part) if self.drops_space else "\u0120" + " \u0120".join(part)
            ids = np.array(self._plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")
            edge = np.flatnonzero(self._edges[ids])
            ends = (edge + 1 if self.drops_space else np.append(edge[1:], len(ids))).tolist()
            assert len(ends) == len(part)
            raw, before = ids.tobytes(), 0
            for (c, stop), end in zip(names[start : start + 2000], ends, strict=True):
                new[c] = raw[2 * before : 2 * end] + stop
                before = end
        apart = " \ue000 " if self.drops_space else "\n"
        mark = self._ids(apart)
        for kind in (False, True):  # chunks behind a blank, chunks behind a newline
            group = [c for c in rest if (c[:1] == "\n") == kind and "\ue000" not in c]
            for start in range(0, len(group), 2000):
                part = group[start : start + 2000]
                heads = part if self.drops_space else [c[1:] for c in part] if kind else [" " + c for c in part]
                ids = self._ids(apart.join(heads))
                hit = ids[: len(ids) - len(mark) + 1] == mark[0]
                for k in range(1, len(mark)):
                    hit = hit & (ids[k : len(ids) - len(mark) + 1 + k] == mark[k])
                at = np.flatnonzero(hit).tolist()
                prefix = line if kind else b""
                if len(at) != len(part) - 1:
                    for c, head in zip(part, heads, strict=True):
                        new[c] = prefix + self._ids(head).tobytes()
                    continue
                raw, width, before = ids.tobytes(), len(mark), 0
                for c, end in zip(part, [*at, len(ids)], strict=True):
                    new[c] = prefix + raw[2 * before : 2 * end]
                    before = end + width
        for c in rest:
            if "\ue000" in c:
                new[c] = self._ids(c if self.drops_space or c[0] == "\n" else " " + c).tobytes()
        return new

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _chunks(self, text: str) -> tuple[str, list[str]] | None:
        """The first word, encoded by itself where a blank counts, and the chunks that follow; None: no plain text."""
        if any(t in text for t in self.special):
            return None
        if self.drops_space:
            return "", [c for c in text.replace("\n", " ").split(" ") if c]
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        if not text.isascii() or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text:
            if any(c.isspace() for c in set(text) - {" ", "\n"}):
                return None
        first, *rest = text.replace("\n", " \n").split(" ")
        return first, rest

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of every text."""
        if len(self.known) > self.most:
            self.known.clear()
        get = self.known.get
        found: list[tuple[bytes, list, list] | None] = []
        unknown: set[str] = set()
        for text in texts:
            s = self._chunks(text)
            if s is None:
                found.append((self._whole(text) if text else b"", [], []))
                continue
            ids = list(map(get, s[1]))
            gaps, at = [], -1
            with contextlib.suppress(ValueError):
                while True:
                    at = ids.index(None, at + 1)
                    gaps.append((at, s[1][at]))
            unknown.update(c for _, c in gaps)
            found.append((self._whole(s[0]) if s[0] else b"", ids, gaps))
        if unknown:
            learned = self._learn(list(unknown))
            for _, ids, gaps in found:
                for i, c in gaps:
                    ids[i] = learned[c]
        return [head + b"".join(ids) for head, ids, _ in found]


#: Byte to printable character, as byte-level vocabularies write it: printable Latin-1 stays, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}

_ENCODERS: dict[tuple, WordCachedEncoder] = {}


def encoder(path: str, drops_space: bool, most: int = 1_500_000) -> WordCachedEncoder:
    """One encoder for each file and Python worker; it outlives the task. A remembered chunk takes about 170 bytes."""
    key = (path, drops_space, most)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordCachedEncoder(path, drops_space, most)
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Give an encoder's memory back. Python workers outlive their tasks, so functions that need none call this first."""
    _ENCODERS.clear()
