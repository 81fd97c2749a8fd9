"""Token-id files with Elias-Fano coded document boundaries.

A segment is one run of ascending doc_ids. Its blob, written to real files by Spark's own text
writer (which copies bytes as they are) and so into any store, is, all little-endian:

    magic "EFTK", version u32, bytes that follow u64,
    partition u32, segment u32, ids of the partition before the segment u64,
    documents u64, ids u64, low bits u32, high bytes u64, low bytes u64, select samples u32, doc_id bytes u64,
    high bits | low bits | select samples (u32 each) | doc_ids (differences as i64, zlib) | ids (u16 each)

A newline follows each blob, and a file is closed after ``FILE_SEGMENTS`` of them, so that a reader holds a
bounded part of a partition at a time; since each segment says how many ids lie before it, files may be read
in any order.

The boundaries e_0 <= e_1 <= ... (ids up to the end of each document) are Elias-Fano coded: the low
``l = floor(log2(u / n))`` bits are packed side by side and the high parts are unary in a bitmap of
``n + (u >> l)`` bits, so a boundary takes about ``2 + log2(u / n)`` bits. Every 64th set bit's
position is sampled; ``select(i)`` starts there and counts bits on from it. The reader finds every
document's ids by ``select``.

Ids are those of the plain library call: control strings of the vocabulary that stand in a text are their
special ids.

Defined results: null text has the end id alone; repeated doc_ids keep one entry each, ordered by
text; null doc_id sorts first and is stored as the smallest 64-bit integer; an empty table gives no
files' entries; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import encoder, fresh_path, slices, stash, table

MAGIC, VERSION = b"EFTK", 2
HEAD = struct.Struct("<4sIQ")
BODY = struct.Struct("<IIQQQIQQIQ")
SAMPLE = 64
#: A segment is closed beyond so many ids, which bounds a blob to a few MB (one document may exceed it).
SEGMENT_IDS = 1_000_000
#: Segments of a file.
FILE_SEGMENTS = 16
NO_ID = -(1 << 63)


class EliasFano:
    """A non-decreasing sequence in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, high: bytes, low: bytes, samples: np.ndarray) -> None:
        self.n, self.l, self.samples = n, low_bits, samples
        self.high, self.low = high, low
        self._bits = np.frombuffer(high, dtype=np.uint8)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, dtype="<u4"))
        u = int(values[-1])
        width = max(0, (u // n).bit_length() - 1)
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
        bits[at] = 1
        if width:
            lows = (values & np.uint64((1 << width) - 1)).astype(np.uint64)
            flat = ((lows[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            low = np.packbits(flat, bitorder="little").tobytes()
        else:
            low = b""
        return cls(n, width, np.packbits(bits, bitorder="little").tobytes(), low, at[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        if not self.l:
            return 0
        first = i * self.l
        raw = int.from_bytes(self.low[first // 8 : (first + self.l + 7) // 8], "little")
        return (raw >> (first % 8)) & ((1 << self.l) - 1)

    def select(self, i: int) -> int:
        """Position of set bit ``i``: from the sample before it, a byte at a time."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        held = self.high[byte] >> (at % 8) << (at % 8)
        while (k := held.bit_count()) <= left:
            left -= k
            byte += 1
            held = self.high[byte]
        for _ in range(left):
            held &= held - 1
        return byte * 8 + (held & -held).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return ((self.select(i) - i) << self.l) | self._low(i)

    def all(self) -> np.ndarray:
        """The whole sequence at once."""
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        ones = np.flatnonzero(np.unpackbits(self._bits, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.l
        if self.l:
            flat = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8), bitorder="little")[: self.n * self.l]
            out = out | (flat.reshape(self.n, self.l).astype(np.int64) << np.arange(self.l)).sum(axis=1)
        return out


def pack_segment(partition: int, segment: int, before: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """``ids``: each document's 16-bit ids, its end id included; ``before``: ids of the partition's earlier segments."""
    ends = np.cumsum([len(x) // 2 for x in ids])
    ef = EliasFano.encode(ends)
    names = np.array([NO_ID if d is None else d for d in doc_ids], dtype="<i8")
    kept = zlib.compress(np.concatenate([names[:1], names[1:] - names[:-1]]).astype("<i8").tobytes(), 1)
    body = BODY.pack(partition, segment, before, ef.n, int(ends[-1]) if len(ends) else 0, ef.l, len(ef.high), len(ef.low), len(ef.samples), len(kept))
    rest = b"".join((body, ef.high, ef.low, ef.samples.tobytes(), kept, *ids))
    return HEAD.pack(MAGIC, VERSION, len(rest)) + rest


class Segment:
    """A blob, opened for reading at ``at``; ``end`` is where the next one may begin."""

    def __init__(self, raw: bytes, at: int = 0) -> None:
        magic, version, size = HEAD.unpack_from(raw, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id segment")
        self.end = at + HEAD.size + size
        self.partition, self.segment, self.before, self.n_docs, self.n_ids, width, highs, lows, samples, names = BODY.unpack_from(raw, at + HEAD.size)
        p = at + HEAD.size + BODY.size
        high, p = raw[p : p + highs], p + highs
        low, p = raw[p : p + lows], p + lows
        sample, p = np.frombuffer(raw, dtype="<u4", count=samples, offset=p), p + 4 * samples
        deltas, p = np.frombuffer(zlib.decompress(raw[p : p + names]), dtype="<i8"), p + names
        self.bounds = EliasFano(self.n_docs, width, high, low, sample)
        self.doc_ids = np.cumsum(deltas)
        self.ids = np.frombuffer(raw, dtype="<u2", count=self.n_ids, offset=p)

    def span(self, i: int) -> tuple[int, int]:
        """Where the i-th document's ids begin and end, by two selects."""
        return self.bounds[i - 1] if i else 0, self.bounds[i]

    def document(self, i: int) -> np.ndarray:
        begin, end = self.span(i)
        return self.ids[begin:end]


def segments(raw: bytes) -> Iterator[Segment]:
    """All blobs of a file; the writer ends each with a newline."""
    at = 0
    while at < len(raw):
        s = Segment(raw, at)
        yield s
        at = s.end + 1


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs(doc_id, text)`` in ascending order of doc_id and write the files to ``path``.

    The texts are dealt by ranges of doc_id once; encoding and writing follow in the same stage.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end = encoder(tokenizer, drops_space=False), np.array([end_id], dtype="<u2").tobytes()
        names: list[int | None] = []
        held: list[bytes] = []
        size, count, part, before = 0, 0, 0, 0
        for batch in slices(batches, "text"):
            part = batch.column("part")[0].as_py()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), model.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                names.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 2 + 1
                if size >= segment_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_segment(part, count, before, names, held)], pa.binary())], names=["blob"])
                    names, held, before, size, count = [], [], before + size, 0, count + 1
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([pack_segment(part, count, before, names, held)], pa.binary())], names=["blob"])

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blobs = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(build, "blob binary")
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (among all files' ids), n_tokens and the ids' checksum, from the files alone.

    The files are read once. What lies before each partition of the writer is summed from one number per
    partition; the table of offsets that is broadcast has a row for each.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                for s in segments(raw):
                    starts, sizes, sums, begin = [], [], [], 0
                    for i in range(s.n_docs):
                        end = s.bounds[i]
                        starts.append(s.before + begin)
                        sizes.append(end - begin)
                        sums.append(zlib.crc32(s.ids[begin:end].astype("<u4").tobytes()))
                        begin = end
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(s.n_docs, s.partition)), pa.array(s.doc_ids, mask=s.doc_ids == NO_ID), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                        names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )

    docs, _ = stash(files.mapInArrow(rows, "part long, doc_id long, local long, n_tokens long, ids_crc32 long"), "token-rows")
    before, base = 0, []
    for r in sorted(docs.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base.append((r.part, before))
        before += r.n
    offsets = spark.createDataFrame(base or [(0, 0)], "part long, base long")
    return docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path)
