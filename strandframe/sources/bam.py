"""BAM files as a Spark data source: byte ranges of each file are read in parallel.

A BAM file is a row of independently compressed blocks of at most 64 KiB, and records run across their
borders. Every task inflates the blocks that begin in its range and yields the records that begin in
them. Only the first range knows where its first record is; the others take the first offset at which
a run of well-formed records begins.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query_name string, flag int, ref_name string, mapq int, cigar string, ref_start int"
REFS = "name string, length bigint"
#: Fixed values of the format.
BLOCK_MAGIC, BAM_MAGIC, CIGAR_CODES, FIXED = b"\x1f\x8b\x08\x04", b"BAM\x01", "MIDNSHP=X", 32
#: Well-formed records that must follow each other before their first is taken for a record.
RUN = 10


def filesystem(path: str):
    """(filesystem, path in it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a BAM file, or of every BAM file in a directory."""
    from pyarrow import fs

    where, inner = filesystem(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = where.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".bam"))


def block_size(head: bytes) -> int | None:
    """Whole size of the block whose first bytes these are; None where no block begins."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class Blocks:
    """Inflated bytes of a file from a block on, with the file offset at which the last block began."""

    def __init__(self, handle, size: int, at: int) -> None:
        self.handle, self.size, self.at, self.data, self.marks, self.pos = handle, size, at, b"", [], 0

    def more(self) -> bool:
        """Take one more block in; False at the end of the file."""
        while self.at < self.size:
            self.handle.seek(self.at)
            whole = self.handle.read(1 << 16)
            length = block_size(whole[:256])
            if length is None or length > len(whole):
                raise ValueError(f"no whole BGZF block at byte {self.at}")
            start = 12 + struct.unpack_from("<H", whole, 10)[0]
            inflated = zlib.decompress(whole[start : length - 8], -15)
            if len(inflated) != struct.unpack_from("<I", whole, length - 4)[0] or zlib.crc32(inflated) != struct.unpack_from("<I", whole, length - 8)[0]:
                raise ValueError(f"damaged BGZF block at byte {self.at}")
            began, self.at = self.at, self.at + length
            if inflated:
                self.data, self.marks, self.pos = self.data[self.pos :], [(m - self.pos, f) for m, f in self.marks if m > self.pos or f == self.origin()], 0
                self.marks.append((len(self.data), began))
                self.data += inflated
                return True
        return False

    def origin(self) -> int:
        """File offset of the block that holds the byte at ``pos``."""
        return [f for m, f in self.marks if m <= self.pos][-1] if self.marks else self.at

    def has(self, n: int) -> bool:
        while len(self.data) - self.pos < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.has(n):
            raise ValueError("BAM data end inside a record")
        self.pos += n
        return self.data[self.pos - n : self.pos]


def header(blocks: Blocks) -> list[tuple[str, int]]:
    """(name, length) of the references; ``blocks`` then stands at the first record."""
    if blocks.take(4) != BAM_MAGIC:
        raise ValueError("not a BAM file")
    blocks.take(struct.unpack("<i", blocks.take(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", blocks.take(4))[0]):
        name = blocks.take(struct.unpack("<i", blocks.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", blocks.take(4))[0]))
    return refs


def well_formed(data: bytes, at: int, n_refs: int) -> int | None:
    """Where the record at ``at`` ends; -1 if the data end too early to tell; None if no record can begin there."""
    if at + 4 + FIXED > len(data):
        return -1
    size, ref, pos, name_len, _, _, n_ops, _, n_bases, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    body = FIXED + name_len + 4 * n_ops + (n_bases + 1) // 2 + n_bases
    if not (-1 <= ref < n_refs and -1 <= mate < n_refs and pos >= -1 and mate_pos >= -1 and name_len and n_bases >= 0 and size >= body):
        return None
    begin = at + 4 + FIXED
    name = data[begin : begin + name_len]
    if len(name) == name_len and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[begin + name_len : begin + name_len + 4 * n_ops]
    return None if any(c & 15 > 8 for c in ops[: len(ops) // 4 * 4 : 4]) else at + 4 + size


def first_record(blocks: Blocks, n_refs: int) -> bool:
    """Move to the first record that begins in the block just taken in or later; False if there is none."""
    at = 0
    while blocks.has(at + 1):
        end, seen = at, 0
        while seen < RUN:
            after = well_formed(blocks.data, end, n_refs)
            if after is None:
                break
            if after < 0 or after > len(blocks.data):
                if blocks.more():
                    continue
                # the file's end: a run that ends with it exactly is as good as a long one
                seen = RUN if end == len(blocks.data) and seen else -1
                break
            end, seen = after, seen + 1
        if seen == RUN:
            blocks.pos = at
            return True
        at += 1
    return False


def record(body: bytes, refs: list[tuple[str, int]]) -> tuple:
    ref, pos, name_len, mapq, _, n_ops, flag = struct.unpack_from("<iiBBHHH", body)
    ops = struct.unpack_from(f"<{n_ops}I", body, FIXED + name_len)
    text = "".join(f"{o >> 4}{CIGAR_CODES[o & 15]}" for o in ops) or "*"
    return body[FIXED : FIXED + name_len - 1].decode(), flag, refs[ref][0] if ref >= 0 else "*", mapq, text, pos


class Range(InputPartition):
    def __init__(self, path: str, size: int, low: int, high: int) -> None:
        self.path, self.size, self.low, self.high = path, size, low, high


class BamReader(DataSourceReader):
    def __init__(self, path: str, width: int, only_refs: bool) -> None:
        self.path, self.width, self.only_refs = path, width, only_refs

    def partitions(self) -> list[Range]:
        width = self.width
        return [Range(p, size, low, min(low + width, size)) for p, size in files(self.path) for low in ([0] if self.only_refs else range(0, size, width))]

    def read(self, part: Range) -> Iterator[tuple]:
        where, inner = filesystem(part.path)
        with where.open_input_file(inner) as handle:
            blocks = Blocks(handle, part.size, 0)
            refs = header(blocks)
            if self.only_refs:
                yield from refs
                return
            if part.low:
                start = first_block(handle, part.size, part.low, part.high)
                if start is None:
                    return
                blocks = Blocks(handle, part.size, start)
                if not first_record(blocks, len(refs)):
                    return
            while blocks.has(4) and blocks.origin() < part.high:
                yield record(blocks.take(struct.unpack("<i", blocks.take(4))[0]), refs)


def first_block(handle, size: int, low: int, high: int) -> int | None:
    """Offset of the first block that begins in [low, high): its successor must begin a block or be the file's end."""
    handle.seek(low)
    data = handle.read(min(size, high + (1 << 17)) - low)
    at = data.find(BLOCK_MAGIC)
    while at >= 0 and low + at < high:
        length = block_size(data[at : at + 256])
        if length and (low + at + length == size or block_size(data[at + length : at + length + 256])):
            return low + at
        at = data.find(BLOCK_MAGIC, at + 1)
    return None


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``; options ``split_bytes`` (64 MB) and ``refs`` (the header's references instead)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def _refs(self) -> bool:
        return self.options.get("refs", "false") == "true"

    def schema(self) -> str:
        return REFS if self._refs() else SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], int(self.options.get("split_bytes", 1 << 26)), self._refs())


def bam_alignments(spark: SparkSession, path: str, split_bytes: int = 1 << 26) -> DataFrame:
    """(query_name, flag, ref_name, mapq, cigar, ref_start) of all records, unmapped ones with ref_name ``*``."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("split_bytes", str(split_bytes)).load(path)


def bam_refs(spark: SparkSession, path: str) -> DataFrame:
    """(name, length) of the header's references."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("refs", "true").load(path)
