"""BAM files written here, read back whole and in small ranges."""

import random
import struct
import zlib

import pytest

from strandframe.sources import bam

REFS = [("c1.0", 9000), ("c1.1", 8000), ("c2", 70000)]


def block(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def encode(name, flag, ref, mapq, ops, pos, n_bases):
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, n_bases, -1, -1, 0)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops)
    body += bytes((n_bases + 1) // 2) + b"\xff" * n_bases
    return struct.pack("<i", len(body)) + body


def write(path, rows, piece):
    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(REFS))
    for name, length in REFS:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    data += b"".join(encode(*r) for r in rows)
    path.write_bytes(b"".join(block(data[i : i + piece]) for i in range(0, len(data), piece)) + block(b""))


def made(n):
    r = random.Random(5)
    rows = []
    for i in range(n):
        ops = [(r.randint(1, 90), r.choice("MIDNSHP=X")) for _ in range(r.randint(0, 6))]
        rows.append((f"read/{i // 3}", r.choice([0, 4, 16, 256]), r.randint(-1, 2), r.randint(0, 60), ops, r.randint(-1, 5000), r.choice([0, 1, 50, 3000])))
    return rows


@pytest.mark.parametrize(("n", "piece", "width"), [(0, 900, 500), (1, 60000, 1 << 26), (700, 900, 2000), (700, 60000, 3000), (300, 70, 4000)])
def test_every_record_once(spark, tmp_path, n, piece, width):
    rows = made(n)
    write(tmp_path / "x.bam", rows, piece)
    got = sorted(map(tuple, bam.bam_alignments(spark, str(tmp_path / "x.bam"), width).collect()))
    names = [x for x, _ in REFS]
    assert got == sorted((q, f, names[t] if t >= 0 else "*", m, "".join(f"{k}{o}" for k, o in ops) or "*", p) for q, f, t, m, ops, p, _ in rows)
    assert [tuple(r) for r in bam.bam_refs(spark, str(tmp_path)).collect()] == REFS


def test_damage_is_reported(spark, tmp_path):
    write(tmp_path / "x.bam", made(50), 900)
    data = bytearray((tmp_path / "x.bam").read_bytes())
    data[40] ^= 255
    (tmp_path / "y.bam").write_bytes(data)
    with pytest.raises(Exception):  # noqa: B017
        bam.bam_alignments(spark, str(tmp_path / "y.bam")).collect()
