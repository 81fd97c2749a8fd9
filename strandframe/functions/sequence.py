"""Nucleotide sequences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(s: Column) -> Column:
    """Base by base; an error for a letter other than A, C, G, T, N."""
    wrong = F.raise_error(F.concat(F.lit("no complement of a letter in: "), F.substring(s, 1, 60))).cast("string")
    return F.when(s.rlike("^[ACGTN]*$"), F.translate(s, "ACGTN", "TGCAN")).when(s.isNotNull(), wrong)


def reverse_complement(s: Column) -> Column:
    """The other strand; an error for a letter other than A, C, G, T, N."""
    return F.reverse(complement(s))


def trimmed(s: Column, most: int) -> Column:
    """The first ``most`` letters."""
    return F.substring(s, 1, most)


def canonical(kmer: Column) -> Column:
    """The lesser of both strands, so membership of either strand is plain equality."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGTN", "TGCAN")))


def kmers(s: Column, k: int) -> Column:
    """Array of all windows of ``k`` letters of an ASCII sequence; empty for a shorter one.

    The sequence is bound once, as bytes, so that a window costs its own length and not its distance
    from the beginning, as it would in a string of variable-width characters.
    """
    if not 1 <= k <= 64:
        raise ValueError("k must be from 1 to 64")

    def windows(b: Column) -> Column:
        n = F.octet_length(b)
        at = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(b, i, F.lit(k)).cast("string"))

    return F.get(F.transform(F.array(s.cast("binary")), windows), F.lit(0))


def pack_2bit(kmer: Column) -> Column:
    """BIGINT code of up to 31 letters, first letter lowest; the length is not part of it."""
    codes = F.transform(F.split(kmer, ""), lambda c: F.instr(F.lit("ACGT"), c) - 1)
    code = F.aggregate(F.reverse(F.filter(codes, lambda c: c >= 0)), F.lit(0).cast("long"), lambda acc, c: F.shiftleft(acc, 2) + c)
    return F.when(kmer.rlike("^[ACGT]{1,31}$"), code).when(kmer.isNotNull(), F.raise_error(F.concat(F.lit("not 1 to 31 of A, C, G, T: "), kmer)).cast("long"))


def unpack_2bit(code: Column, k: int) -> Column:
    """The ``k`` letters of a code of ``pack_2bit``."""
    return F.concat(*[F.substring(F.lit("ACGT"), F.shiftrightunsigned(code, 2 * i).bitwiseAND(3).cast("int") + 1, F.lit(1)) for i in range(k)])


def seeded_hash(x: Column, seed: int) -> Column:
    """64-bit hash of a value under a seed."""
    return F.xxhash64(x, F.lit(seed))


def murmur3(x: Column) -> Column:
    """32-bit Murmur3 hash."""
    return F.hash(x)
