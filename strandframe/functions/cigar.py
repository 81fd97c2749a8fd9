"""CIGAR strings as arrays of (length, op), and what alignments derive from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = r"(\d+)([MIDNSHP=X])"
#: Operations that use up reference and query letters, and those counted as matching.
REFERENCE, QUERY, MATCH = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X"), ("M", "=")


def parse(cigar: Column) -> Column:
    """Operations in order; ``*``, the empty string and zero lengths have none. Anything else that is no operation is an error."""
    wrong = F.raise_error(F.concat(F.lit("not a CIGAR: "), F.substring(cigar, 1, 60))).cast("string")
    cigar = F.when(cigar.isNull() | cigar.isin("*", "") | cigar.rlike("^(\\d+[MIDNSHP=X])+$"), cigar).otherwise(wrong)
    n = F.regexp_extract_all(cigar, F.lit(OPS), F.lit(1))
    o = F.regexp_extract_all(cigar, F.lit(OPS), F.lit(2))
    both = F.transform(F.arrays_zip(n.alias("n"), o.alias("o")), lambda x: F.struct(x.n.cast("int").alias("len"), x.o.alias("op")))
    return F.filter(both, lambda x: x.len > 0)


def render(ops: Column) -> Column:
    """Text of operations; none: ``0M``."""
    return F.coalesce(F.nullif(F.array_join(F.transform(ops, lambda x: F.concat(x.len.cast("string"), x.op)), ""), F.lit("")), F.lit("0M"))


def flipped(ops: Column) -> Column:
    """The same overlap seen from the other strand and the other sequence: reversed, with I and D exchanged; clips, N and P have no such view and are an error."""
    ops = F.when(F.exists(ops, lambda x: x.op.isin("S", "H", "N", "P")), F.raise_error(F.lit("a CIGAR with S, H, N or P cannot be turned")).cast("array<struct<len:int,op:string>>")).otherwise(ops)
    return F.transform(F.reverse(ops), lambda x: F.struct(x.len.alias("len"), F.when(x.op == "I", "D").when(x.op == "D", "I").otherwise(x.op).alias("op")))


def total(ops: Column, kinds: tuple[str, ...], cap: int | None = None) -> Column:
    """Summed lengths of some operations, each capped if wished."""
    one = (lambda x: F.least(x.len, F.lit(cap))) if cap else (lambda x: x.len)
    return F.aggregate(F.filter(ops, lambda x: x.op.isin(*kinds)), F.lit(0).cast("long"), lambda acc, x: acc + one(x))


def identity(ops: Column, indel_cap: int = 20) -> Column:
    """Matches over matches, mismatches and indels, the latter capped each."""
    m, x, indel = total(ops, MATCH), total(ops, ("X",)), total(ops, ("I", "D"), indel_cap)
    return m / F.nullif((m + x + indel).cast("double"), F.lit(0.0))


def summary(ops: Column, indel_cap: int = 20) -> Column:
    """Struct of matches, mismatches, and insertions and deletions, each capped; ``M`` is an error, as it tells matches and mismatches not apart."""
    known = F.when(F.exists(ops, lambda x: x.op == "M"), F.raise_error(F.lit("a CIGAR with M has no identity")).cast("array<struct<len:int,op:string>>")).otherwise(ops)
    return F.struct(total(known, ("=",)).alias("matches"), total(known, ("X",)).alias("mismatches"), total(known, ("I",), indel_cap).alias("inserts"), total(known, ("D",), indel_cap).alias("deletes"))


def summary_identity(matches: Column, mismatches: Column, inserts: Column, deletes: Column) -> Column:
    return matches / (matches + mismatches + inserts + deletes + F.lit(1e-12))


def oriented_events(ops: Column, least: int, reversed_: Column, ref_start: Column, ref_stop: Column, query_start: Column, query_stop: Column) -> Column:
    """Events with coordinates: those of the reference ascend, those of a reversed query descend from its end."""
    walked = events(ops, least)
    at = lambda e: F.when(reversed_, query_stop - e.query_at).otherwise(query_start + e.query_at)
    return F.transform(walked, lambda e: F.struct(e.op.alias("op"), e.len.alias("len"), (ref_start + e.ref_at).alias("ref_at"), at(e).alias("query_at")))


def events(ops: Column, least: int = 1) -> Column:
    """Insertions, deletions and mismatches of a length or more, with the letters of reference and query before each."""
    start = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<op:string,len:int,ref_at:bigint,query_at:bigint>>").alias("e"))

    def step(acc, x):
        seen = F.array(F.struct(x.op.alias("op"), x.len.alias("len"), acc.r.alias("ref_at"), acc.q.alias("query_at")))
        kept = F.when(x.op.isin("I", "D", "X") & (x.len >= least), F.concat(acc.e, seen)).otherwise(acc.e)
        moved = lambda at, kinds: at + F.when(x.op.isin(*kinds), x.len).otherwise(0)
        return F.struct(moved(acc.r, REFERENCE).alias("r"), moved(acc.q, QUERY).alias("q"), kept.alias("e"))

    return F.aggregate(ops, start, step).e
