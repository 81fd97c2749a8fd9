"""Contact maps from alignments that are grouped by read, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.sources.shared import stash

SECONDARY, UNMAPPED, SUPPLEMENTARY = 256, 4, 2048


def usable(alignments: DataFrame, min_mapq: int = 0, prefix: str | None = None) -> DataFrame:
    """Primary, mapped alignments of enough quality, on contigs of a prefix."""
    keep = (F.col("mapq") >= min_mapq) & (F.col("flag").bitwiseAND(SECONDARY | UNMAPPED) == 0)
    return alignments.where(keep & F.col("contig").cast("string").startswith(prefix) if prefix else keep)


def _per_read(alignments: DataFrame, *more: str) -> DataFrame:
    return alignments.groupBy("read", "contig", *more).agg(F.count("*").alias("n"))


def contact_map(alignments: DataFrame) -> DataFrame:
    """(a, b, weight), a <= b: pairs of alignments of one read, counted.

    Reads are reduced to counts per contig before they are joined with themselves, so a read costs the
    square of its distinct contigs, not of its alignments, and no row needs an id.
    """
    n = _per_read(alignments)
    a, b = n.select("read", F.col("contig").alias("a"), F.col("n").alias("na")), n.select("read", F.col("contig").alias("b"), F.col("n").alias("nb"))
    pairs = F.when(F.col("a") == F.col("b"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    return a.join(b, "read").where("a <= b").groupBy("a", "b").agg(F.sum(pairs).cast("long").alias("weight")).where("weight > 0")


def symmetric(contacts: DataFrame) -> DataFrame:
    """Both directions of every edge; self weights count twice."""
    both = contacts.unionByName(contacts.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return both.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def contact_map_by_mapq(alignments: DataFrame) -> DataFrame:
    """(a, b, mapq, weight), each pair at the lesser of its two qualities."""
    n = _per_read(alignments, "mapq")
    a = n.select("read", F.col("contig").alias("a"), F.col("mapq").alias("qa"), F.col("n").alias("na"))
    b = n.select("read", F.col("contig").alias("b"), F.col("mapq").alias("qb"), F.col("n").alias("nb"))
    same = (F.col("a") == F.col("b")) & (F.col("qa") == F.col("qb"))
    pairs = F.when(same, F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    once = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("qa") <= F.col("qb")))
    return a.join(b, "read").where(once).groupBy("a", "b", F.least("qa", "qb").alias("mapq")).agg(F.sum(pairs).cast("long").alias("weight")).where("weight > 0")


def coverage(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("contig").agg(F.count("*").alias("coverage"))


def mapq_distribution(alignments: DataFrame) -> DataFrame:
    return alignments.groupBy("mapq").agg(F.count("*").alias("n"))


def bins(histogram: DataFrame, bin_col: str, low: int, high: int) -> Column:
    """Array of every bin from ``low`` to ``high``, and further if the histogram has bins beyond."""
    found = histogram.agg(F.min(bin_col).alias("a"), F.max(bin_col).alias("b")).first()
    low, high = (low, high) if found.a is None else (min(low, found.a), max(high, found.b))
    return F.sequence(F.lit(low), F.lit(high))


def reverse_cdf(histogram: DataFrame, bin_col: str, low: int, high: int, *by: str) -> DataFrame:
    """Counts at or above each bin of a dense grid; the histogram has one row per bin, so the window is small."""
    groups = histogram.select(*by).distinct() if by else histogram.sparkSession.range(1)
    grid = groups.select(*by, F.explode(bins(histogram, bin_col, low, high)).alias(bin_col))
    dense = grid.join(histogram, [*by, bin_col], "left").fillna(0, ["n"])
    w = Window.partitionBy(*by).orderBy(F.desc(bin_col)).rowsBetween(Window.unboundedPreceding, 0)
    return dense.select(*by, bin_col, "n", F.sum("n").over(w).alias("at_least"))


def phase_signal(by_mapq: DataFrame, parts: DataFrame, low: int, high: int) -> DataFrame:
    """Per quality: weight of edges between nodes of equal and of opposite phase at that quality or above, and their ratio."""
    p = lambda x: parts.select(F.col("node").alias(x), F.col("partition").alias(f"p{x}"))
    e = by_mapq.where("a <> b").join(p("a"), "a").join(p("b"), "b").where("pa <> 0 AND pb <> 0")
    h = e.groupBy("mapq").agg(F.sum(F.when(F.col("pa") == F.col("pb"), F.col("weight")).otherwise(0)).alias("same"), F.sum("weight").alias("total"))
    h, _ = stash(h, "phase-signal")  # one row a quality, read twice
    w = Window.orderBy(F.desc("mapq")).rowsBetween(Window.unboundedPreceding, 0)
    grid = by_mapq.sparkSession.range(1).select(F.explode(bins(h, "mapq", low, high)).alias("mapq"))
    d = grid.join(h, "mapq", "left").fillna(0, ["same", "total"]).select("mapq", F.sum("same").over(w).alias("consistent"), F.sum("total").over(w).alias("total"))
    return d.select("mapq", "consistent", (F.col("total") - F.col("consistent")).alias("inconsistent"), F.round(F.col("consistent") / F.nullif(F.col("total").cast("double"), F.lit(0.0)), 9).alias("ratio"))


def linked_reads(alignments: DataFrame) -> DataFrame:
    """Reads of two alignments or more, with their number."""
    return alignments.groupBy("read").agg(F.count("*").alias("n")).where("n >= 2")


def gap_histogram(alignments: DataFrame, position: Column, width: int) -> DataFrame:
    """Distances between alignments of one read on one contig, per bin; from counts per (read, contig, position)."""
    n = alignments.groupBy("read", "contig", position.alias("p")).agg(F.count("*").alias("n"))
    a, b = n.select("read", "contig", F.col("p").alias("pa"), F.col("n").alias("na")), n.select("read", "contig", F.col("p").alias("pb"), F.col("n").alias("nb"))
    pairs = F.when(F.col("pa") == F.col("pb"), F.expr("na * (na - 1) div 2")).otherwise(F.col("na") * F.col("nb"))
    gaps = a.join(b, ["read", "contig"]).where("pa <= pb").select((F.floor((F.col("pb") - F.col("pa")) / width) * width).cast("long").alias("bin_start"), pairs.alias("n"))
    return gaps.groupBy("bin_start").agg(F.sum("n").cast("long").alias("count")).where("count > 0")
