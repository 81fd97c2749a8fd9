"""Operators on paths: ordered steps over graph nodes, ``steps(path, step_index, node, reversed)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.sequence import reverse_complement
from strandframe.operators.kmers import located, packed_kmers, unpacked


def lengths(steps: DataFrame) -> DataFrame:
    """(path, length, n_steps) of ``steps(path, length)``; overlaps are not taken off."""
    return steps.groupBy("path").agg(F.sum("length").alias("length"), F.count("*").alias("n_steps"))


def oriented(node: Column, reversed_: Column) -> Column:
    return F.concat(node.cast("string"), F.when(reversed_, "-").otherwise("+"))


def provenance(steps: DataFrame) -> DataFrame:
    """(path, n_steps, nodes): a path's steps with their signs, joined by blanks."""
    s = steps.select("path", F.struct("step_index", oriented(F.col("node"), F.col("reversed")).alias("n")).alias("s"))
    return s.groupBy("path").agg(F.count("*").alias("n_steps"), F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x.n), " ").alias("nodes"))


def shared_nodes(steps: DataFrame) -> DataFrame:
    """(path_a, path_b, shared), path_a < path_b: nodes that two paths have in common."""
    st = steps.select("path", "node").distinct()
    a, b = st.withColumnRenamed("path", "path_a"), st.withColumnRenamed("path", "path_b")
    return a.join(b, "node").where("path_a < path_b").groupBy("path_a", "path_b").agg(F.count("*").alias("shared"))


def partners(steps: DataFrame) -> DataFrame:
    """(path, partner): the one path that shares a node with it; null for a path alone. More than one is an error."""
    st = steps.select("path", "node").distinct()
    other = st.select(F.col("path").alias("other"), "node")
    found = st.join(other, "node").where("path <> other").groupBy("path").agg(F.countDistinct("other").alias("n"), F.min("other").alias("partner"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("a path shares nodes with more than one other: "), F.col("path").cast("string"))).cast(dict(found.dtypes)["partner"])).otherwise(F.col("partner"))
    return st.select("path").distinct().join(found, "path", "left").select("path", checked.alias("partner"))


def diploid_by_ends(steps: DataFrame, halves: DataFrame) -> DataFrame:
    """(path, before, after): paths whose first step has one neighbour on the left, and whose last has one on the right."""
    ends = F.struct("step_index", "node", "reversed")
    e = steps.groupBy("path").agg(F.min(ends).alias("first"), F.max(ends).alias("last"))
    one = halves.groupBy("node", "side").agg(F.count("*").alias("degree"), F.min("other").alias("other")).where("degree = 1")
    left = one.select(F.col("node").alias("fn"), F.col("side").alias("fs"), F.col("other").alias("before"))
    right = one.select(F.col("node").alias("ln"), F.col("side").alias("ls"), F.col("other").alias("after"))
    outside = lambda rev, end: F.when(rev, 1 - end).otherwise(F.lit(end))
    j = e.select("path", F.col("first.node").alias("fn"), outside(F.col("first.reversed"), 0).alias("fs"), F.col("last.node").alias("ln"), outside(F.col("last.reversed"), 1).alias("ls"))
    return j.join(left, ["fn", "fs"]).join(right, ["ln", "ls"]).select("path", "before", "after")


def extended(steps: DataFrame, halves: DataFrame) -> DataFrame:
    """``steps`` with the unique neighbours of either end as steps -1 and n, marked ``added``; ``where NOT added`` takes them off again."""
    ends = F.struct("step_index", "node", "reversed")
    e = steps.groupBy("path").agg(F.min(ends).alias("first"), F.max(ends).alias("last"))
    one = halves.groupBy("node", "side").agg(F.count("*").alias("degree"), F.min(F.struct("other", "other_side")).alias("o")).where("degree = 1").select("node", "side", "o.other", "o.other_side")
    side = lambda c, end: F.when(F.col(f"{c}.reversed"), 1 - end).otherwise(F.lit(end))

    def beyond(c: str, end: int, index: Column) -> DataFrame:
        at = e.select("path", F.col(f"{c}.node").alias("node"), side(c, end).alias("side"), index.cast(dict(steps.dtypes)["step_index"]).alias("step_index"))
        # A step on the left is left by its right side, which is then the forward one, and the other way round.
        return at.join(one, ["node", "side"]).select("path", "step_index", F.col("other").alias("node"), (F.col("other_side") == end).alias("reversed"), F.lit(True).alias("added"))

    before, after = beyond("first", 0, F.col("first.step_index") - 1), beyond("last", 1, F.col("last.step_index") + 1)
    return steps.select("path", "step_index", "node", "reversed", F.lit(False).alias("added")).unionByName(before).unionByName(after)


def haplotype_steps(steps: DataFrame) -> DataFrame:
    """``steps`` with ``specific``: no other step of any path stands on the node."""
    return steps.withColumn("specific", F.count("*").over(Window.partitionBy("node")) == 1)


def sequences(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, sequence, marks) of specific steps' places: ``marks`` are arrays of (start, stop, before), ``before`` the end of the specific step before."""
    s = haplotype_steps(steps).join(segments.select(F.col("name").alias("node"), "sequence"), "node")
    s = s.withColumn("seq", F.when(F.col("reversed"), reverse_complement(F.col("sequence"))).otherwise(F.col("sequence")))
    w = Window.partitionBy("path").orderBy("step_index")
    s = s.withColumn("stop", F.sum(F.length("seq")).over(w)).withColumn("start", F.col("stop") - F.length("seq"))
    earlier = F.max(F.when(F.col("specific"), F.col("stop"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("before", F.coalesce(earlier, F.lit(0)))
    mark = F.when(F.col("specific"), F.struct("start", "stop", "before"))
    g = s.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("step_index", "seq", mark.alias("mark")))).alias("x"))
    marks = F.filter(F.transform("x", lambda v: v.mark), lambda m: m.isNotNull())
    return g.select("path", F.array_join(F.transform("x", lambda v: v.seq), "").alias("sequence"), marks.alias("marks"))


def haplotype_kmers(steps: DataFrame, segments: DataFrame, k: int) -> DataFrame:
    """(path, at, kmer): windows of k letters of a path's sequence that touch a node that no other step stands on.

    For each such node, the letters that such windows cover are cut out, less those windows that touch an
    earlier one, so that no window comes twice.
    """
    p = sequences(steps, segments)
    n = F.length("sequence")

    def piece(m: Column) -> Column:
        low = F.greatest(m.start - (k - 1), m.before, F.lit(0))
        high = F.least(m.stop - 1, n - k)
        return F.struct(low.cast("long").alias("low"), F.when(high >= low, F.substring(F.col("sequence").cast("binary"), (low + 1).cast("int"), (high - low + k).cast("int")).cast("string")).alias("sequence"))

    pieces = p.select("path", F.explode(F.transform("marks", piece)).alias("m")).select("path", "m.low", "m.sequence").where("sequence IS NOT NULL")
    kmers = packed_kmers(pieces, k, "path", "low", canonical=False)
    return kmers.select("path", (F.col("low") + F.col("at")).alias("at"), unpacked(F.col("code"), F.col("high"), k).alias("kmer"))


def kmer_positions(steps: DataFrame, segments: DataFrame, parental: DataFrame, k: int, min_length: int = 0) -> DataFrame:
    """(path, at, is_pat, is_mat): where parental k-mers stand on the paths."""
    return located(sequences(steps, segments).select("path", "sequence"), parental, k, min_length)


def phased_share(steps: DataFrame, phased: DataFrame) -> DataFrame:
    """(path, phased, total, share) in letters; ``steps(path, node, length)``, ``phased(node)``."""
    there = phased.select("node").distinct().withColumn("there", F.lit(True))
    g = steps.join(there, "node", "left").groupBy("path").agg(F.sum(F.when(F.col("there"), F.col("length")).otherwise(0)).alias("phased"), F.sum("length").alias("total"))
    return g.withColumn("share", F.coalesce(F.col("phased") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))


def purged(steps: DataFrame, phased: DataFrame, least: float = 0.1) -> DataFrame:
    """Steps of the paths that are phased to a share of ``least`` or more."""
    return steps.join(phased_share(steps, phased).where(F.col("share") >= least).select("path"), "path", "left_semi")


def node_colours(steps: DataFrame, nodes: DataFrame, colour: Column) -> DataFrame:
    """(node, n_paths, colour): grey off all paths, the path's own colour on one, the blend of two, white on more.

    ``colour`` makes a colour from the column ``path``; a blend keeps both, joined by a slash.
    """
    own = steps.select("node", "path").distinct().select("node", colour.alias("c")).groupBy("node").agg(F.count("*").alias("n_paths"), F.array_sort(F.collect_list("c")).alias("cs"))
    j = nodes.select("node").distinct().join(own, "node", "left").fillna(0, ["n_paths"])
    shown = F.when(F.col("n_paths") == 0, "#AAAAAA").when(F.col("n_paths") <= 2, F.array_join("cs", "/")).otherwise("#FFFFFF")
    return j.select("node", "n_paths", shown.alias("colour"))


def split_singletons(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of one step, and the others; ``counts(path, n_steps)``."""
    return counts.where("n_steps = 1"), counts.where("n_steps <> 1")


def sliding_sum(values: DataFrame, width: int, by: str, order: str, value: str) -> DataFrame:
    """Sums of ``width`` consecutive rows; windows that are not full are left out."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(0, width - 1)
    s = values.select(by, order, F.sum(value).over(w).alias("total"), F.count("*").over(w).alias("n"))
    return s.where(F.col("n") == width).select(by, order, F.col("total").cast("long").alias("total"))
