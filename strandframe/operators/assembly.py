"""Paths to sequences: haplotype nodes spelled from their steps, and FASTA routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.functions.sequence import reverse_complement
from strandframe.operators.graph import component_labels, half_edges


def unzip_sequences(steps: DataFrame, segments: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(path, sequence, n_steps): step sequences in path orientation, each without what its overlap repeats.

    The overlap is that of the link between consecutive steps, read from either strand; it is capped at
    the step's own length.
    """
    oriented = F.when(F.col("reversed"), reverse_complement(F.col("sequence"))).otherwise(F.col("sequence"))
    s = steps.join(segments.select(F.col("name").alias("node"), "sequence"), "node").withColumn("seq", oriented)
    w = Window.partitionBy("path").orderBy("step_index")
    s = s.withColumn("before", F.lag("node").over(w)).withColumn("before_rev", F.lag("reversed").over(w))
    if links is not None:
        ops = links.withColumn("ops", cigar.parse(F.col("cigar")))
        there = ops.select(F.col("node_a").alias("before"), F.col("rev_a").alias("before_rev"), F.col("node_b").alias("node"), F.col("rev_b").alias("reversed"), "ops")
        back = ops.select(F.col("node_b").alias("before"), (~F.col("rev_b")).alias("before_rev"), F.col("node_a").alias("node"), (~F.col("rev_a")).alias("reversed"), cigar.flipped(F.col("ops")).alias("ops"))
        keys = ["before", "before_rev", "node", "reversed"]
        s = s.join(there.unionAll(back).dropDuplicates(keys), keys, "left")
        trim = F.least(F.coalesce(cigar.total(F.col("ops"), cigar.QUERY), F.lit(0)), F.length("seq"))
        s = s.withColumn("seq", F.substring("seq", F.lit(1) + trim.cast("int"), F.length("seq")))
    g = s.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("step_index", "seq"))).alias("x"), F.count("*").alias("n_steps"))
    return g.select("path", F.array_join(F.transform("x", lambda v: v.seq), "").alias("sequence"), "n_steps")


def recorded_overlaps(links: DataFrame) -> DataFrame:
    """(node_a, rev_a, node_b, rev_b, cigar) of links with an overlap, from either end: the way back has the turned CIGAR."""
    some = links.where(~F.coalesce("cigar", F.lit("")).isin("", "*", "0M"))
    back = cigar.render(cigar.flipped(cigar.parse(F.col("cigar"))))
    turned = some.select(F.col("node_b").alias("node_a"), (~F.col("rev_b")).alias("rev_a"), F.col("node_a").alias("node_b"), (~F.col("rev_a")).alias("rev_b"), back.alias("cigar"))
    return some.select("node_a", "rev_a", "node_b", "rev_b", "cigar").unionByName(turned).dropDuplicates(["node_a", "rev_a", "node_b", "rev_b"])


def unzip(segments: DataFrame, links: DataFrame, steps: DataFrame, delete_islands: bool = True, keep_paths: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with every path as one node of its name: (segments, links, steps).

    A path's node is linked to what its first step's left and its last step's right side were linked to; where
    those are ends of paths themselves, to these paths' nodes. Nodes on paths are gone, and so, with
    ``delete_islands``, are components without a path, if there are paths at all.
    """
    made = unzip_sequences(steps, segments, links).select(F.col("path").alias("name"), "sequence")
    on = steps.select("node").distinct()
    left = segments.select("name", "sequence").join(on.select(F.col("node").alias("name")), "name", "left_anti")
    whole = left.unionByName(made)
    order = F.struct("step_index", "node", "reversed")
    ends = steps.groupBy("path").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    outer = lambda c, end: ends.select(F.col(f"{c}.node").alias("node"), F.when(F.col(f"{c}.reversed"), 1 - end).otherwise(F.lit(end)).alias("side"), F.col("path").alias("now"), F.lit(end).alias("now_side"))
    stay = left.select(F.col("name").alias("node"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select("node", "side", F.col("node").alias("now"), F.col("side").alias("now_side"))
    become = outer("first", 0).unionByName(outer("last", 1)).unionByName(stay)
    sided = links.select("node_a", F.when(F.col("rev_a"), 0).otherwise(1).alias("side_a"), "node_b", F.when(F.col("rev_b"), 1).otherwise(0).alias("side_b"), "cigar")
    end = lambda x: become.select(F.col("node").alias(f"node_{x}"), F.col("side").alias(f"side_{x}"), F.col("now").alias(f"now_{x}"), F.col("now_side").alias(f"at_{x}"))
    j = sided.join(end("a"), ["node_a", "side_a"]).join(end("b"), ["node_b", "side_b"])
    out = j.select(F.col("now_a").alias("node_a"), (F.col("at_a") == 0).alias("rev_a"), F.col("now_b").alias("node_b"), (F.col("at_b") == 1).alias("rev_b"), "cigar").distinct()
    alone = steps.select("path").distinct().select("path", F.lit(0).alias("step_index"), F.col("path").alias("node"), F.lit(False).alias("reversed"))
    if delete_islands and alone.limit(1).count():
        labels = component_labels(half_edges(out), whole.select(F.col("name").alias("node")))
        good = labels.join(alone.select("node"), "node", "left_semi").select("component").distinct()
        keep = labels.join(good, "component", "left_semi").select("node")
        whole = whole.join(keep.select(F.col("node").alias("name")), "name", "left_semi")
        out = out.join(keep.select(F.col("node").alias("node_a")), "node_a", "left_semi")
    return whole, out, alone if keep_paths else alone.limit(0)
