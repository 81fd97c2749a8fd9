"""Changes to a contact graph, ``edges(a, b, weight)`` with a < b or a = b, ``nodes(node, ...)``, ``alts(node, component, side)``; each gives new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")


def inserted(edges: DataFrame, more: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with those of ``more`` that are not there yet; an end that is no node is an error."""
    new = canonical(more).groupBy("a", "b").agg(F.first("weight").alias("weight"))
    for end in ("a", "b"):
        there = nodes.select(F.col("node").alias(end), F.lit(True).alias("there"))
        known = F.when(F.col("there").isNull(), F.raise_error(F.concat(F.lit("an edge names no node: "), F.col(end).cast("string"))).cast(dict(new.dtypes)[end])).otherwise(F.col(end))
        new = new.join(there, end, "left").withColumn(end, known).drop("there")
    old = canonical(edges)
    return old.unionByName(new.join(old, ["a", "b"], "left_anti"))


def incremented(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Weights of both added up."""
    return canonical(edges).unionByName(canonical(more)).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def removed(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return canonical(edges).join(gone.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def weights(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with their weight, 0 where there is no edge."""
    asked = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return asked.join(canonical(edges), ["a", "b"], "left").fillna(0, ["weight"])


def without_nodes(edges: DataFrame, nodes: DataFrame, alts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the nodes of ``gone(node)``."""
    for end in ("a", "b"):
        edges = edges.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return edges.select("a", "b", "weight"), nodes.join(gone.select("node"), "node", "left_anti"), alts.join(gone.select("node"), "node", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): neighbours of each node, itself left out."""
    half = edges.where("a <> b").select(F.col("a").alias("node")).unionAll(edges.where("a <> b").select("b"))
    return half.groupBy("node").agg(F.count("*").alias("degree"))


def with_alternatives(edges: DataFrame, alts: DataFrame) -> DataFrame:
    """Edges with both ends in components of alternatives, other than one and the same, and not of a node with itself."""
    side = lambda x: alts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    return edges.where("a <> b").join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select("a", "b", "weight")


def partitions(alts: DataFrame, sides: DataFrame) -> DataFrame:
    """(node, partition): a component's partition on side 0 and its opposite on side 1; 0 is none for a component of alternatives."""
    p = sides.select("component", F.when(F.col("partition").isin(-1, 1), F.col("partition")).otherwise(F.raise_error(F.lit("a node with alternatives is of partition -1 or 1")).cast("int")).alias("partition"))
    return alts.join(p, "component").select("node", F.when(F.col("side") == 0, F.col("partition")).otherwise(-F.col("partition")).alias("partition"))


def contradictions(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Alternatives (a, b) that are not of opposite partitions."""
    p = lambda x: parts.select(F.col("node").alias(x), F.col("partition").alias(f"p{x}"))
    return pairs.join(p("a"), "a").join(p("b"), "b").where("pa <> -pb OR pa = 0").select("a", "b")


def alternatives_of(alts: DataFrame, node: Column) -> DataFrame:
    """(node, alt): for the nodes chosen, the nodes on the other side of their component."""
    mine = alts.where(node)
    other = alts.select(F.col("node").alias("alt"), "component", F.col("side").alias("far"))
    return mine.join(other, "component").where("side <> far").select("node", "alt")


def same_side(alts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``same_component`` and ``same_side``; false for nodes without alternatives."""
    side = lambda x: alts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("side").alias(f"s{x}"))
    j = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    together = F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))
    return j.select("a", "b", together.alias("same_component"), (together & F.coalesce(F.col("sa") == F.col("sb"), F.lit(False))).alias("same_side"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(row, column, weight): the symmetric matrix, entries that are not zero."""
    e = canonical(edges)
    return e.select(F.col("a").alias("row"), F.col("b").alias("column"), "weight").unionAll(e.where("a <> b").select("b", "a", "weight"))
