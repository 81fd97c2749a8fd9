"""Rows of the text and CSV outputs; each function gives what a writer then stores, in any place Spark writes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.naming import binomial_p, phase_colour
from strandframe.sources.shared import numbered


def gfa_lines(segments: DataFrame, links: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(value) lines, the header's partition first, then those of segments, links and paths; an empty overlap is 0M, and so are all of paths."""
    spark = segments.sparkSession
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    head = spark.range(1).select(F.lit(0).alias("o"), F.lit("").alias("k"), F.lit("H\tVN:Z:1.0").alias("value"))
    s = segments.select(F.lit(1), F.col("name"), F.concat_ws("\t", F.lit("S"), "name", "sequence"))
    overlap = F.when(F.coalesce("cigar", F.lit("")).isin("", "*"), "0M").otherwise(F.col("cigar"))
    ln = links.select(F.lit(2), F.concat_ws(" ", "node_a", "node_b"), F.concat_ws("\t", F.lit("L"), "node_a", sign("rev_a"), "node_b", sign("rev_b"), overlap))
    out = head.unionAll(s).unionAll(ln)
    if steps is not None:
        g = steps.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("step_index", F.concat("node", sign("reversed")).alias("s")))).alias("x"))
        overlaps = F.when(F.size("x") > 1, F.array_join(F.array_repeat(F.lit("0M"), F.size("x") - 1), ",")).otherwise("*")
        out = out.unionAll(g.select(F.lit(3), F.col("path"), F.concat_ws("\t", F.lit("P"), "path", F.array_join(F.transform("x", lambda v: v.s), ","), overlaps)))
    return out.select("value")


def component_gfa_lines(segments: DataFrame, links: DataFrame, steps: DataFrame | None, labels: DataFrame) -> DataFrame:
    """(component, value): the lines of each component's own GFA, to be written partitioned by component; ``labels(node, component)``."""
    of = lambda df, c: df.join(labels.select(F.col("node").alias(c), "component"), c)
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    head = labels.select("component").distinct().select("component", F.lit(0).alias("o"), F.lit("H\tVN:Z:1.0").alias("value"))
    s = of(segments, "name").select("component", F.lit(1), F.concat_ws("\t", F.lit("S"), "name", "sequence"))
    overlap = F.when(F.coalesce("cigar", F.lit("")).isin("", "*"), "0M").otherwise(F.col("cigar"))
    ln = of(links, "node_a").select("component", F.lit(2), F.concat_ws("\t", F.lit("L"), "node_a", sign("rev_a"), "node_b", sign("rev_b"), overlap))
    out = head.unionAll(s).unionAll(ln)
    if steps is not None:
        g = of(steps, "node").groupBy("component", "path").agg(F.sort_array(F.collect_list(F.struct("step_index", F.concat("node", sign("reversed")).alias("s")))).alias("x"))
        overlaps = F.when(F.size("x") > 1, F.array_join(F.array_repeat(F.lit("0M"), F.size("x") - 1), ",")).otherwise("*")
        out = out.unionAll(g.select("component", F.lit(3), F.concat_ws("\t", F.lit("P"), "path", F.array_join(F.transform("x", lambda v: v.s), ","), overlaps)))
    return out.sortWithinPartitions("component", "o").select("component", "value")


def phase_rows(nodes: DataFrame) -> DataFrame:
    """``nodes(name, partition, coverage, length)`` with the colour of the phase."""
    return nodes.select(F.col("name").alias("Name"), F.col("partition").alias("Phase"), F.col("coverage").alias("Coverage"), F.col("length").alias("Length"), phase_colour(F.col("partition")).alias("Color"))


def bubble_rows(bubbles: DataFrame) -> DataFrame:
    """Two rows of each (bubble_id, node_0, node_1)."""
    side = lambda p, c: F.struct(F.col(f"node_{p}").alias("Name"), F.col("bubble_id").alias("BubbleId"), F.lit(p).alias("Phase"), F.lit(c).alias("Color"))
    return bubbles.select(F.inline(F.array(side(0, "Cornflower Blue"), side(1, "Tomato"))))


def component_rows(components: DataFrame) -> DataFrame:
    """(component, side, nodes): names of each side, sorted and joined by blanks."""
    return components.groupBy("component", "side").agg(F.array_join(F.array_sort(F.collect_list("node")), " ").alias("nodes"))


def orientation_rows(votes: DataFrame) -> DataFrame:
    n, k = F.col("n_different") + F.col("n_same"), F.least("n_different", "n_same")
    return votes.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"), F.col("n_different").alias("weight_0"), F.col("n_same").alias("weight_1"), binomial_p(n, k).alias("p_null"))


def stratified_rows(by_mapq: DataFrame) -> DataFrame:
    """(name_a, name_b, dist): counts ``q:n`` by ascending quality."""
    x = F.sort_array(F.collect_list(F.struct("mapq", "weight")))
    return by_mapq.groupBy(F.col("a").alias("name_a"), F.col("b").alias("name_b")).agg(F.array_join(F.transform(x, lambda v: F.concat(v.mapq.cast("string"), F.lit(":"), v.weight.cast("string"))), " ").alias("dist"))


def fasta_by_phase(segments: DataFrame, phases: DataFrame) -> DataFrame:
    """(phase, value): FASTA records with phase_0 (-1), phase_1 (+1) or unphased; to be written partitioned by phase."""
    j = segments.join(phases.select("name", "partition"), "name", "left")
    where = F.when(F.col("partition") == -1, "phase_0").when(F.col("partition") == 1, "phase_1").otherwise("unphased")
    return j.select(where.alias("phase"), F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value"))


def write_csv(rows: DataFrame, path: str, header: bool = True) -> None:
    """Rows as CSV files with a header each; an existing folder is an error."""
    rows.write.mode("errorifexists").option("header", header).csv(path)


def contact_rows(contacts: DataFrame) -> DataFrame:
    """(name_a, name_b, weight), a pair once."""
    return contacts.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"), "weight")


def symmetric_contact_rows(contacts: DataFrame) -> DataFrame:
    """Both directions of every pair, for a file without a header."""
    return contact_rows(contacts).unionAll(contacts.where("a <> b").select("b", "a", "weight"))


def node_rows(nodes: DataFrame) -> DataFrame:
    """``nodes(id, name, coverage, length)`` as Id, Name, Coverage, Length."""
    return nodes.select(F.col("id").alias("Id"), F.col("name").alias("Name"), F.col("coverage").alias("Coverage"), F.col("length").alias("Length"))


def overlap_rows(hits: DataFrame) -> DataFrame:
    """(name, other_name, score, total_hashes, similarity) of the best hits."""
    return hits.select("name", "other_name", "score", "total_hashes", "similarity")


def alignment_rows(every: DataFrame, symmetrical: DataFrame, lengths: DataFrame) -> DataFrame:
    """(name_a, name_b, total_matches, symmetrical, color): both directions of all alignments (0) and of the chosen ones (1); the colour tells which end is longer."""
    size = lambda x: lengths.select(F.col("name").alias(x), F.col("length").alias(f"len_{x}"))
    both = every.select("a", "b", "weight", F.lit(0).alias("symmetrical")).unionAll(symmetrical.select("a", "b", "weight", F.lit(1)))
    both = both.unionAll(both.select("b", "a", "weight", "symmetrical")).join(size("a"), "a").join(size("b"), "b")
    colour = F.when(F.col("len_a") > F.col("len_b"), "Cornflower Blue").otherwise("Tomato")
    return both.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"), F.col("weight").alias("total_matches"), "symmetrical", colour.alias("color"))


def subgraph_rows(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, color, subgraph) and subgraphs (subgraph, color, nodes) of a bipartition ``labels(node, subgraph, flag)``."""
    colour = F.when(F.col("flag"), "Tomato").otherwise("Cornflower Blue")
    nodes = labels.select(F.col("node").alias("name"), colour.alias("color"), "subgraph")
    return nodes, nodes.groupBy("subgraph", "color").agg(F.count("*").alias("nodes"))


def chain_rows(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, color): which haplotypes' paths a node is on, and whether it ends one; ``paths(path, phase, step, node)``."""
    ends = paths.groupBy("path").agg(F.max("step").alias("last"))
    at = paths.join(ends, "path").groupBy("node").agg(*[F.max(F.col("phase") == p).alias(f"p{p}") for p in (0, 1)], F.max((F.col("step") == 0) | (F.col("step") == F.col("last"))).alias("cap"))
    return chain_colours(nodes.select("node").join(at, "node", "left"))


def chain_colours(places: DataFrame) -> DataFrame:
    """(node, color) of ``places(node, p0, p1, cap)``: the phases whose paths hold a node, and whether it ends one; null on no path."""
    both = F.col("p0") & F.col("p1")
    colour = F.when(F.col("p0").isNull(), "#AAAAAA").when(both & F.col("cap"), "Purple").when(both, "Plum").when(F.col("p0"), "Cornflower Blue").otherwise("Tomato")
    return places.select("node", colour.alias("color"))


def intersection_rows(sets: DataFrame) -> DataFrame:
    """(Name, Set, RefName, Color) of ``sets(name, truth, inferred, reference)``: the true and the inferred side."""
    code = F.concat(F.col("truth").cast("string"), F.col("inferred").cast("string"))
    colour = F.when(code == "00", "Cornflower Blue").when(code == "11", "Tomato").when(code == "01", "Plum").otherwise("Dark Orange")
    return sets.select(F.col("name").alias("Name"), code.alias("Set"), F.col("reference").alias("RefName"), colour.alias("Color"))


def config_rows(spark: SparkSession, options: dict) -> DataFrame:
    """(key, value): the options of a run, each with its own value."""
    return spark.createDataFrame([(k, str(v)) for k, v in options.items()] or [], "key string, value string")


def id_rows(names: DataFrame, first: int = 1) -> DataFrame:
    """(id, name): dense ids in the order of names."""
    return numbered(names.select("name").distinct(), "id", first, "name").select("id", "name")


def histogram_rows(values: DataFrame, column: str, width: int) -> DataFrame:
    """(bin_start, count); empty bins are left out."""
    return values.groupBy((F.floor(F.col(column) / width) * width).cast("long").alias("bin_start")).agg(F.count("*").alias("count"))


def svg(shapes: DataFrame, width: int, height: int) -> DataFrame:
    """(value): an SVG of ``shapes(kind, x, y, x2, y2, size, color)``, lines and points, in one file's lines."""
    head = shapes.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">').alias("value"))
    line = F.format_string('<line x1="%s" y1="%s" x2="%s" y2="%s" stroke-width="%s" stroke="%s"/>', "x", "y", "x2", "y2", "size", "color")
    point = F.format_string('<circle cx="%s" cy="%s" r="%s" fill="%s"/>', "x", "y", "size", "color")
    body = shapes.select(F.lit(1), F.when(F.col("kind") == "line", line).otherwise(point))
    tail = shapes.sparkSession.range(1).select(F.lit(2), F.lit("</svg>"))
    return head.unionAll(body).unionAll(tail).coalesce(1).sortWithinPartitions("o").select("value")
