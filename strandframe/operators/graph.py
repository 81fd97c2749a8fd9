"""Relational operators on graphs whose links join node sides, and on ordered paths.

``links(node_a, rev_a, node_b, rev_b)``: the right side of a forward node meets the left side of the
next. ``half_edges`` lists both directions once, so every traversal is an equi-join on (node, side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.components import connected_components
from strandframe.sources.shared import discard, stash


def half_edges(links: DataFrame) -> DataFrame:
    """(node, side, other, other_side), side 0 left and 1 right, distinct."""
    out_a, in_b = F.when(F.col("rev_a"), 0).otherwise(1), F.when(F.col("rev_b"), 1).otherwise(0)
    one = links.select(F.col("node_a").alias("node"), out_a.alias("side"), F.col("node_b").alias("other"), in_b.alias("other_side"))
    return one.unionAll(one.select(F.col("other").alias("node"), F.col("other_side").alias("side"), F.col("node").alias("other"), F.col("side").alias("other_side"))).distinct()


def degree_distribution(halves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(degree, n): node sides of each degree, those without links included."""
    sides = nodes.select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    d = halves.groupBy("node", "side").agg(F.count("*").alias("degree"))
    return sides.join(d, ["node", "side"], "left").fillna(0, ["degree"]).groupBy("degree").agg(F.count("*").alias("n"))


def unique_neighbours(halves: DataFrame) -> DataFrame:
    """Sides with one neighbour only, and that neighbour."""
    return halves.groupBy("node", "side").agg(F.count("*").alias("degree"), F.min("other").alias("other")).where("degree = 1").drop("degree")


def second_neighbours(halves: DataFrame) -> DataFrame:
    """(node, side, others): nodes reached by going out of a side and coming back the same way, sorted."""
    h = halves
    back = h.select(F.col("node").alias("mid"), F.col("side").alias("mid_side"), F.col("other").alias("far"), F.col("other_side").alias("far_side"))
    two = h.join(back, (h.other == back.mid) & (h.other_side == back.mid_side)).where(F.col("far") != F.col("node"))
    return two.groupBy("node", "side").agg(F.array_sort(F.collect_set("far")).alias("others"))


def symmetric_bubbles(halves: DataFrame) -> DataFrame:
    """(node_0, node_1): nodes that are each other's only second neighbour on both sides."""
    s = second_neighbours(halves)
    left, right = s.where("side = 0").select("node", F.col("others").alias("l")), s.where("side = 1").select("node", F.col("others").alias("r"))
    one = left.join(right, "node").where((F.col("l") == F.col("r")) & (F.size("l") == 1)).select("node", F.element_at("l", 1).alias("alt"))
    return one.where("node < alt").select(F.col("node").alias("node_0"), F.col("alt").alias("node_1"))


def chainable(halves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, kind): haploid, diploid or tip, by first and second neighbours; others are not listed."""
    loops = halves.where("node = other").select("node").distinct().withColumn("loop", F.lit(True))
    first = halves.where("node <> other").groupBy("node", "side").agg(F.countDistinct("other").alias("n1"))
    second = second_neighbours(halves)
    side = lambda df, col, s, name: df.where(f"side = {s}").select("node", F.col(col).alias(name))
    d = nodes.select("node").join(loops, "node", "left")
    for s, x in ((0, "l"), (1, "r")):
        d = d.join(side(first, "n1", s, f"n1{x}"), "node", "left").join(side(second, "others", s, f"n2{x}"), "node", "left")
    size = lambda x: F.coalesce(F.size(f"n2{x}"), F.lit(0))
    n1 = lambda x: F.coalesce(F.col(f"n1{x}"), F.lit(0))
    s2 = {x: F.when(F.col(f"n2{x}").isNull(), 0).otherwise(size(x)) for x in "lr"}
    tip = lambda x, y: (n1(x) == 0) & (s2[y] == 1) & (n1(y) < 3)
    kind = F.when((s2["l"] == 0) & (s2["r"] == 0), "haploid").when((F.col("n2l") == F.col("n2r")) & (s2["l"] == 1) & (n1("l") < 3) & (n1("r") < 3), "diploid").when(tip("l", "r") | tip("r", "l"), "tip")
    return d.where("loop IS NULL").select("node", kind.alias("kind")).where("kind IS NOT NULL")


def splice_empty(links: DataFrame, empty: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Take nodes without sequence out: each of their neighbours on one side meets each on the other.

    A state is an empty node and the side it is left by. Each round doubles how many empty nodes in a row are
    passed, so a run of n takes log2(n) rounds; rings of empty nodes end when nothing new is reached.
    """
    spark = links.sparkSession
    whole, whole_path = stash(half_edges(links), "splice-links")
    gone = empty.select("node").distinct()
    there = gone.select(F.col("node").alias("other"))
    state = lambda n, s: F.struct(F.col(n).alias("node"), s.cast("int").alias("side"))
    leaves = whole.join(gone, "node").select(state("node", F.col("side")).alias("at"), "other", "other_side")
    jump, jump_path = stash(leaves.join(there, "other").select("at", state("other", 1 - F.col("other_side")).alias("to")).distinct(), "splice-jump")
    first = whole.join(gone, "node", "left_anti").join(there, "other").select("node", "side", state("other", 1 - F.col("other_side")).alias("at"))
    reached, path = stash(first.distinct(), "splice")
    before = reached.count()
    for _ in range(most_rounds):
        wider, new_path = stash(reached.unionAll(reached.join(jump, "at").select("node", "side", F.col("to").alias("at"))).distinct(), "splice")
        discard(spark, path)
        reached, path, now = wider, new_path, wider.count()
        if now == before:
            break
        before = now
        onward = jump.select(F.col("at").alias("to"), F.col("to").alias("far"))
        twice, twice_path = stash(jump.join(onward, "to").select("at", F.col("far").alias("to")).distinct(), "splice-jump")
        discard(spark, jump_path)
        jump, jump_path = twice, twice_path
    else:
        raise RuntimeError(f"runs of empty nodes are longer than 2 ** {most_rounds}")
    ends = leaves.join(there, "other", "left_anti")
    plain = whole.join(gone, "node", "left_anti").join(there, "other", "left_anti").select("node", "side", "other", "other_side")
    out, _ = stash(plain.unionAll(reached.join(ends, "at").select("node", "side", "other", "other_side")).distinct(), "spliced")
    discard(spark, whole_path, path, jump_path)
    return out


def bfs(edges: DataFrame, start: DataFrame, most_depth: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(node, depth) from ``start(node)`` over undirected ``edges(a, b)``, within ``allowed`` nodes; a frontier a round, until none is left or at ``most_depth``."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    if allowed is not None:
        both = both.join(allowed.select(F.col("node").alias("b")), "b").select("a", "b")
        start = start.join(allowed, "node")
    spark = edges.sparkSession
    both, edge_path = stash(both, "bfs-edges")
    seen, path = stash(start.select("node", F.lit(0).alias("depth")).distinct(), "bfs")
    frontier, frontier_path, depth = seen, None, 0
    while most_depth is None or depth < most_depth:
        depth += 1
        step = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        new, new_path = stash(step, "bfs")
        if frontier_path:
            discard(spark, frontier_path)
        frontier, frontier_path = new, new_path
        if not frontier.limit(1).count():
            break
        wider, wider_path = stash(seen.unionAll(frontier), "bfs")
        discard(spark, path)
        seen, path = wider, wider_path
    discard(spark, edge_path, *filter(None, [frontier_path]))
    return seen


def two_colouring(edges: DataFrame) -> DataFrame:
    """(node, component, side, bipartite): sides by parity, the smallest node of a component on side 0.

    Parity is connectivity of the doubled graph: (x, 0) meets (y, 1) and (x, 1) meets (y, 0). A component
    is bipartite exactly when a node's two copies stay apart.
    """
    label = lambda c, side: F.struct(F.col(c).alias("n"), F.lit(side).alias("s"))
    e = edges.where("a <> b").select(label("a", 0).alias("a"), label("b", 1).alias("b")).unionAll(edges.where("a <> b").select(label("a", 1).alias("a"), label("b", 0).alias("b")))
    c = connected_components(e)
    copies = c.select(F.col("node.n").alias("node"), F.col("node.s").alias("copy"), "component")
    zero, one = copies.where("copy = 0").select("node", F.col("component").alias("c0")), copies.where("copy = 1").select("node", F.col("component").alias("c1"))
    j = zero.join(one, "node")
    return j.select("node", F.least("c0.n", "c1.n").alias("component"), F.when(F.least("c0", "c1") == F.col("c0"), F.col("c0.s")).otherwise(1 - F.col("c1.s")).alias("side"), (F.col("c0") != F.col("c1")).alias("bipartite"))


def bipartition(edges: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subgraphs of equal flag (node, subgraph, flag), and the distinct edges between subgraphs; ``flags(node, flag)``."""
    f = lambda x: flags.select(F.col("node").alias(x), F.col("flag").alias(f"f{x}"))
    e = edges.join(f("a"), "a").join(f("b"), "b")
    comp = connected_components(e.where("fa = fb").select("a", "b"))
    labels = flags.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("subgraph"), "flag")
    s = lambda x: labels.select(F.col("node").alias(x), F.col("subgraph").alias(f"s{x}"))
    cross = e.where("fa <> fb").join(s("a"), "a").join(s("b"), "b").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct()
    return labels, cross


def path_positions(steps: DataFrame, *order: str) -> DataFrame:
    """Steps with the summed length before them; ``steps(path, length, ...)``."""
    w = Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("start", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))


def nx_curve(lengths: DataFrame, *by: str) -> DataFrame:
    """Lengths, longest first, with the share of the total before and behind each."""
    w = Window.partitionBy(*by).orderBy(F.desc("length"), "name")
    cum = F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("length").over(Window.partitionBy(*by))
    return lengths.select(*by, "name", "length", (cum - F.col("length")).alias("x0"), cum.alias("x1"), total.alias("total"))


def n50(lengths: DataFrame, *by: str) -> DataFrame:
    return nx_curve(lengths, *by).where("2 * x0 < total AND total <= 2 * x1").select(*by, F.col("length").alias("n50"))


def tips(halves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, has_left, has_right): nodes without a link on one side or both."""
    d = halves.groupBy("node").agg(F.max(F.col("side") == 0).alias("l"), F.max(F.col("side") == 1).alias("r"))
    j = nodes.select("node").join(d, "node", "left").select("node", F.coalesce("l", F.lit(False)).alias("has_left"), F.coalesce("r", F.lit(False)).alias("has_right"))
    return j.where("NOT (has_left AND has_right)")


def edge_bfs(edges: DataFrame, start: DataFrame, refused: DataFrame) -> DataFrame:
    """(a, b, passed): each edge met from ``start(node)`` once; those into ``refused(node)`` fail and lead no further."""
    no = refused.select("node").distinct()
    open_ = edges.join(no.select(F.col("node").alias("a")), "a", "left_anti").join(no.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
    seen = bfs(open_, start.join(no, "node", "left_anti")).select("node")
    end = lambda x: seen.select(F.col("node").alias(x), F.lit(True).alias(f"seen_{x}"))
    bad = lambda x: no.select(F.col("node").alias(x), F.lit(True).alias(f"bad_{x}"))
    once = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    j = once.join(end("a"), "a", "left").join(end("b"), "b", "left").join(bad("a"), "a", "left").join(bad("b"), "b", "left")
    return j.where("seen_a OR seen_b").select("a", "b", (F.col("bad_a").isNull() & F.col("bad_b").isNull()).alias("passed"))


def component_labels(halves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) of all nodes, alone or not."""
    c = connected_components(halves.select(F.col("node").alias("a"), F.col("other").alias("b")))
    return nodes.select("node").join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def split_links(links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links inside a labelled part, with its label, and those between two parts, with both; ``labels(node, component)``."""
    end = lambda x: labels.select(F.col("node").alias(f"node_{x}"), F.col("component").alias(f"part_{x}"))
    j = links.join(end("a"), "node_a").join(end("b"), "node_b")
    return j.where("part_a = part_b").withColumnRenamed("part_a", "component").drop("part_b"), j.where("part_a <> part_b")


def boundary_nodes(halves: DataFrame, labels: DataFrame) -> DataFrame:
    """(subgraph, node, side, other, beyond): sides of a subgraph's nodes that meet another subgraph; ``labels(node, subgraph)``."""
    other = labels.select(F.col("node").alias("other"), F.col("subgraph").alias("beyond"))
    return halves.join(labels.select("node", "subgraph"), "node").join(other, "other").where("subgraph <> beyond").select("subgraph", "node", "side", "other", "beyond")


def merged_subgraphs(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``labels(node, subgraph, flag)`` with the subgraphs of ``pairs(a, b)`` as one; two of different flag are an error."""
    c = connected_components(pairs.select("a", "b"))
    j = labels.join(c.select(F.col("node").alias("subgraph"), "component"), "subgraph", "left").withColumn("merged", F.coalesce("component", "subgraph"))
    mixed = j.groupBy("merged").agg(F.countDistinct("flag").alias("flags")).where("flags > 1").select("merged", F.lit(True).alias("mixed"))
    checked = F.when(F.col("mixed"), F.raise_error(F.lit("subgraphs of different ploidy cannot be merged")).cast(dict(j.dtypes)["merged"])).otherwise(F.col("merged"))
    return j.join(mixed, "merged", "left").select("node", checked.alias("subgraph"), "flag")


def merge_diploid_singletons(labels: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Lone diploid subgraphs join their partner's; ``labels(node, subgraph, flag)``, flag true for haploid nodes, ``bubbles(node_0, node_1)``."""
    size = labels.groupBy("subgraph").agg(F.count("*").alias("n"))
    lone = labels.join(size.where("n = 1"), "subgraph").where("NOT flag").select("node", "subgraph")
    both = bubbles.select(F.col("node_0").alias("node"), F.col("node_1").alias("mate")).unionAll(bubbles.select("node_1", "node_0"))
    mate = labels.where("NOT flag").select(F.col("node").alias("mate"), F.col("subgraph").alias("theirs"))
    return merged_subgraphs(labels, lone.join(both, "node").join(mate, "mate").select(F.col("subgraph").alias("a"), F.col("theirs").alias("b")))


def diploid_flags(nodes: DataFrame, bubbles: DataFrame) -> DataFrame:
    """(node, flag): flag is false for nodes of a bubble, true for the others."""
    of = bubbles.select(F.explode(F.array("node_0", "node_1")).alias("node")).distinct().withColumn("bubble", F.lit(True))
    return nodes.select("node").join(of, "node", "left").select("node", F.col("bubble").isNull().alias("flag"))


def chain_criteria(halves: DataFrame, labels: DataFrame) -> DataFrame:
    """(node): nodes that may stand in a chain.

    Diploid subgraphs (flag false) of one node, or whose nodes have two neighbours a side at most; and haploid nodes
    alone in their subgraph with a chainable neighbour, one node that is reached by going out of a side and back (or
    none), and fewer than three neighbours a side.
    """
    first = halves.where("node <> other").groupBy("node", "side").agg(F.countDistinct("other").alias("n"))
    most = first.groupBy("node").agg(F.max("n").alias("most"))
    size = labels.groupBy("subgraph").agg(F.count("*").alias("members"))
    j = labels.join(size, "subgraph").join(most, "node", "left").fillna(0, ["most"])
    wide = j.groupBy("subgraph").agg(F.max("most").alias("widest"))
    diploid = j.join(wide, "subgraph").where("NOT flag AND (members = 1 OR widest <= 2)").select("node")
    beside = halves.join(diploid.select(F.col("node").alias("other")), "other").select("node").distinct()
    second = second_neighbours(halves).select("node", F.size("others").alias("n2")).groupBy("node").agg(F.max("n2").alias("n2"))
    haploid = j.where("flag AND members = 1 AND most < 3").join(beside, "node", "left_semi").join(second, "node", "left").where("coalesce(n2, 0) <= 1").select("node")
    return diploid.unionAll(haploid)


def translated(edges: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """``edges(a, b, ...)`` of one graph's ids in another's, by names; ends without a counterpart are null. ``source`` and ``target`` are (id, name)."""
    for end in ("a", "b"):
        ids = source.join(target.withColumnRenamed("id", "there"), "name", "left").select(F.col("id").alias("here"), "there")
        edges = edges.join(ids, F.col(end) == F.col("here"), "left").withColumn(end, F.col("there")).drop("here", "there")
    return edges


def by_name(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` with the names of the ids in ``column``; an id that is not listed is an error."""
    named = ids.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    found = F.when(F.col("_name").isNull(), F.raise_error(F.concat(F.lit("no name for id "), F.col(column).cast("string"))).cast("string")).otherwise(F.col("_name"))
    return rows.join(named, F.col(column) == F.col("_id"), "left").withColumn(column, found).drop("_id", "_name")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes(node)``."""
    end = lambda x: nodes.select(F.col("node").alias(x))
    return edges.join(end("a"), "a", "left_semi").join(end("b"), "b", "left_semi")
