"""Bubble chains: runs of chainable nodes in order, the haplotype paths through them, and their orientation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.components import connected_components
from strandframe.operators.graph import chainable, second_neighbours
from strandframe.operators.groups import map_groups
from strandframe.sources.shared import stash


def chain_items(halves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, item): chainable nodes; the two alleles of a diploid pair, or of a pair of tips, share the smaller name."""
    kinds = chainable(halves, nodes)
    partner = second_neighbours(halves).groupBy("node").agg(F.min(F.element_at("others", 1)).alias("partner"))
    both = kinds.join(partner, "node", "left").withColumn("partner", F.when(F.col("kind") != "haploid", F.col("partner")))
    there = kinds.select(F.col("node").alias("partner"), F.lit(True).alias("there"))
    return both.join(there, "partner", "left").select("node", F.when(F.col("there"), F.least("node", "partner")).otherwise(F.col("node")).alias("item"))


def walk(rows: list[tuple]) -> list[tuple]:
    """Layers of one chain from links (node, side, other, other_side, item, other_item): (layer, node, reversed).

    The walk begins at the item of the smallest name among those with links on one side only, or at the
    smallest of all in a ring, and leaves it by its linked side; a layer is an item.
    """
    sides: dict[tuple, set[tuple]] = {}
    members: dict[object, set] = {}
    for node, side, other, other_side, item, other_item in rows:
        sides.setdefault((node, side), set()).add((other, other_side, other_item))
        members.setdefault(item, set()).add(node)
    linked = {item: {s for n in group for s in (0, 1) if (n, s) in sides} for item, group in members.items()}
    onward = {item: {o for n in group for s in (0, 1) for _, _, o in sides.get((n, s), ())} - {item} for item, group in members.items()}
    ends = [i for i in members if len(linked[i]) == 1 or len(onward[i]) < 2]
    first = min(ends or members)
    lead = min(members[first])
    out_side = 0 if linked[first] == {0} else 1
    facing = {n: out_side for n in members[first]}
    if (lead, out_side) not in sides:
        facing = {n: 1 if (n, 1) in sides else 0 for n in members[first]}
    out, seen, layer = [], {first}, 0
    while facing:
        out += [(layer, n, s == 0) for n, s in sorted(facing.items())]
        reached: dict[object, dict] = {}
        for n, s in sorted(facing.items()):
            for other, other_side, item in sorted(sides.get((n, s), ())):
                if item not in seen:
                    reached.setdefault(item, {}).setdefault(other, 1 - other_side)
        facing = reached[min(reached)] if reached else {}
        seen |= {min(reached)} if reached else set()
        layer += 1
    return out


def chains(halves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chain, layer, node, reversed): chainable nodes in order; a chain is named by its smallest node.

    Both alleles of a bubble share a layer. Lone chainable nodes are chains of one layer. One chain is
    walked in one task.
    """
    items, _ = stash(chain_items(halves, nodes), "chain-items")
    mine, theirs = items, items.select(F.col("node").alias("other"), F.col("item").alias("other_item"))
    links = halves.join(mine, "node").join(theirs, "other").where("item <> other_item").select("node", "side", "other", "other_side", "item", "other_item")
    joined = links.select(F.col("item").alias("a"), F.col("other_item").alias("b")).distinct()
    comp = connected_components(joined)
    kind = nodes.schema["node"].dataType.simpleString()

    rows = links.join(comp.withColumnRenamed("node", "item"), "item").select("component", "node", "side", "other", "other_side", "item", "other_item")
    walked = map_groups(rows, "component", lambda chain, links_: [(chain, *x) for x in walk(links_)], f"chain {kind}, layer long, node {kind}, reversed boolean")
    lone = items.join(comp.select(F.col("node").alias("item")), "item", "left_anti").select(F.col("item").alias("chain"), F.lit(0).cast("long").alias("layer"), "node", F.lit(False).alias("reversed"))
    return stash(walked.unionAll(lone), "chains")[0]


def chain_paths(layers: DataFrame, phases: DataFrame) -> DataFrame:
    """(path, phase, step, node, reversed): the two haplotypes of every chain.

    Nodes alone in their layer belong to both; of two alleles, the one of partition -1 belongs to phase 0
    and that of 1 to phase 1. Alleles without opposite partitions end the paths before them, and others
    begin after them. Chains of one layer have none, nor are there paths of one step.
    """
    size = Window.partitionBy("chain", "layer")
    whole = Window.partitionBy("chain")
    d = layers.join(phases.select("node", "partition"), "node", "left").fillna(0, ["partition"])
    d = d.withColumn("n", F.count("*").over(size)).withColumn("ok", (F.col("n") == 1) | ((F.min("partition").over(size) == -1) & (F.max("partition").over(size) == 1)))
    d = d.withColumn("depth", F.max("layer").over(whole)).where("depth > 0")
    d = d.withColumn("breaks", F.coalesce(F.sum((~F.col("ok")).cast("long")).over(Window.partitionBy("chain").orderBy("layer")), F.lit(0)))
    on = F.when(F.col("n") == 1, F.array(F.lit(0), F.lit(1))).when(F.col("partition") == -1, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    s = d.where("ok").select("chain", "breaks", "layer", "node", "reversed", F.explode(on).alias("phase"))
    path = Window.partitionBy("chain", "breaks", "phase")
    s = s.withColumn("step", (F.row_number().over(path.orderBy("layer")) - 1).cast("long")).withColumn("n", F.count("*").over(path))
    return s.where("n >= 2").select(F.concat_ws(".", F.col("chain").cast("string"), F.dense_rank().over(Window.partitionBy("chain").orderBy("breaks")).cast("string"), F.col("phase").cast("string")).alias("path"), "phase", "step", "node", "reversed")


def to_flip(layers: DataFrame) -> DataFrame:
    """(node): nodes to turn round so that all of a chain face the same way; the rarer orientation, reversed ones in a tie."""
    w = Window.partitionBy("chain")
    n = layers.withColumn("backward", F.sum(F.col("reversed").cast("long")).over(w)).withColumn("n", F.count("*").over(w))
    return n.where(F.col("reversed") == (2 * F.col("backward") <= F.col("n"))).select("node")


def select_overlaps(edges: list[tuple], lengths: dict, min_similarity: float, tolerance: float = 0.15, first_penalty: float = 0.10) -> list[tuple]:
    """Mutually best overlaps (a, b, weight), in the order of their acceptance.

    Heavy edges go first, ties by name. A node takes overlaps until they cover its length: an edge is
    accepted if it is the heaviest open one of both its nodes, overshoots neither by more than
    ``tolerance`` of the length or half of its weight, and covers enough of both. Accepted edges leave,
    and passes go on until one accepts none.
    """
    covered, left, taken = dict.fromkeys(lengths, 0), sorted(edges, key=lambda e: (-e[2], e[0], e[1])), []
    while True:
        beside: dict[object, list[tuple]] = {}
        for a, b, w in left:
            beside.setdefault(a, []).append((b, w))
            beside.setdefault(b, []).append((a, w))
        best = lambda n: next((o for o, _ in beside[n] if covered[o] < lengths[o]), None)
        fits = lambda n, w: covered[n] + w - lengths[n] < 0.5 * w and covered[n] + w < (1 + tolerance) * lengths[n] and w > lengths[n] * (min_similarity + (first_penalty if covered[n] == 0 else 0))
        fresh = []
        for a, b, w in left:
            if all(covered[n] < lengths[n] for n in (a, b)) and best(a) == b and best(b) == a and fits(a, w) and fits(b, w):
                covered[a] += w
                covered[b] += w
                fresh.append((a, b, w))
        if not fresh:
            return taken
        taken += fresh
        gone = set(fresh)
        left = [e for e in left if e not in gone]


def best_overlaps(overlaps: DataFrame, lengths: DataFrame, min_similarity: float = 0.2) -> DataFrame:
    """(a, b, weight) of ``overlaps`` kept by ``select_overlaps``, per connected component of them; ``lengths(node, length)``."""
    kind = overlaps.schema["a"].dataType.simpleString()
    size = lambda x: lengths.select(F.col("node").alias(x), F.col("length").alias(f"length_{x}"))
    comp = connected_components(overlaps.where("a <> b").select("a", "b")).select(F.col("node").alias("a"), "component")
    e = overlaps.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").cast("long").alias("weight"))
    rows = e.join(size("a"), "a").join(size("b"), "b").join(comp, "a")

    def run(_: object, group: list[tuple]) -> list[tuple]:
        sizes = {r[0]: r[3] for r in group} | {r[1]: r[4] for r in group}
        return select_overlaps([r[:3] for r in group], sizes, min_similarity)

    return map_groups(rows.select("component", "a", "b", "weight", "length_a", "length_b"), "component", run, f"a {kind}, b {kind}, weight long")


def non_overlapping_matches(blocks: DataFrame, *by: str) -> DataFrame:
    """(..., matches, stop): matches of alignments in reference order, less what they share with the last block counted.

    A block that begins before the end of the last one, and ends behind its start, adds its matches whole
    but does not become the last one; a shared stretch counts by the better of both identities.
    """
    start = F.struct(F.lit(0.0).alias("total"), F.lit(-1).cast("long").alias("stop"), F.lit(-1).cast("long").alias("start"), F.lit(0.0).alias("identity"))

    def step(acc, x):
        total = acc.total + x.n_matches
        shared = (acc.stop - x.ref_start) * F.greatest(acc.identity, x.identity)
        inside = (acc.stop > x.ref_start) & (acc.start < x.ref_stop)
        less = F.when(acc.stop > x.ref_start, total - shared).otherwise(total)
        new = F.struct(less.alias("total"), x.ref_stop.alias("stop"), x.ref_start.alias("start"), x.identity.alias("identity"))
        return F.when(inside, F.struct(total.alias("total"), acc.stop.alias("stop"), acc.start.alias("start"), acc.identity.alias("identity"))).otherwise(new)

    fields = [F.col("ref_start").cast("long").alias("ref_start"), F.col("ref_stop").cast("long").alias("ref_stop"), F.col("n_matches").cast("double").alias("n_matches"), F.col("identity").cast("double").alias("identity")]
    listed = blocks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("x"))
    folded = listed.select(*by, F.aggregate("x", start, step).alias("f"))
    return folded.select(*by, F.col("f.total").cast("long").alias("matches"), F.col("f.stop").alias("stop"))
