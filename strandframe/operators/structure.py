"""Bridges, constrained walks and alternative merges: the parts that look at one component as a whole.

Each works on one component after another within a partition, and partitions run side by side; one
component must fit a task. A driver never sees the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.components import connected_components
from strandframe.operators.groups import map_groups

Handle = tuple[str, bool]


def find_bridges(edges: list[tuple]) -> set[int]:
    """Indices of the edges whose removal parts a (multi)graph, by lowest reachable discovery time."""
    around: dict = {}
    for i, (a, b) in enumerate(edges):
        around.setdefault(a, []).append((b, i))
        around.setdefault(b, []).append((a, i))
    seen: dict = {}
    low: dict = {}
    out: set[int] = set()
    for root in around:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        walk = [(root, -1, iter(around[root]))]
        while walk:
            v, came, rest = walk[-1]
            for w, i in rest:
                if i == came:
                    continue
                if w in seen:
                    low[v] = min(low[v], seen[w])
                else:
                    seen[w] = low[w] = len(seen)
                    walk.append((w, i, iter(around[w])))
                    break
            else:
                walk.pop()
                if walk:
                    up = walk[-1][0]
                    low[up] = min(low[up], low[v])
                    if low[v] > seen[up]:
                        out.add(came)
    return out


def bridge_nodes(halves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node) whose two sides are joined by nothing but the node itself."""
    comp = connected_components(halves.select(F.col("node").alias("a"), F.col("other").alias("b")))
    kind = nodes.schema["node"].dataType.simpleString()
    once = halves.where(F.struct("node", "side") <= F.struct(F.col("other").alias("node"), F.col("other_side").alias("side")))
    rows = once.join(comp, "node").select("component", "node", "side", "other", "other_side")
    lone = nodes.join(comp, "node", "left_anti").select("node")

    def run(_: object, links: list[tuple]) -> list[tuple]:
        names = list(dict.fromkeys([*(r[0] for r in links), *(r[2] for r in links)]))
        cut = find_bridges([((n, 0), (n, 1)) for n in names] + [((a, s), (b, t)) for a, s, b, t in links])
        return [(n,) for i, n in enumerate(names) if i in cut]

    return map_groups(rows, "component", run, f"node {kind}").unionAll(lone)


def bridge_components(halves: DataFrame, nodes: DataFrame, bridges: DataFrame) -> DataFrame:
    """(component, node): what hangs together once bridge nodes are cut through, over node sides."""
    side = lambda c, s: F.struct(F.col(c).alias("n"), F.col(s).alias("s") if isinstance(s, str) else F.lit(s).alias("s"))
    through = nodes.join(bridges, "node", "left_anti").select(side("node", 0).alias("a"), side("node", 1).alias("b"))
    comp = connected_components(halves.select(side("node", "side").alias("a"), side("other", "other_side").alias("b")).unionAll(through))
    every = nodes.select(F.explode(F.array(side("node", 0), side("node", 1))).alias("node"))
    placed = every.join(comp, "node", "left").select(F.coalesce("component", "node").alias("component"), F.col("node.n").alias("node"))
    return placed.distinct()


def flip(h: Handle) -> Handle:
    return h[0], not h[1]


def hamiltonian_path(links: list[tuple[str, bool, str, bool]], targets: set[str], starts: list[Handle] = (), ends: list[Handle] = (), prohibited: set[str] = frozenset(), most_steps: int = 5000) -> tuple[bool, list[Handle], int]:
    """(solved, path, unique prefix) of the shortest walk through all targets, each node once.

    States are (set of handles, last handle), a row for each length. The prefix counts leading places
    where all complete walks, of any length, agree. More than 64 handles, or more than ``most_steps``
    looked-at links, is unsolved.
    """
    if not targets and not starts and not ends:
        return True, [], 0
    out: dict[Handle, set[Handle]] = {}
    for a, ra, b, rb in links:
        if a not in prohibited and b not in prohibited:
            out.setdefault((a, ra), set()).add((b, rb))
            out.setdefault((b, not rb), set()).add((a, not ra))
    named = {h[0] for h in out} | {h[0] for v in out.values() for h in v} | ({h[0] for h in (*starts, *ends)} | set(targets)) - set(prohibited)
    bit = {h: 1 << i for i, h in enumerate(sorted((n, r) for n in named for r in (False, True)))}
    if len(bit) > 64:
        return False, [], 0
    need = [bit[(t, False)] | bit[(t, True)] for t in targets if (t, False) in bit]
    if len(need) < len(targets):
        return True, [], 0
    forced = min(targets) if not starts and not ends else None
    first = list(starts) or [(t, r) for t in sorted(targets) for r in (False, True) if t != forced or not r]
    rows: list[dict[tuple[int, Handle], set]] = [{(bit[h], h): set() for h in first if h in bit}]
    looked = 0
    while len(rows) < len(bit) // 2 and looked < most_steps:
        new: dict[tuple[int, Handle], set] = {}
        for held, last in sorted(rows[-1]):
            for h in sorted(out.get(last, ())):
                looked += 1
                if held & (bit[h] | bit[flip(h)]) or (forced == h[0] and h[1]):
                    continue
                new.setdefault((held | bit[h], h), set()).add((held, last))
        if not new:
            break
        rows.append(new)
    if looked >= most_steps:
        return False, [], 0
    edge_nodes = set(targets) | {h[0] for h in (*starts, *ends)}
    clouds: list[set[Handle]] = [set() for _ in rows]
    wanted: list[set] = [set() for _ in rows]
    shortest = None
    for i in range(len(rows) - 1, -1, -1):
        good = sorted(s for s in rows[i] if all(s[0] & n for n in need) and (not ends or s[1] in ends) and s[1][0] in edge_nodes)
        if good:
            shortest = (i, good[0])
        wanted[i] |= set(good)
        for s in wanted[i]:
            clouds[i].add(s[1])
            if i:
                wanted[i - 1] |= rows[i][s]
    if shortest is None:
        return True, [], 0
    i, s = shortest
    path = [s[1]]
    while i:
        s = min(rows[i][s])
        path.append(s[1])
        i -= 1
    path.reverse()
    prefix = 0
    while prefix < len(path) and len(clouds[prefix]) == 1:
        prefix += 1
    return True, path, prefix


def merge_alts(edges: list[tuple]) -> tuple[dict, list[tuple]]:
    """Sides (component, 0 or 1) of nodes joined as alternatives in the given order, and the edges that cannot be.

    Union-find with parity: an edge puts its ends on opposite sides; one that would put a node on both is refused.
    """
    up: dict = {}

    def find(x):
        parity, at = 0, x
        while up.setdefault(at, (at, 0))[0] != at:
            at, p = up[at]
            parity ^= p
        return at, parity

    refused = []
    for a, b in edges:
        (x, p), (y, q) = find(a), find(b)
        if a == b or (x == y and p == q):
            refused.append((a, b))
        elif x != y:
            low, high = min(x, y), max(x, y)
            up[high] = (low, p ^ q ^ 1)
    return {n: find(n) for n in up}, refused


def merged_alts(alts: DataFrame) -> DataFrame:
    """(a, b, component, node, side) of ``alts(a, b, weight)``, heaviest first (names settle ties), a component a task.

    Rows with a ``node`` give its side; rows with ``a`` and ``b`` are edges that were refused, because they would
    have put a node on both sides.
    """
    comp = connected_components(alts.select("a", "b"))
    kind = alts.schema["a"].dataType.simpleString()

    def run(_: object, edges: list[tuple]) -> list[tuple]:
        sides, refused = merge_alts([(a, b) for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1]))])
        return [(None, None, c, n, s) for n, (c, s) in sides.items()] + [(a, b, sides[a][0], None, None) for a, b in refused]

    rows = alts.join(comp.select(F.col("node").alias("a"), F.col("component").alias("part")), "a").select("part", "a", "b", "weight")
    return map_groups(rows, "part", run, f"a {kind}, b {kind}, component {kind}, node {kind}, side int")


def alt_components(alts: DataFrame) -> DataFrame:
    """(node, component, side) of ``alts(a, b, weight)``; ``refused_alts`` lists the edges that this leaves out."""
    return merged_alts(alts).where("node IS NOT NULL").select("node", "component", "side")


def refused_alts(alts: DataFrame) -> DataFrame:
    """(a, b, component): alternatives that contradict heavier ones."""
    return merged_alts(alts).where("node IS NULL").select("a", "b", "component")


def consolidated(halves: DataFrame, bridges: DataFrame) -> DataFrame:
    """(run, place, node, reversed): bridge nodes in maximal runs that nothing else joins; a run is named by its smallest node.

    Links between bridges that are each other's only neighbour make the runs' components; one run is one group.
    """
    from strandframe.operators.chainer import outgoing, unipaths

    b = bridges.select("node").distinct()
    one = halves.groupBy("node", "side").agg(F.count("*").alias("n"), F.min(F.struct("other", "other_side")).alias("o")).where("n = 1").select("node", "side", "o.other", "o.other_side")
    back = one.select(F.col("node").alias("other"), F.col("side").alias("other_side"), F.col("other").alias("node"), F.col("other_side").alias("side"))
    joined = one.join(back, ["node", "side", "other", "other_side"]).join(b, "node").join(b.select(F.col("node").alias("other")), "other").where("node <> other").select("node", "side", "other", "other_side")
    comp = connected_components(joined.select(F.col("node").alias("a"), F.col("other").alias("b")))
    kind = bridges.schema["node"].dataType.simpleString()

    def run(_: object, rows: list[tuple]) -> list[tuple]:
        out = []
        for walk in unipaths({r[0] for r in rows}, outgoing(rows)):
            if walk[0][0] > walk[-1][0]:
                walk = [flip(h) for h in reversed(walk)]
            name = min(h[0] for h in walk)
            out += [(name, i, h[0], h[1]) for i, h in enumerate(walk)]
        return out

    several = map_groups(joined.join(comp, "node").select("component", "node", "side", "other", "other_side"), "component", run, f"run {kind}, place long, node {kind}, reversed boolean")
    alone = b.join(comp.select("node"), "node", "left_anti").select(F.col("node").alias("run"), F.lit(0).cast("long").alias("place"), "node", F.lit(False).alias("reversed"))
    return several.unionAll(alone)
