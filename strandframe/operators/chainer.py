"""Haplotype paths through a phased graph: alleles across bridge components, stitched into chains at the bridges.

A handle is (node, reversed). A *unit* is a stretch of the graph that both haplotypes cross: a bridge component
with at most two bridges, or a simple bubble. It is bounded by inward handles, one where it is entered from the
left and one from the right, and has for either haplotype a walk from the left and, where the walk is not unique
throughout, another that ends at the right. A *stretch* is a run of handles without alternatives between units.
Chains are laid out as whole rows of units first, and both haplotypes are then written along the row.

Work on one connected component happens in one task, as the alleles of a component may lie anywhere in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.components import connected_components
from strandframe.operators.groups import map_groups
from strandframe.operators.structure import Handle, find_bridges, flip, hamiltonian_path

Links = dict[Handle, list[Handle]]


@dataclass
class Unit:
    left: Handle | None
    right: Handle | None
    from_left: list[list[Handle]]
    from_right: list[list[Handle]]
    crossed: list[bool]

    def turned(self) -> Unit:
        back = lambda walk: [flip(h) for h in reversed(walk)]
        ahead = [back(b) if b else back(a) for a, b in zip(self.from_left, self.from_right, strict=True)]
        behind = [back(a) if b else [] for a, b in zip(self.from_left, self.from_right, strict=True)]
        return Unit(self.right, self.left, ahead, behind, self.crossed)


@dataclass
class Paths:
    """Paths of both haplotypes, and which of them meet at a stretch or across an allele that is known to exist."""

    walks: list[list[Handle]] = field(default_factory=list)
    haplotype: list[int] = field(default_factory=list)
    meet: list[tuple[int, int]] = field(default_factory=list)
    across: list[tuple[int, int]] = field(default_factory=list)

    def new(self, haplotype: int) -> int:
        self.walks.append([])
        self.haplotype.append(haplotype)
        return len(self.walks) - 1


def outgoing(halves: list[tuple]) -> Links:
    """Handles that follow each handle; ``halves`` are (node, side, other, other_side)."""
    out: dict[Handle, set[Handle]] = {}
    for node, side, other, other_side in halves:
        out.setdefault((node, side == 0), set()).add((other, other_side == 1))
    return {h: sorted(v) for h, v in out.items()}


def unipaths(nodes: set, out: Links) -> list[list[Handle]]:
    """Maximal runs of the given nodes that follow one another without any other link between them."""

    def onward(h: Handle) -> Handle | None:
        ahead = out.get(h, [])
        if len(ahead) != 1 or ahead[0][0] not in nodes or len(out.get(flip(ahead[0]), [])) != 1:
            return None
        return ahead[0]

    runs, seen = [], set()
    for n in sorted(nodes):
        if n in seen:
            continue
        run = [(n, False)]
        seen.add(n)
        for turn in range(2):
            while (h := onward(run[-1])) and h[0] not in seen:
                run.append(h)
                seen.add(h[0])
            run = [flip(h) for h in reversed(run)]
        runs.append(run)
    return runs


def bridge_parts(nodes: set, out: Links, stretches: list[list[Handle]]) -> Iterator[tuple[Links, set, list[Handle]]]:
    """(links, nodes, inward handles) of what hangs together once the stretches' nodes are cut through."""
    cut = {h[0] for run in stretches for h in run}
    up: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    end = lambda h: (h[0], 0 if h[1] else 1)  # noqa: E731  the side that a handle is left by
    for h, ahead in out.items():
        for g in ahead:
            up[find(end(h))] = find(end(flip(g)))
    for n in nodes - cut:
        up[find((n, 0))] = find((n, 1))
    members: dict[tuple, set] = {}
    for n in nodes:
        for side in (0, 1):
            members.setdefault(find((n, side)), set()).add(n)
    doors: dict[tuple, list[Handle]] = {}
    for run in stretches:
        for inward in (run[-1], flip(run[0])):
            doors.setdefault(find(end(inward)), []).append(inward)
    inside: dict[tuple, Links] = {}
    for h, ahead in out.items():
        inside.setdefault(find(end(h)), {})[h] = ahead
    for root, held in sorted(members.items(), key=lambda m: min(m[1])):
        yield inside.get(root, {}), held, sorted(doors.get(root, []))


def unambiguous(out: Links, start: Handle, allowed: set) -> list[Handle]:
    """The walk from ``start`` while there is one way on and it stays in the haplotype."""
    walk = [start]
    while len(ahead := out.get(walk[-1], [])) == 1 and ahead[0][0] in allowed and ahead[0] not in walk:
        walk.append(ahead[0])
    return walk


def allele(out: Links, mine: set, others: set, start: Handle | None, stop: Handle | None, most_steps: int) -> tuple[list[Handle], list[Handle], bool]:
    """(walk from the left, walk to the right, whether a walk through all of one haplotype's nodes exists)."""
    links = [(*h, *g) for h, ahead in out.items() for g in ahead]
    starts, ends = [start] if start else [], [stop] if stop else []
    solved, path, n = hamiltonian_path(links, mine, starts, ends, others, most_steps)
    if solved and path:
        if n == len(path):
            return path, [], True
        back_solved, back, m = hamiltonian_path(links, mine, [flip(h) for h in ends], [flip(h) for h in starts], others, most_steps)
        return path[:n], [flip(h) for h in reversed(back[:m])] if back_solved else [], True
    ahead = unambiguous(out, start, mine) if start else []
    behind = [flip(h) for h in reversed(unambiguous(out, flip(stop), mine))] if stop else []
    return ahead, behind, False


def simple_bubbles(out: Links, nodes: set, phase: dict, alone: dict) -> Iterator[Unit]:
    """Two alternatives of each other, and of nothing else, between two nodes without alternatives."""
    done: set[Handle] = set()
    for n in sorted(nodes - phase.keys()):
        for side in ((n, False), (n, True)):
            both = out.get(side, [])
            if side in done or len(both) != 2:
                continue
            after = [out.get(h, []) for h in both]
            if any(len(out.get(flip(h), [])) != 1 for h in both) or any(len(a) != 1 for a in after) or after[0] != after[1]:
                continue
            far = after[0][0]
            if len(out.get(flip(far), [])) > 2 or far[0] in phase or alone.get(both[0][0]) != both[1][0]:
                continue
            first = sorted(both, key=lambda h: phase[h[0]])
            done |= {side, flip(far)}
            yield Unit(side, flip(far), [[side, h, far] for h in first], [[], []], [True, True])


def stretch_outward(out: Links, inward: Handle, phase: dict) -> list[Handle]:
    """Handles that lead to ``inward`` without an alternative way, the last one ``inward`` itself."""
    run = [flip(inward)]
    while len(ahead := out.get(run[-1], [])) == 1 and len(out.get(flip(ahead[0]), [])) == 1 and ahead[0][0] not in phase and ahead[0] not in run:
        run.append(ahead[0])
    return [flip(h) for h in reversed(run)]


def units(nodes: set, out: Links, phase: dict, alone: dict, foreign: set, groups: dict, most_steps: int) -> tuple[list[Unit], dict[Handle, list[Handle]]]:
    """All units of a connected component, and the stretch behind each inward handle, which it ends."""
    edges = [((n, 0), (n, 1)) for n in sorted(nodes)]
    at = len(edges)
    edges += sorted({tuple(sorted(((h[0], 0 if h[1] else 1), (g[0], 1 if g[1] else 0)))) for h, ahead in out.items() for g in ahead})
    cut = find_bridges(edges)
    stretches = unipaths({edges[i][0][0] for i in cut if i < at} - phase.keys(), out)
    behind: dict[Handle, list[Handle]] = {}
    for run in stretches:
        behind[run[-1]], behind[flip(run[0])] = run, [flip(h) for h in reversed(run)]
    found: list[Unit] = []
    for inside, held, doors in bridge_parts(nodes, out, stretches):
        mine = [{n for n in held if phase.get(n) == p} for p in (0, 1)]
        crossed = [False, False]
        if len(doors) <= 2:
            here = mine[0] | mine[1]
            if not here or here & foreign or any(not groups[n] <= held for n in here):
                continue
            start, stop = (doors[0] if doors else None), (flip(doors[1]) if len(doors) == 2 else None)
            walks = [allele(inside, mine[p], mine[1 - p], start, stop, most_steps) for p in (0, 1)]
            crossed = [w[2] for w in walks]
            if any(crossed):
                found.append(Unit(start, flip(stop) if stop else None, [w[0] for w in walks], [w[1] for w in walks], crossed))
        if not any(crossed):
            for unit in simple_bubbles(inside, held, phase, alone):
                found.append(unit)
                for inward in (unit.left, unit.right):
                    run = stretch_outward(out, inward, phase)
                    behind[inward], behind[flip(run[0])] = run, [flip(h) for h in reversed(run)]
    return found, behind


def rows_of_units(found: list[Unit], behind: dict[Handle, list[Handle]]) -> Iterator[tuple[list[Unit], bool]]:
    """Units in a row, each turned so that the row reads from left to right; and whether the row closes upon itself."""
    enter = {h: (i, k) for i, u in enumerate(found) for k, h in enumerate((u.left, u.right)) if h}
    seen: set[int] = set()

    def following(inward: Handle | None) -> Handle | None:
        """The inward handle of the next unit, across the stretch that ends at ``inward``."""
        return flip(behind[inward][0]) if inward else None

    for i, unit in enumerate(found):
        if i in seen:
            continue
        row, closed = [unit], False
        seen.add(i)
        for turn in range(2):
            while (h := following(row[-1].right)) in enter:
                j, k = enter[h]
                if j in seen:
                    closed = closed or h == row[0].left
                    break
                seen.add(j)
                row.append(found[j] if k == 0 else found[j].turned())
            if closed:
                break
            row = [u.turned() for u in reversed(row)]
        yield row, closed


def written(row: list[Unit], closed: bool, behind: dict[Handle, list[Handle]], paths: Paths) -> None:
    """Both haplotypes along a row of units."""
    now = [paths.new(0), paths.new(1)]
    first = row[0]
    if first.left:
        paths.meet.append(tuple(now))
        for p in (0, 1):
            run = behind[first.left]
            if closed and row[-1].from_right[p]:
                paths.walks[now[p]] += row[-1].from_right[p][:-1]
            paths.walks[now[p]] += run[:-1] if first.from_left[p] else run
    for i, unit in enumerate(row):
        for p in (0, 1):
            if i:  # the first handle is the last of the stretch
                paths.walks[now[p]] += unit.from_left[p][1:]
            else:
                paths.walks[now[p]] += unit.from_left[p]
            if unit.from_right[p] and not (closed and i == len(row) - 1):
                further = paths.new(p)
                if unit.crossed[p]:
                    paths.across.append((now[p], further))
                paths.walks[further] += unit.from_right[p]
                now[p] = further
        if unit.right and not (closed and i == len(row) - 1):
            paths.meet.append(tuple(now))
            onward = [flip(h) for h in reversed(behind[unit.right])]
            for p in (0, 1):
                paths.walks[now[p]] += onward[1:] if paths.walks[now[p]] else onward


def extended(paths: Paths, out: Links, phase: dict) -> None:
    """Paths go on while the only nodes ahead are phased and one of them, on no path of its haplotype, is in phase."""
    for p in (0, 1):
        mine = [i for i, h in enumerate(paths.haplotype) if h == p]
        count: dict = {}
        for i in mine:
            for h in paths.walks[i]:
                count[h[0]] = count.get(h[0], 0) + 1
        for i in mine:
            for turn in range(2):
                walk = paths.walks[i]
                if walk and count[walk[-1][0]] == 1:
                    while True:
                        ahead = out.get(walk[-1], [])
                        ours = [h for h in ahead if phase.get(h[0]) == p]
                        if len(ours) != 1 or any(h[0] not in phase for h in ahead) or count.get(ours[0][0]):
                            break
                        walk.append(ours[0])
                        count[ours[0][0]] = 1
                paths.walks[i] = [flip(h) for h in reversed(walk)]


def kept_paths(paths: Paths, lengths: dict, phase: dict, least: float) -> set[int]:
    """Paths phased to a share of ``least``, and those that hang on such by a stretch or an allele that exists."""
    share = []
    for walk in paths.walks:
        total = sum(lengths.get(h[0], 0) for h in walk)
        share.append(sum(lengths.get(h[0], 0) for h in walk if h[0] in phase) / total if total else 0.0)
    beside: dict[int, list[tuple[int, bool]]] = {}
    for pairs, passes in ((paths.meet, False), (paths.across, True)):
        for a, b in pairs:
            beside.setdefault(a, []).append((b, passes))
            beside.setdefault(b, []).append((a, passes))
    kept = {i for i, s in enumerate(share) if s >= least}
    todo = sorted(kept)
    while todo:
        for other, passes in beside.get(todo.pop(), []):
            if other not in kept:
                kept.add(other)
                if passes or share[other] >= least:
                    todo.append(other)
    return kept


def without_loops(walk: list[Handle], out: Links) -> list[list[Handle]]:
    """The walk cut where a link leads from one of its handles back to itself or an earlier one."""
    last, cuts = {}, set()
    for i, h in enumerate(walk):
        last[h] = i
        back = [last[g] for g in out.get(h, []) if g in last]
        if back:
            cuts |= {i + 1, back[0]} - {0, len(walk)}
    edges = [0, *sorted(cuts), len(walk)]
    return [walk[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def phase_paths(halves: list[tuple], nodes: list[tuple], least: float = 0.1, most_steps: int = 5000) -> list[tuple[int, list[Handle]]]:
    """(haplotype, walk) of one connected component; ``nodes`` are (node, length, alternatives' component, haplotype, foreign).

    ``foreign`` marks alternatives with a member in another component of the graph that has links.
    """
    out, every = outgoing(halves), {n[0] for n in nodes}
    phase = {n: h for n, _, g, h, _ in nodes if g is not None}
    members: dict = {}
    for n, _, g, _, _ in nodes:
        if g is not None:
            members.setdefault(g, set()).add(n)
    groups = {n: members[g] for n, _, g, _, _ in nodes if g is not None}
    alone = {n: next(iter(m - {n})) for n, m in groups.items() if len(m) == 2}
    foreign = {n for n, _, _, _, f in nodes if f}
    for n in foreign:
        alone.pop(n, None)
    found, behind = units(every, out, phase, alone, foreign, groups, most_steps)
    paths = Paths()
    for row, closed in rows_of_units(found, behind):
        written(row, closed, behind, paths)
    extended(paths, out, phase)
    kept = kept_paths(paths, {n[0]: n[1] for n in nodes}, phase, least)
    return [(paths.haplotype[i], part) for i in sorted(kept) if paths.walks[i] for part in without_loops(paths.walks[i], out)]


def chain_haplotypes(halves: DataFrame, nodes: DataFrame, alts: DataFrame, phases: DataFrame, least: float = 0.1, most_steps: int = 5000) -> DataFrame:
    """(path, phase, step, node, reversed): haplotype paths through a phased graph.

    ``nodes(node, length)``, ``alts(node, component)`` (the alternatives' components), ``phases(node, partition)``:
    partition 1 is haplotype 1, any other haplotype 0. Paths of a component are numbered within it, and named by
    its smallest node, the haplotype and the number.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    comp = connected_components(halves.select(F.col("node").alias("a"), F.col("other").alias("b")))
    n = nodes.join(comp, "node", "left").select("node", "length", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("linked"))
    n = n.join(alts.select("node", F.col("component").alias("alt")), "node", "left").join(phases, "node", "left")
    far = n.where("alt IS NOT NULL AND linked").groupBy("alt").agg(F.countDistinct("component").alias("places"), F.min("component").alias("one"))
    n = n.join(far, "alt", "left")
    foreign = F.coalesce((F.col("places") > 1) | (F.col("one") != F.col("component")), F.lit(False))
    alt = F.col("alt").cast(kind)
    every = n.select(F.col("component").alias("part"), F.col("node").alias("name"), F.col("length").cast("long").alias("number"), alt.alias("other"), F.when(F.col("partition") > 0, 1).otherwise(0).alias("end"), foreign.alias("foreign"))
    h = halves.join(comp, "node").select(F.col("component").alias("part"), F.col("node").alias("name"), F.col("side").cast("long").alias("number"), F.col("other").alias("other"), F.col("other_side").alias("end"), F.lit(None).cast("boolean").alias("foreign"))

    def run(part: object, rows: list[tuple]) -> list[tuple]:
        links = [r[:4] for r in rows if r[4] is None]
        found = phase_paths(links, [r for r in rows if r[4] is not None], least, most_steps)
        return [(f"{part}.{p}.{i}", p, k, g[0], g[1]) for i, (p, walk) in enumerate(found) for k, g in enumerate(walk)]

    return map_groups(h.unionAll(every), "part", run, f"path string, phase int, step long, node {kind}, reversed boolean")
