"""Bubble chains of whole parts of a graph, worked out in arrays within a task.

Where it is known beforehand that no link joins two parts, as with paths, a task takes many parts at a time as one
block and nothing of them is shuffled. The rules are those of ``chains``, ``chain_paths`` and ``writers.chain_rows``; all
names are long integers, and a part must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandframe.operators.chains import walk

#: Links of a block, about; a part is never cut.
BLOCK = 250_000
#: Chains of more items are walked one by one, others all at once, a layer a step.
LONG = 1000


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the ``n`` nodes that each is connected with."""
    up = np.arange(n)
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := up[up], up):
            up = further
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return up


def items(n: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes are chainable, and each node's item; ``p`` and ``q`` are sides (2 * node + side), sorted, in both directions."""
    node, other, low, high = p >> 1, q >> 1, np.searchsorted(p, q), np.searchsorted(p, q, "right")
    least, most = np.full(len(p), n), np.full(len(p), -1)  # second neighbours; the node itself stands twice there at most
    for k in range(3):
        i, j = np.minimum(low + k, high - 1), np.maximum(high - 1 - k, low)
        least = np.where((least == n) & (other[i] != node), other[i], least)
        most = np.where((most < 0) & (other[j] != node), other[j], most)
    first = np.flatnonzero(np.diff(p, prepend=-1))
    far, far_most, degree = np.full(2 * n, n), np.full(2 * n, -1), np.zeros(2 * n, int)
    if len(p):
        far[p[first]], far_most[p[first]] = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
    fresh = (other != node) & ((np.diff(p, prepend=-1) != 0) | (np.diff(other, prepend=-1) != 0))
    degree += np.bincount(p[fresh], minlength=2 * n)
    none, one = far_most < 0, far == far_most
    haploid = none[::2] & none[1::2]
    diploid = one[::2] & one[1::2] & (far[::2] == far[1::2]) & (degree[::2] < 3) & (degree[1::2] < 3)
    tip = (degree[::2] == 0) & one[1::2] & (degree[1::2] < 3) | (degree[1::2] == 0) & one[::2] & (degree[::2] < 3)
    chainable = haploid | diploid | tip
    chainable[node[node == other]] = False
    partner = np.where(haploid, n, np.minimum(far[::2], far[1::2]))
    there = np.append(chainable, False)[partner]
    return chainable, np.where(there, np.minimum(np.arange(n), partner), np.arange(n))


def layers(n: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chain, layer, node, reversed) of ``n`` nodes; ``p`` and ``q`` as in ``items``, all links in both directions and once."""
    chainable, item = items(n, p, q)
    inside = chainable[p >> 1] & chainable[q >> 1] & (item[p >> 1] != item[q >> 1])
    p, q = p[inside], q[inside]
    mine, theirs = item[p >> 1], item[q >> 1]
    chain = labels(n, mine, theirs)
    linked, present = np.zeros(2 * n, bool), np.zeros(n, bool)
    linked[p] = present[p >> 1] = True
    sides = np.zeros((n, 2), bool)
    sides[mine, p & 1] = True
    onward = np.bincount(np.unique(mine * n + theirs) // max(n, 1), minlength=n)
    of = np.flatnonzero(sides.any(1))
    ends = of[(sides[of, 0] != sides[of, 1]) | (onward[of] < 2)]
    first = np.full(n, n)
    np.minimum.at(first, chain[ends], ends)
    heads = of[chain[of] == of]
    first[heads] = np.where(first[heads] == n, heads, first[heads])
    long = np.bincount(chain[of], minlength=n) > LONG

    nodes = np.flatnonzero(present)
    nodes = nodes[(item[nodes] == first[chain[item[nodes]]]) & ~long[chain[item[nodes]]]]
    out = np.where(sides[item[nodes], 0] & ~sides[item[nodes], 1], 0, 1)
    lead = np.full(n, n)
    np.minimum.at(lead, item[nodes], nodes)
    out = np.where(linked[2 * lead[item[nodes]] + out], out, linked[2 * nodes + 1].astype(int))
    seen, nearest = np.zeros(n, bool), np.full(n, n)
    seen[item[nodes]] = True
    start = np.searchsorted(p, np.arange(2 * n + 1))
    found, layer = [], 0
    while len(nodes):
        found.append((chain[item[nodes]], np.full(len(nodes), layer), nodes, out == 0))
        at = 2 * nodes + out
        count = start[at + 1] - start[at]
        row = np.repeat(start[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        row = row[~seen[theirs[row]]]
        of_row = chain[theirs[row]]
        nearest[of_row] = n
        np.minimum.at(nearest, of_row, theirs[row])
        row = row[theirs[row] == nearest[of_row]]
        nodes, once = np.unique(q[row] >> 1, return_index=True)
        out = 1 - (q[row][once] & 1)
        seen[item[nodes]] = True
        layer += 1

    for c in np.flatnonzero(long):
        here = np.flatnonzero(chain[mine] == c)
        walked = np.array(walk(list(zip(*(x[here].tolist() for x in (p >> 1, p & 1, q >> 1, q & 1, mine, theirs)), strict=True))))
        found.append((np.full(len(walked), c), walked[:, 0], walked[:, 1], walked[:, 2] == 1))
    lone = np.flatnonzero(chainable & ~sides.any(1)[item])
    found.append((item[lone], np.zeros(len(lone), int), lone, np.zeros(len(lone), bool)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def on_paths(n: int, chain: np.ndarray, layer: np.ndarray, node: np.ndarray, partition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node and phase, whether the phase's haplotype path of a chain holds the node, and per node whether it ends one; ``partition`` of all nodes."""
    order = np.lexsort((node, layer, chain))
    chain, layer, node = chain[order], layer[order], node[order]
    side = partition[node]
    on, cap = np.zeros((n, 2), bool), np.zeros(n, bool)
    if not len(node):
        return on, cap
    fresh = np.append(True, (np.diff(chain) != 0) | (np.diff(layer) != 0))
    head, which = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    size = np.diff(np.append(head, len(node)))
    ok = (size == 1) | (np.minimum.reduceat(side, head) == -1) & (np.maximum.reduceat(side, head) == 1)
    stretch = np.cumsum(~ok | np.append(True, np.diff(chain[head]) != 0))  # also a chain's first layer begins one
    for phase in (0, 1):
        i = np.flatnonzero(ok[which] & ((size[which] == 1) | ((side == -1) == (phase == 0))))
        if not len(i):
            continue
        begins = np.append(True, np.diff(stretch[which[i]]) != 0)
        ends = np.append(begins[1:], True)
        path = ~(begins & ends)
        on[node[i[path]], phase] = True
        cap[node[i[path & (begins | ends)]]] = True
    return on, cap


def graph_of(a: np.ndarray, back_a: np.ndarray, b: np.ndarray, back_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names in order, the sides (2 * place + side) that links join, in both directions and once, and the places of ``a`` and ``b``."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, m = len(names), len(a)
    one, two = 2 * at[:m] + ~back_a, 2 * at[m:] + back_b
    return names, *np.divmod(np.unique(np.concatenate([one * 2 * n + two, two * 2 * n + one])), 2 * n), at


def _block(a: np.ndarray, back_a: np.ndarray, side_a: np.ndarray, b: np.ndarray, back_b: np.ndarray, side_b: np.ndarray) -> pa.RecordBatch:
    names, p, q, at = graph_of(a, back_a, b, back_b)
    partition = np.empty(len(names), int)
    partition[at] = np.concatenate([side_a, side_b])
    chain, layer, node, _ = layers(len(names), p, q)
    on, cap = on_paths(len(names), chain, layer, node, partition)
    off = ~on.any(1)
    return pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(x, mask=off) for x in (on[:, 0], on[:, 1], cap))], names=["node", "p0", "p1", "cap"])


COLUMNS = ("part", "node_a", "rev_a", "partition_a", "node_b", "rev_b", "partition_b")
PLACES = "node long, p0 boolean, p1 boolean, cap boolean"


def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PLACES`` of ``COLUMNS``, block by block; parts must come in order, so that none is in two blocks."""
    held, rows, last = [], 0, None
    for batch in batches:
        c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if not len(c[0]):
            continue
        if (np.diff(c[0]) < 0).any() or last is not None and c[0][0] < last:
            raise ValueError("parts are not in order")
        last = c[0][-1]
        held.append(c)
        rows += len(c[0])
        if rows < BLOCK:
            continue
        c = [np.concatenate(x) for x in zip(*held, strict=True)]
        whole = int(np.searchsorted(c[0], last))
        if whole:
            yield _block(*(x[:whole] for x in c[1:]))
        held, rows = [[x[whole:].copy() for x in c]], len(c[0]) - whole
    if rows:
        yield _block(*[np.concatenate(x) for x in zip(*held, strict=True)][1:])


def chain_places(links: DataFrame) -> DataFrame:
    """(node, p0, p1, cap): whether the haplotype paths of either phase hold a node, and whether it ends one; null on no path.

    ``links(part, node_a, rev_a, partition_a, node_b, rev_b, partition_b)`` without nulls, the rows of a part in one task and
    in ascending order of parts, as a window by part leaves them; another order is an error.
    """
    return links.select(*COLUMNS).mapInArrow(places_of, PLACES)
