"""Scores of a two-way partition of contact-graph nodes, and the search for a good one.

The search keeps, per connected alt component, one sign: the two sides of a component are opposite
phases, so the score is a quadratic form over signs and a flip's gain is known in advance. Samples are
independent, each with a seed of its own. Parts of the graph that no contact joins are searched apart, in tasks that
are given one part's contacts, packed and in order; the driver sees none. A part must fit a task (as a graph must fit one machine in any
tool of this kind); its size is checked, and a larger one is refused. Searches with sides left out and those over
bubbles still take their whole graph, checked too, to the driver and to every sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.components import connected_components
from strandframe.sources.shared import discard, numbered, stash

#: Rows of one part of a search's graph, or of what is taken to the driver, at most.
MOST_ROWS = 20_000_000
#: Components of fewer contacts are searched several at a time, in parts of about so many.
PART = 100_000
#: Visits that a search compares at once.
VISITS = 512
#: Contacts of units, about, that are summed or renamed at once.
CONTACTS = 1_000_000


def held(df: DataFrame, what: str, most: int | None = None) -> pd.DataFrame:
    """A table of a checked size, on the driver."""
    most = MOST_ROWS if most is None else most
    n = df.count()
    if n > most:
        raise ValueError(f"{what} of {n} rows do not fit one search; the most are {most}")
    return df.toPandas()


def scored_edges(contacts: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between different nodes with both partitions (absent: 0) and their consistency."""
    p = lambda x: parts.select(F.col("node").alias(x), F.col("partition").alias(f"p{x}"))
    e = contacts.where("a <> b").join(p("a"), "a", "left").join(p("b"), "b", "left").fillna(0, ["pa", "pb"])
    return e.withColumn("score", F.col("pa") * F.col("pb") * F.col("weight"))


def total_consistency(contacts: DataFrame, parts: DataFrame) -> DataFrame:
    return scored_edges(contacts, parts).agg(F.sum("score").cast("long").alias("score"))


def node_consistency(contacts: DataFrame, parts: DataFrame) -> DataFrame:
    e = scored_edges(contacts, parts)
    half = e.select(F.col("a").alias("node"), "score").unionAll(e.select(F.col("b").alias("node"), "score"))
    return half.groupBy("node").agg(F.sum("score").cast("long").alias("score"))


def node_consistency_with_alts(contacts: DataFrame, parts: DataFrame, alts: DataFrame) -> DataFrame:
    """(node, score): a node's edges and those of its direct alternatives; ``alts(a, b)``, each pair once."""
    own = node_consistency(contacts, parts)
    both = alts.select("a", "b").unionAll(alts.select("b", "a")).distinct()
    theirs = both.join(own.select(F.col("node").alias("b"), "score"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("score").alias("more"))
    nodes = own.select("node").union(theirs.select("node")).distinct()
    j = nodes.join(own, "node", "left").join(theirs, "node", "left").fillna(0, ["score", "more"])
    return j.select("node", (F.col("score") + F.col("more")).alias("score"))


def component_consistency(contacts: DataFrame, parts: DataFrame, alts: DataFrame) -> DataFrame:
    """(component, score) over both sides of each component of alternatives."""
    return node_consistency(contacts, parts).join(alts.select("node", "component"), "node").groupBy("component").agg(F.sum("score").alias("score"))


def bubble_adjacency(contacts: DataFrame, bubbles: DataFrame) -> DataFrame:
    """(a, b), a < b: bubbles with a contact between them; ``bubbles(node, bubble)``."""
    s = lambda x: bubbles.select(F.col("node").alias(x), F.col("bubble").alias(f"u{x}"))
    e = contacts.join(s("a"), "a").join(s("b"), "b").where("ua <> ub")
    return e.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()


def bubble_consistency(contacts: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Per pair of bubbles: weight within equal sides and across sides; ``bubbles(node, bubble, side)``."""
    s = lambda x: bubbles.select(F.col("node").alias(x), F.col("bubble").alias(f"u{x}"), F.col("side").alias(f"s{x}"))
    e = contacts.join(s("a"), "a").join(s("b"), "b").where("ua <> ub")
    same = F.col("sa") == F.col("sb")
    return e.groupBy(F.least("ua", "ub").alias("bubble_a"), F.greatest("ua", "ub").alias("bubble_b")).agg(F.sum(F.when(same, F.col("weight")).otherwise(0)).cast("long").alias("same_side"), F.sum(F.when(~same, F.col("weight")).otherwise(0)).cast("long").alias("cross_side"))


def true_phase(pat_identity: Column, mat_identity: Column) -> Column:
    """1 if the maternal reference is the better one, else 0; 2 if either has no alignment."""
    return F.when((pat_identity == 0) | (mat_identity == 0), 2).when(mat_identity > pat_identity, 1).otherwise(0)


def orientation_votes(samples: DataFrame, contacts: DataFrame) -> DataFrame:
    """Per edge: samples (``sample, node, partition``) that put its ends in different and in equal phases."""
    p = lambda x: samples.select("sample", F.col("node").alias(x), F.col("partition").alias(f"p{x}"))
    e = contacts.where("a <> b").select("a", "b").join(p("a"), "a").join(p("b"), ["sample", "b"]).where("pa <> 0 AND pb <> 0")
    return e.groupBy("a", "b").agg(F.sum((F.col("pa") != F.col("pb")).cast("int")).alias("n_different"), F.sum((F.col("pa") == F.col("pb")).cast("int")).alias("n_same"))


def narrowed(w: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest kind that holds them, others as they are."""
    if len(w) and np.abs(w).max() < 2**31 and (w == np.floor(w)).all():
        return w.astype(np.min_scalar_type(-1 - int(np.abs(w).max())))
    return w.astype(float)


def climb(start: np.ndarray, dst: np.ndarray, val: np.ndarray, iterations: int, seed: int) -> tuple[np.ndarray, float]:
    """Best signs (-1, 1) of units, and their score; the contacts of unit u are ``dst`` and ``val`` from ``start[u]`` to ``start[u + 1]``, in both directions.

    ``f`` holds every unit's field. A flip changes only its neighbours' fields, so a visit that flips nothing costs a
    comparison, and runs of them are compared at once; the order of visits and the decisions are those of one after another.
    """
    rng, k = np.random.default_rng(seed), len(start) - 1
    x = rng.choice([-1.0, 1.0], size=k)
    if not len(dst):
        return x, 0.0
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(dst), CONTACTS)), k))

    def fields() -> np.ndarray:
        out = np.zeros(k)
        for low, high in zip([0, *cuts], cuts, strict=False):
            here = slice(start[low], start[high])
            out[low:high] = np.bincount(np.repeat(np.arange(high - low), np.diff(start[low : high + 1])), val[here] * x[dst[here]], high - low)
        return out

    def flip(u: int) -> None:
        x[u] = -x[u]
        f[dst[start[u] : start[u + 1]]] += 2 * x[u] * val[start[u] : start[u + 1]]

    f, whole = fields(), val.dtype.kind == "i"
    best, best_x, best_f = -np.inf, x.copy(), f.copy()
    for _ in range(iterations):
        for u in rng.integers(0, k, size=k // 30 + 1):
            if rng.choice([-1.0, 1.0]) != x[u]:
                flip(u)
        visits, i = rng.integers(0, k, size=3 * k), 0
        while i < len(visits):
            run = visits[i : i + VISITS]
            wrong = x[run] * f[run] < 0
            j = int(wrong.argmax())
            if wrong[j]:
                flip(run[j])
                i += j + 1
            else:
                i += VISITS
        total = float((x * f).sum()) / 2
        if total > best:
            f = f if whole else fields()  # no rounding of weights with fractions adds up
            best, best_x, best_f = total, x.copy(), f.copy()
        else:
            x, f = best_x.copy(), best_f.copy()
    return best_x, best


def search(edges: np.ndarray, weights: np.ndarray, unit: np.ndarray, sign: np.ndarray, iterations: int, seed: int) -> tuple[np.ndarray, float]:
    """Best partition (-1, 1) of ``len(unit)`` nodes; ``unit``: alt component of each node, ``sign``: its side."""
    k = int(unit.max()) + 1 if len(unit) else 0
    a, b = unit[edges[:, 0]], unit[edges[:, 1]]
    w = weights * sign[edges[:, 0]] * sign[edges[:, 1]]
    keep = a != b
    pair, at = np.unique(np.concatenate([a[keep] * k + b[keep], b[keep] * k + a[keep]]), return_inverse=True)
    val = narrowed(np.bincount(at, np.concatenate([w[keep], w[keep]]), len(pair)))
    x, best = climb(np.searchsorted(pair // max(k, 1), np.arange(k + 1)), pair % max(k, 1), val, iterations, seed)
    return x[unit] * sign, best + float(w[~keep].sum())


PACKED = "part long, a0 long, b0 long, a binary, n binary, b binary, w binary, kinds string"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, range, a, b, w) in order as rows of whole batches: the units ``a``, their numbers of contacts, and these, each as an array of its kind."""
    for batch in batches:
        part, span, a, b, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [*np.flatnonzero(np.diff(part, prepend=part[:1] - 1) | np.diff(span, prepend=span[:1])), len(part)]
        out = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            first = low + np.flatnonzero(np.diff(a[low:high], prepend=a[low] - 1))
            kinds = b[low:high].astype(np.int32 if b[low:high].max() < 2**31 else np.int64), narrowed(w[low:high])
            out.append((part[low], a[low], b[low], a[first].tobytes(), np.diff(np.append(first, high)).tobytes(), *(x.tobytes() for x in kinds), " ".join(x.dtype.str for x in kinds)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.binary()] * 4 + [pa.string()], strict=True)], names=[f.split()[0] for f in PACKED.split(", ")])


class Part:
    """Contacts of one part, filled from packed rows in the order of their units; ``room`` rows at most, as small as their kinds allow."""

    def __init__(self, room: int) -> None:
        self.dst, self.val, self.at, self.own = np.empty(room, np.int32), np.empty(room, np.int8), 0, 0.0
        self.units, self.counts = [], []

    def add(self, a: np.ndarray, n: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        other = np.repeat(a, n) != b
        self.own += float(w[~other].sum(dtype=float))
        self.units.append(a.copy())
        self.counts.append(np.add.reduceat(other, np.cumsum(n) - n, dtype=np.int64))
        b, w = b[other], w[other]
        self.dst, self.val = (x if (kind := np.promote_types(x.dtype, y.dtype)) == x.dtype else x.astype(kind) for x, y in ((self.dst, b), (self.val, w)))
        self.dst[self.at : self.at + len(b)], self.val[self.at : self.at + len(b)] = b, w
        self.at += len(b)

    def ended(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names of units, and their contacts as ``climb`` takes them."""
        units, counts = np.concatenate(self.units), np.concatenate(self.counts)
        first = np.flatnonzero(np.diff(units, prepend=units[0] - 1))
        names, dst = units[first], self.dst[: self.at]
        for i in range(0, len(dst), CONTACTS):
            dst[i : i + CONTACTS] = np.searchsorted(names, dst[i : i + CONTACTS])
        return names, np.append(0, np.cumsum(np.add.reduceat(counts, first))), dst, self.val[: self.at]


def _units(contacts: DataFrame, alts: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Nodes with a contact (node, unit, sign), contacts of units (a, b, w), a <= b, and the paths of both tables.

    A unit is an alt component, or a node without one; units are numbered by their smallest node. Every unit has a row
    with itself, which holds the contacts between its own nodes; ``w`` is positive where both signs should be equal.
    """
    spark = contacts.sparkSession
    graph, graph_path = stash(contacts.where("a <> b").groupBy("a", "b").agg(F.sum("weight").cast("double").alias("weight")), "search-contacts")
    side = alts.select("node", "component", F.when(F.col("side") == 0, 1.0).otherwise(-1.0).alias("sign")).dropDuplicates(["node"])
    nodes = graph.select(F.col("a").alias("node")).unionAll(graph.select("b")).distinct().join(side, "node", "left")
    alone = F.when(F.col("sign").isNull(), F.col("node"))
    named, named_path = stash(nodes.withColumn("name", F.min("node").over(Window.partitionBy("component", alone))).select("node", "name", F.coalesce("sign", F.lit(1.0)).alias("sign")), "search-names")
    places = numbered(named.select("name").distinct(), "unit", 0, "name")
    members, members_path = stash(named.join(places, "name").select("node", "unit", "sign"), "search-nodes")
    end = lambda c: members.select(F.col("node").alias(c), F.col("unit").alias(f"u{c}"), F.col("sign").alias(f"s{c}"))
    e = graph.join(end("a"), "a").join(end("b"), "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"), (F.col("weight") * F.col("sa") * F.col("sb")).alias("w"))
    own = members.select(F.col("unit").alias("a"), F.col("unit").alias("b"), F.lit(0.0).alias("w"))
    edges, path = stash(e.unionAll(own).groupBy("a", "b").agg(F.sum("w").alias("w")), "search-edges")
    discard(spark, graph_path, named_path)
    return members, edges, [members_path, path]


def _found(contacts: DataFrame, alts: DataFrame, samples: int, iterations: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(part, sample, unit, sign, score) of every sample's search in every part, and the nodes of the units.

    No contact joins two parts: a part is a connected component of the units, or several small ones. Its contacts are
    put in order and packed in many tasks, and come together in one, which searches for a share of the samples; large
    parts are given to several tasks. What such a task holds is 5 bytes a contact and direction if weights are small whole numbers.
    """
    spark = contacts.sparkSession
    members, edges, paths = _units(contacts, alts)
    labels = connected_components(edges.select("a", "b")).select(F.col("node").alias("a"), "component")
    sizes, sizes_path = stash(edges.join(labels, "a").groupBy("component").agg(F.count("*").alias("n"), F.max("a").alias("last")), "search-sizes")
    total, most, small, last = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") < PART, F.col("n"))), F.lit(0)), F.coalesce(F.max("last"), F.lit(0))).first()
    if most > MOST_ROWS:
        raise ValueError(f"contacts of {most} rows between units that hang together do not fit one search; the most are {MOST_ROWS}")
    cores, bins = spark.sparkContext.defaultParallelism, -(-small // PART) or 1
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)
    part = F.when(F.col("n") < PART, -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component"))
    named = labels.join(sizes.select("component", part.alias("part")), "component").select("a", "part")
    tasks = F.least(F.lit(samples), F.ceil(F.lit(cores) * F.col("n") / F.lit(max(total, 1)))).cast("long")
    dealt = sizes.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).select("part", (2 * F.col("n")).alias("room"), tasks.alias("tasks"))
    dealt = dealt.withColumn("before", F.sum("tasks").over(Window.orderBy("part")) - F.col("tasks"))  # a row a part
    dealt, dealt_path = stash(dealt, "search-parts")
    slots = dealt.agg(F.coalesce(F.sum("tasks"), F.lit(1))).first()[0]

    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = F.when(F.col("a") == F.col("b"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))
    rows = edges.join(named, "a").select("part", F.explode(both).alias("x"), "w").select("part", F.expr(f"x.a div {last // (4 * n) + 1}").alias("range"), "x.a", "x.b", "w")
    blocks = rows.repartition(n, "part", "range").sortWithinPartitions("part", "range", "a", "b").mapInArrow(packed, PACKED)
    blocks = blocks.join(F.broadcast(dealt), "part").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
    blocks = blocks.repartitionById(int(min(slots, n)), ((F.col("before") + F.col("task")) % F.lit(min(slots, n))).cast("int")).sortWithinPartitions("part", "task", "a0", "b0")

    def searched(part: int, task: int, tasks: int, held: Part) -> Iterator[pa.RecordBatch]:
        names, *graph = held.ended()
        k = len(names)
        for s in range(task, samples, tasks):
            signs, score = climb(*graph, iterations, seed + s)
            yield pa.RecordBatch.from_pydict({"part": np.full(k, part), "sample": np.full(k, s), "unit": names, "sign": signs, "score": np.full(k, score + held.own)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                here = tuple(c[x][i].as_py() for x in ("part", "task", "tasks"))
                if here != now:
                    if now:
                        yield from searched(*now, held)
                    now, held = here, None
                    held = Part(c["room"][i].as_py())
                kinds = [np.int64, np.int64, *c["kinds"][i].as_py().split()]
                held.add(*(np.frombuffer(c[x][i].as_buffer(), kind) for x, kind in zip("anbw", kinds, strict=True)))
        if now:
            yield from searched(*now, held)

    found, _ = stash(blocks.select("part", "task", "tasks", "room", "a", "n", "b", "w", "kinds").mapInArrow(run, "part long, sample long, unit long, sign double, score double"), "search-found")
    discard(spark, sizes_path, dealt_path, *paths[1:])
    return found, members


def sample_partitions(contacts: DataFrame, alts: DataFrame, samples: int = 30, iterations: int = 200, seed: int = 0) -> DataFrame:
    """(sample, node, partition, score) of independent searches, the score over the whole graph; ``alts(node, component, side)``."""
    found, members = _found(contacts, alts, samples, iterations, seed)
    scores = found.groupBy("sample", "part").agg(F.first("score").alias("score")).groupBy("sample").agg(F.sum("score").alias("score"))
    return found.drop("score").join(members.withColumnRenamed("sign", "side"), "unit").join(F.broadcast(scores), "sample").select("sample", "node", (F.col("sign") * F.col("side")).cast("int").alias("partition"), "score")


def phase(contacts: DataFrame, alts: DataFrame, samples: int = 30, iterations: int = 200, seed: int = 0) -> DataFrame:
    """(node, partition) of the best sample, the first of equals; parts of the graph that no contact joins have their own."""
    found, members = _found(contacts, alts, samples, iterations, seed)
    best = found.groupBy("part", "sample").agg(F.first("score").alias("score")).groupBy("part").agg(F.min(F.struct(-F.col("score"), F.col("sample")))["sample"].alias("sample"))
    return found.join(best, ["part", "sample"]).join(members.withColumnRenamed("sign", "side"), "unit").select("node", (F.col("sign") * F.col("side")).cast("int").alias("partition"))


def ordered_votes(votes: DataFrame, strength: DataFrame, samples: int, top_share: float = 1.0) -> DataFrame:
    """Votes on which all samples agree, in the order they are merged: heaviest first, then by the ends' mean consistency, then names.

    ``top_share`` below 1 leaves out those beyond that share of the order.
    """
    end = lambda x: strength.select(F.col("node").alias(x), F.col("score").alias(f"s{x}"))
    most = F.greatest("n_different", "n_same")
    v = votes.where(most == samples).join(end("a"), "a", "left").join(end("b"), "b", "left").fillna(0, ["sa", "sb"])
    v = v.withColumn("mean", (F.col("sa") + F.col("sb")) / 2)
    if top_share < 1:
        v = v.withColumn("rank", F.percent_rank().over(Window.orderBy(F.desc(most), F.desc("mean"), "a", "b"))).where(F.col("rank") <= top_share)
    return v.orderBy(F.desc(most), F.desc("mean"), "a", "b").select("a", "b", "n_different", "n_same")


def merge_round(votes: list[tuple], components: dict, samples: int, strength: dict) -> dict:
    """Join components across edges on which all samples agree, each component once a round.

    ``votes``: (a, b, n_different, n_same); heaviest agreement first, then the ends' mean consistency,
    then names. Ends that always differ become opposite sides, ends that never do become the same side.
    """
    out, touched = dict(components), set()
    members: dict = {}
    for n, (c, _) in components.items():
        members.setdefault(c, []).append(n)
    agreed = [v for v in votes if max(v[2], v[3]) == samples]
    agreed.sort(key=lambda v: (-max(v[2], v[3]), -(strength.get(v[0], 0) + strength.get(v[1], 0)) / 2, v[0], v[1]))
    for a, b, different, same in agreed:
        (ca, sa), (cb, sb) = components.get(a, (a, 0)), components.get(b, (b, 0))
        if ca == cb or ca in touched or cb in touched:
            continue
        touched |= {ca, cb}
        turn = (sa ^ sb ^ 1) if different >= same else (sa ^ sb)
        low = min(ca, cb)
        for c, flip in ((ca, 0), (cb, turn)):
            for n in members.get(c, [c]):
                out[n] = (low, components.get(n, (n, 0))[1] ^ flip)
    return out


def phase_in_rounds(contacts: DataFrame, alts: DataFrame, rounds: int = 2, samples: int = 30, iterations: int = 200, seed: int = 0) -> DataFrame:
    """(node, partition): rounds of sampling, each joining what all samples agree on, then a search three times as long.

    Components and votes of one search are held by the driver, as its graph is by every sample; their size is checked.
    """
    spark = contacts.sparkSession
    kinds = f"node {contacts.schema['a'].dataType.simpleString()}, component {alts.schema['component'].dataType.simpleString()}, side int"
    now = {n: (c, int(s)) for n, c, s in held(alts.select("node", "component", "side"), "alternatives").itertuples(index=False, name=None)}
    frame = lambda: spark.createDataFrame([(n, c, s) for n, (c, s) in now.items()], kinds)
    for r in range(rounds):
        s = sample_partitions(contacts, frame(), samples, iterations, seed + 1000 * r).select("sample", "node", "partition").persist()
        votes = list(held(orientation_votes(s, contacts).select("a", "b", "n_different", "n_same"), "votes").itertuples(index=False, name=None))
        best = s.where("sample = 0").select("node", "partition")
        strength = {x.node: x.score for x in node_consistency(contacts, best).collect()}
        s.unpersist()
        after = merge_round(votes, now, samples, strength)
        if after == now:
            break
        now = after
    return phase(contacts, frame(), samples, 3 * iterations, seed + 1000 * rounds)


def tripartition_search(edges: np.ndarray, weights: np.ndarray, n: int, mate: np.ndarray, iterations: int, seed: int) -> tuple[np.ndarray, float]:
    """Best partition (-1, 0, 1) of ``n`` nodes, of which ``mate`` names the one alternative or -1; a node with one is never 0."""
    rng = np.random.default_rng(seed)
    a, b = edges[:, 0], edges[:, 1]
    src, dst, val = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weights, weights]).astype(float)
    order = np.argsort(src, kind="stable")
    dst, val, start = dst[order], val[order], np.searchsorted(src[order], np.arange(n + 1))
    field = lambda x, u: float((val[start[u] : start[u + 1]] * x[dst[start[u] : start[u + 1]]]).sum())

    def put(x: np.ndarray, u: int, p: int) -> None:
        x[u] = p
        if mate[u] >= 0:
            x[mate[u]] = -p

    def drawn(x: np.ndarray, u: int) -> None:
        put(x, u, int(rng.choice((-1, 1) if mate[u] >= 0 else (-1, 0, 1))))

    x = np.zeros(n)
    for u in range(n):
        drawn(x, u)
    total = lambda y: float((weights * y[a] * y[b]).sum())
    best, best_x = total(x), x.copy()
    for _ in range(iterations):
        for u in rng.integers(0, n, size=n // 30 + 1):
            drawn(x, u)
        for u in rng.integers(0, n, size=3 * n):
            gain = field(x, u) - (field(x, mate[u]) if mate[u] >= 0 else 0.0)
            scores = {p: p * gain for p in ((-1, 1) if mate[u] >= 0 else (-1, 0, 1))}
            choice = max(scores, key=lambda p: (scores[p], p == x[u]))
            if scores[choice] > x[u] * gain:
                put(x, u, choice)
        now = total(x)
        if now > best:
            best, best_x = now, x.copy()
        else:
            x = best_x.copy()
    return best_x.astype(int), best


def flip_search(pairs: np.ndarray, gains: np.ndarray, n: int, iterations: int, seed: int) -> tuple[np.ndarray, float]:
    """Best flips (0, 1) of ``n`` bubbles; ``gains`` of a pair is its weight on equal less that on crossed sides. Flips that do no harm stay."""
    rng = np.random.default_rng(seed)
    a, b = pairs[:, 0], pairs[:, 1]
    src, dst, val = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([gains, gains]).astype(float)
    order = np.argsort(src, kind="stable")
    dst, val, start = dst[order], val[order], np.searchsorted(src[order], np.arange(n + 1))
    x = rng.choice([-1.0, 1.0], size=n)
    total = lambda y: float((gains * y[a] * y[b]).sum())
    best, best_x = total(x), x.copy()
    for _ in range(iterations):
        for u in rng.integers(0, n, size=n // 10 + 1):
            x[u] = -x[u]
        for u in rng.integers(0, n, size=3 * n):
            if x[u] * float((val[start[u] : start[u + 1]] * x[dst[start[u] : start[u + 1]]]).sum()) <= 0:
                x[u] = -x[u]
        now = total(x)
        if now >= best:
            best, best_x = now, x.copy()
        else:
            x = best_x.copy()
    return ((1 - best_x) // 2).astype(int), best


def _sampled(spark, table: pd.DataFrame, samples: int, schema: str, one) -> DataFrame:
    """``one(table, sample)`` for every sample, in tasks of their own."""
    shared = spark.sparkContext.broadcast(table)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for s in pdf["sample"]:
                yield one(shared.value, int(s))

    return spark.range(samples).withColumnRenamed("id", "sample").repartition(min(samples, 64), "sample").mapInPandas(run, schema)


def phase_tripartition(contacts: DataFrame, mates: DataFrame, samples: int = 8, iterations: int = 200, seed: int = 0) -> DataFrame:
    """(sample, node, partition, score) of searches that may leave nodes out; ``mates(a, b)`` are the pairs of alternatives."""
    spark = contacts.sparkSession
    graph = held(contacts.where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight")), "contacts")
    pairs = held(mates.select("a", "b"), "alternatives")
    names = sorted({*graph["a"], *graph["b"], *pairs["a"], *pairs["b"]})
    at = {n: i for i, n in enumerate(names)}
    mate = np.full(len(names), -1)
    for a, b in pairs.itertuples(index=False, name=None):
        mate[at[a]], mate[at[b]] = at[b], at[a]
    table = (names, np.array([[at[a], at[b]] for a, b in zip(graph["a"], graph["b"], strict=True)]).reshape(-1, 2), graph["weight"].to_numpy(float), mate)

    def one(t: tuple, s: int) -> pd.DataFrame:
        part, score = tripartition_search(t[1], t[2], len(t[0]), t[3], iterations, seed + s)
        return pd.DataFrame({"sample": s, "node": t[0], "partition": part, "score": score})

    return _sampled(spark, table, samples, f"sample long, node {contacts.schema['a'].dataType.simpleString()}, partition int, score double", one)


def phase_bubbles(pairs: DataFrame, samples: int = 8, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """(sample, bubble, flipped, score) of searches over ``pairs(bubble_a, bubble_b, same_side, cross_side)``."""
    spark = pairs.sparkSession
    p = held(pairs, "pairs of bubbles")
    names = sorted({*p["bubble_a"], *p["bubble_b"]})
    at = {n: i for i, n in enumerate(names)}
    table = (names, np.array([[at[a], at[b]] for a, b in zip(p["bubble_a"], p["bubble_b"], strict=True)]).reshape(-1, 2), (p["same_side"] - p["cross_side"]).to_numpy(float))

    def one(t: tuple, s: int) -> pd.DataFrame:
        flips, score = flip_search(t[1], t[2], len(t[0]), iterations, seed + s)
        return pd.DataFrame({"sample": s, "bubble": t[0], "flipped": flips, "score": score})

    return _sampled(spark, table, samples, f"sample long, bubble {pairs.schema['bubble_a'].dataType.simpleString()}, flipped int, score double", one)


def best_sample(samples: DataFrame) -> DataFrame:
    """Rows of the sample of the highest score, the first of equals."""
    best = samples.groupBy("sample").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "sample").limit(1)
    return samples.join(F.broadcast(best.select("sample")), "sample").drop("sample", "score")
