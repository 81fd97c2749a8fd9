"""Connected components by contraction: trees of least neighbours become single nodes, until no edge is left."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.sources.shared import discard, stash


def _roots(parents: DataFrame, most_rounds: int) -> tuple[DataFrame, str]:
    """``parents(node, up)``, up <= node, with ``up`` replaced by the root of the node's tree; pointers double their reach a round."""
    spark = parents.sparkSession
    held, path = stash(parents, "roots")
    for _ in range(most_rounds):
        above = held.select(F.col("node").alias("at"), F.col("up").alias("further"))
        new, new_path = stash(held.join(above, F.col("up") == F.col("at")).select("node", F.col("further").alias("up"), (F.col("up") != F.col("further")).alias("moved")), "roots")
        discard(spark, path)
        held, path = new.select("node", "up"), new_path
        if not new.where("moved").limit(1).count():
            return held, path
    raise RuntimeError(f"trees are deeper than {most_rounds} doublings reach")


#: So many edges or fewer, counted, are finished in one task.
SMALL = 100_000


def _finished(edges: DataFrame) -> DataFrame:
    """(node, up): the least node of each component, by union-find over all edges in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        plain = lambda x: tuple(x.items()) if isinstance(x, dict) else x  # noqa: E731  structs come as dictionaries

        def find(x: object) -> object:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        kinds = None
        for batch in batches:
            kinds = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(plain(a)), find(plain(b))
                up[max(x, y)] = min(x, y)
        if up:
            back = (lambda x: dict(x)) if pa.types.is_struct(kinds) else (lambda x: x)
            yield pa.RecordBatch.from_arrays([pa.array([back(x) for x in up], kinds), pa.array([back(find(x)) for x in up], kinds)], names=["node", "up"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, up {kind}")


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``edges(a, b)`` -> (node, component): the smallest node that can be reached. Nodes without edges are not listed.

    A round hooks every node to its least neighbour (pre-aggregated before the shuffle) if that is less than
    itself, finds the roots of the trees that arise, and replaces the edges by those between different roots,
    once each. What is settled leaves, so rounds shrink; a hub's edges become one after its first round.
    Once ``SMALL`` edges are left, one task finishes them. A table for each round says which root a node went to,
    and the tables are joined from the last, smallest, to the first.
    """
    spark = edges.sparkSession
    known = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    current, path = stash(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    layers: list[tuple[DataFrame, str]] = []
    for _ in range(most_rounds):
        if current.count() <= SMALL:
            layers.append(stash(_finished(current), "roots"))
            break
        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        layer = _roots(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up")), most_rounds)
        layers.append(layer)
        side = lambda x, t=layer[0]: t.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}"))
        further = current.where("a <> b").join(side("a"), "a").join(side("b"), "b").where("up_a <> up_b")
        new, new_path = stash(further.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges")
        discard(spark, path)
        current, path = new, new_path
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    labels = layers[-1][0]
    for layer, _ in layers[-2::-1]:
        above = labels.select(F.col("node").alias("at"), F.col("up").alias("root"))
        labels = layer.join(above, F.col("up") == F.col("at"), "left").select("node", F.coalesce("root", "up").alias("up"))
    out, _ = stash(labels.select("node", F.col("up").alias("component")), "labels")
    discard(spark, path, *[p for _, p in layers])
    return out
