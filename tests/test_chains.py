"""Chains, their haplotype paths and the choice of overlaps, on hand-written graphs."""

import pytest

from strandframe.operators import chains
from test_structure import CHAIN_LINKS, ORDER, THREE, halves, nodes


def layers_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.chain, {}).setdefault(r.layer, set()).add(r.node)
    return {c: ["".join(sorted(x[i])) for i in sorted(x)] for c, x in out.items()}


def test_chain_in_order(spark):
    got = chains.chains(halves(spark, CHAIN_LINKS), nodes(spark, CHAIN_LINKS)).collect()
    assert layers_of(got) == {"a": ORDER}
    assert not any(r.reversed for r in got)
    assert layers_of(chains.chains(halves(spark, THREE), nodes(spark, THREE)).collect()) == {"a": ["a", "bc", "d"], "e": ["e", "f"], "g": ["g", "h"]}


def test_turned_nodes(spark):
    turned = [(a, a in "ajb", b, b in "ajb") for a, _, b, _ in CHAIN_LINKS]
    got = chains.chains(halves(spark, turned), nodes(spark, turned))
    assert layers_of(got.collect()) == {"a": ORDER}
    assert sorted(r.node for r in chains.to_flip(got).collect()) == ["a", "b", "j"]


def test_paths_break_where_alleles_have_no_phase(spark):
    layers = chains.chains(halves(spark, CHAIN_LINKS), nodes(spark, CHAIN_LINKS))
    phases = spark.createDataFrame([("a", -1), ("b", 1), ("c", 1), ("d", -1), ("e", 0), ("f", 1), ("g", -1), ("h", 1)], "node string, partition int")
    paths = {}
    for r in sorted(chains.chain_paths(layers, phases).collect(), key=lambda r: (r.path, r.step)):
        paths[r.path] = paths.get(r.path, "") + r.node
    assert paths == {"a.1.0": "iajdk", "a.1.1": "ibjck", "a.2.0": "lgm", "a.2.1": "lhm"}


@pytest.mark.parametrize(("edges", "kept"), [
    ([("x", "y", 90)], [("x", "y", 90)]),
    ([("x", "y", 90), ("x", "z", 80)], [("x", "y", 90)]),  # x is nearly covered by y already
    ([("x", "y", 10)], []),  # too little of either
    ([("x", "y", 50), ("x", "z", 50), ("y", "z", 50)], [("x", "y", 50), ("x", "z", 50), ("y", "z", 50)]),  # one a pass
    ([], []),
])
def test_select_overlaps(edges, kept):
    assert sorted(chains.select_overlaps(edges, dict.fromkeys("xyz", 100), 0.2)) == kept


def test_best_overlaps_keep_components_apart(spark):
    e = spark.createDataFrame([("x", "y", 90), ("y", "x", 90), ("p", "q", 70), ("p", "p", 99)], "a string, b string, weight int")
    n = spark.createDataFrame([(c, 100) for c in "xypq"], "node string, length int")
    assert sorted(map(tuple, chains.best_overlaps(e, n).collect())) == [("p", "q", 70), ("x", "y", 90)]


def test_non_overlapping_matches(spark):
    b = spark.createDataFrame([("q", 0, 100, 90, 0.9), ("q", 50, 80, 30, 1.0), ("q", 100, 150, 50, 1.0), ("r", 5, 6, 1, 1.0)], "name string, ref_start int, ref_stop int, n_matches int, identity double")
    assert sorted(map(tuple, chains.non_overlapping_matches(b, "name").collect())) == [("q", 170, 150), ("r", 1, 6)]
