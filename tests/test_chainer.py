"""Haplotype paths on hand-written graphs, and paths' operators."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import chainer, graph, paths
from strandframe.operators.structure import flip


def built(spark, links, lengths=None):
    nodes = sorted({x for a, _, b, _ in links for x in (a, b)} | set(lengths or ()))
    halves = graph.half_edges(spark.createDataFrame(links, "node_a string, rev_a boolean, node_b string, rev_b boolean"))
    return halves, spark.createDataFrame([(n, (lengths or {}).get(n, 4)) for n in nodes], "node string, length long")


def chained(spark, links, pairs, zero, least=0.0, lengths=None):
    """Paths as text, read in the direction that begins with the smaller end."""
    halves, nodes = built(spark, links, lengths)
    alts = spark.createDataFrame([(n, min(p)) for p in pairs for n in p] or [("-", "-")], "node string, component string")
    phases = spark.createDataFrame([(n, -1 if n in zero else 1) for p in pairs for n in p] or [("-", 0)], "node string, partition int")
    out = {}
    for r in chainer.chain_haplotypes(halves, nodes, alts, phases, least).orderBy("path", "step").collect():
        out.setdefault((r.path, r.phase), []).append((r.node, r.reversed))
    told = []
    for (_, p), walk in out.items():
        walk = min(walk, [flip(h) for h in reversed(walk)])
        told.append((p, " ".join(n + "-" * r for n, r in walk)))
    return sorted(told)


def plain(text):
    """Links of ``a>b`` words, all forward; a minus behind a name turns it."""
    out = []
    for word in text.split():
        a, b = word.split(">")
        out.append((a.rstrip("-"), a.endswith("-"), b.rstrip("-"), b.endswith("-")))
    return out


CHAIN = plain("i>a i>b a>j b>j j>c j>d c>k d>k k>e k>f e>l f>l l>g l>h g>m h>m")


def test_whole_chain(spark):
    pairs = [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")]
    assert chained(spark, CHAIN, pairs, "adfg") == [(0, "i a j d k f l g m"), (1, "i b j c k e l h m")]


def test_unphased_bubble_breaks_the_chain(spark):
    assert chained(spark, CHAIN, [("a", "b"), ("c", "d"), ("g", "h")], "adg") == [(0, "i a j d k"), (0, "l g m"), (1, "i b j c k"), (1, "l h m")]


def test_components_without_phases_have_no_paths(spark):
    assert chained(spark, plain("a>b b>d a>c c>d e>f g>h"), [("b", "c")], "b") == [(0, "a b d"), (1, "a c d")]
    assert chained(spark, plain("a>b b>d a>c c>d"), [], "") == []


def test_turned_nodes(spark):
    links = plain("a>b- a>c b->d- c>d- d->e d->f- e>g f->g")
    assert chained(spark, links, [("b", "c"), ("e", "f")], "bf") == [(0, "a b- d- f- g"), (1, "a c d- e g")]


def test_long_bridges_and_open_ends(spark):
    links = plain("x>y y>a y>b a>z b>z z>w w>v v>c v>d")
    assert chained(spark, links, [("a", "b"), ("c", "d")], "ad") == [(0, "d- v- w- z- a- y- x-"), (1, "c- v- w- z- b- y- x-")]


def test_partners_elsewhere_forbid_phasing(spark):
    links = plain("a>b b>d a>c c>d p>q q>r")
    assert chained(spark, links, [("b", "c", "q")], "b") == []
    assert chained(spark, plain("a>b b>d a>c c>d"), [("b", "c", "q")], "bq", lengths={"q": 3}) == [(0, "a b d"), (1, "a c d")]


def test_ring_of_bubbles_ends(spark):
    links = plain("i>a i>b a>j b>j j>c j>d c>i d>i")
    assert chained(spark, links, [("a", "b"), ("c", "d")], "ac") == []  # no bridge, and no walk that all share
    halves = {(a, 1, b, 0) for a, _, b, _ in links} | {(b, 0, a, 1) for a, _, b, _ in links}
    nodes = [(n, 4, {"a": "a", "b": "a", "c": "c", "d": "c"}.get(n), int(n in "bd"), False) for n in "ijabcd"]
    got = chainer.phase_paths(list(halves), nodes, 0.0, 1)  # bubbles by themselves, in a row that closes; loops are cut
    assert sorted(p for p, _ in got) == sorted([0, 1] * (len(got) // 2)) and {h[0] for p, w in got for h in w} == set("ijabcd")
    assert all(len({h[0] for h in w}) == len(w) for _, w in got)


def test_paths_with_little_phased_sequence_go(spark):
    links = plain("x>a x>b a>y b>y")
    assert chained(spark, links, [("a", "b")], "a", 0.1, {"x": 1000, "y": 1000, "a": 5, "b": 5}) == []
    assert len(chained(spark, links, [("a", "b")], "a", 0.1, {"x": 10, "y": 10, "a": 50, "b": 5})) == 2  # one hangs on the other


def test_random_chains_are_spelled(spark):
    rng = random.Random(4)
    for _ in range(3):
        links, pairs, want, last = [], [], {0: ["n0"], 1: ["n0"]}, "n0"
        for k in range(1, rng.randint(4, 9)):
            node = f"n{k}"
            if rng.random() < 0.6:
                a, b = f"p{k}", f"q{k}"
                links += [(last, False, x, False) for x in (a, b)] + [(x, False, node, False) for x in (a, b)]
                pairs.append((a, b))
                want[0].append(a)
                want[1].append(b)
            else:
                links.append((last, False, node, False))
            want[0].append(node)
            want[1].append(node)
            last = node
        zero = {p[0] for p in pairs}
        got = chained(spark, links, pairs, zero)
        inside = lambda p: [n for n in want[p] if n[0] in "pq"]
        for p in (0, 1):
            (walk,) = [w.replace("-", "").split() for q, w in got if q == p] or [[]]
            walk = walk if not walk or walk[0] < walk[-1] or walk[0] == "n0" else walk[::-1]
            assert [n for n in walk if n[0] in "pq"] in (inside(p), inside(p)[::-1])
            assert " ".join(walk) in " ".join(want[p]) or " ".join(walk[::-1]) in " ".join(want[p])


STEPS = [("p", 0, "i", False), ("p", 1, "a", False), ("p", 2, "j", False), ("q", 0, "i", False), ("q", 1, "b", True), ("q", 2, "j", False), ("r", 0, "z", False)]
SEGMENTS = [("i", "ACGT"), ("a", "TTG"), ("b", "CCA"), ("j", "GATTACA"), ("z", "ACGTACG")]


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame(STEPS, "path string, step_index int, node string, reversed boolean")


@pytest.fixture(scope="module")
def segments(spark):
    return spark.createDataFrame(SEGMENTS, "name string, sequence string")


def test_partners_of_paths(spark, steps):
    assert {r.path: r.partner for r in paths.partners(steps).collect()} == {"p": "q", "q": "p", "r": None}
    third = steps.unionAll(spark.createDataFrame([("s", 0, "i", False)], steps.schema))
    with pytest.raises(Exception, match="more than one other"):
        paths.partners(third).collect()


@pytest.mark.parametrize("k", [1, 3, 5])
def test_haplotype_kmers(spark, steps, segments, k):
    spelled = {"p": [("ACGT", False), ("TTG", True), ("GATTACA", False)], "q": [("ACGT", False), ("TGG", True), ("GATTACA", False)], "r": [("ACGTACG", True)]}
    want = []
    for path, parts in spelled.items():
        s, own, at = "".join(x for x, _ in parts), set(), 0
        for x, specific in parts:
            own |= set(range(at, at + len(x))) if specific else set()
            at += len(x)
        want += [(path, i, s[i : i + k]) for i in range(len(s) - k + 1) if own & set(range(i, i + k))]
    assert sorted(map(tuple, paths.haplotype_kmers(steps, segments, k).collect())) == sorted(want)


def test_kmer_positions_either_strand(spark, steps, segments):
    parental = spark.createDataFrame([("pat", "CAA"), ("mat", "TGG")], "parent string, kmer string")
    spelled = {"p": "ACGTTTGGATTACA", "q": "ACGTTGGGATTACA", "r": "ACGTACG"}
    want = [(p, i, s[i : i + 3] in ("CAA", "TTG"), s[i : i + 3] in ("TGG", "CCA")) for p, s in spelled.items() for i in range(len(s) - 2) if s[i : i + 3] in ("CAA", "TTG", "TGG", "CCA")]
    assert sorted(map(tuple, paths.kmer_positions(steps, segments, parental, 3).collect())) == sorted(want) and len(want) == 4
    assert [r.path for r in paths.kmer_positions(steps, segments, parental, 3, 15).collect()] == []


def test_extension_by_unique_neighbours(spark):
    halves = graph.half_edges(spark.createDataFrame(plain("x>i i>a j>y- j>w"), "node_a string, rev_a boolean, node_b string, rev_b boolean"))
    s = spark.createDataFrame([("p", 0, "i", False), ("p", 1, "a", False), ("t", 0, "y", False)], "path string, step_index int, node string, reversed boolean")
    got = sorted(tuple(r) for r in paths.extended(s, halves).where("added").collect())
    assert got == [("p", -1, "x", False, True), ("t", 1, "j", True, True)]
    assert [tuple(r)[:2] for r in paths.diploid_by_ends(s, halves).collect()] == []


def test_shares_colours_and_singletons(spark, steps):
    lengths = steps.withColumn("length", F.length("node") * 10)
    phased = spark.createDataFrame([("a",), ("z",)], "node string")
    assert {r.path: round(r.share, 3) for r in paths.phased_share(lengths, phased).collect()} == {"p": 0.333, "q": 0.0, "r": 1.0}
    assert {r.path for r in paths.purged(lengths, phased).collect()} == {"p", "r"}
    nodes = spark.createDataFrame([(n,) for n in "iabjzy"], "node string")
    colours = {r.node: (r.n_paths, r.colour) for r in paths.node_colours(steps, nodes, F.col("path")).collect()}
    assert colours["y"] == (0, "#AAAAAA") and colours["a"] == (1, "p") and colours["i"] == (2, "p/q")
    one, more = paths.split_singletons(paths.provenance(steps))
    assert [r.path for r in one.collect()] == ["r"] and {r.nodes for r in more.collect()} == {"i+ a+ j+", "i+ b- j+"}
