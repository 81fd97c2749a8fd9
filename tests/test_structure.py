"""Graph formats and structure operators on hand-written graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import cigar, naming, sequence
from strandframe.operators import assembly, graph, kmers, phasing, structure
from strandframe.plans import pipelines
from strandframe.sources import text, writers

CHAIN = [("S", n, s) for n, s in zip("abcdefghijklm", ["A", "T", "A", "T", "TT", "AA", "TT", "AA", "GGGG", "CCCC", "GGGG", "CCCC", "GGGG"], strict=True)]
ORDER = ["i", "ab", "j", "cd", "k", "ef", "l", "gh", "m"]
CHAIN_LINKS = [(x, False, y, False) for u, v in zip(ORDER, ORDER[1:], strict=False) for x in u for y in v]
OVERLAPPED = [("11", False, "12", True), ("12", True, "13", False), ("11", False, "13", False)]
THREE = [("a", False, "b", False), ("b", False, "d", False), ("a", False, "c", False), ("c", False, "d", False), ("e", False, "f", False), ("g", False, "h", False)]


def halves(spark, links):
    return graph.half_edges(spark.createDataFrame(links, "node_a string, rev_a boolean, node_b string, rev_b boolean")).cache()


def nodes(spark, links):
    return spark.createDataFrame([(n,) for n in sorted({x for a, _, b, _ in links for x in (a, b)})], "node string")


@pytest.mark.parametrize(("links", "bridges", "parts"), [
    (CHAIN_LINKS, "ijklm", ["i", "m", "ghlm", "efkl", "cdjk", "abij"]),
    (THREE, "adefgh", ["abcd", "a", "d", "g", "h", "e", "f", "ef", "gh"]),
])
def test_bridges(spark, links, bridges, parts):
    h, n = halves(spark, links), nodes(spark, links)
    b = structure.bridge_nodes(h, n)
    assert sorted(r.node for r in b.collect()) == sorted(bridges)
    groups = {}
    for r in structure.bridge_components(h, n, b).collect():
        groups.setdefault(tuple(r.component), []).append(r.node)
    assert sorted("".join(sorted(g)) for g in groups.values()) == sorted(parts)


def test_bridges_over_reversed_links(spark):
    h, n = halves(spark, OVERLAPPED), nodes(spark, OVERLAPPED)
    assert sorted(r.node for r in structure.bridge_nodes(h, n).collect()) == ["11", "13"]


def test_bridges_against_removal():
    rng = random.Random(1)
    for _ in range(100):
        edges = [(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randint(1, 12))]

        def joined(skip, a, b, edges=edges):
            seen, todo = {a}, [a]
            while todo:
                v = todo.pop()
                for i, (x, y) in enumerate(edges):
                    if i != skip and v in (x, y):
                        w = y if v == x else x
                        if w not in seen:
                            seen.add(w)
                            todo.append(w)
            return b in seen

        assert structure.find_bridges(edges) == {i for i, (a, b) in enumerate(edges) if not joined(i, a, b)}


def test_walks():
    i, m = [("i", False)], [("m", False)]
    solved, path, prefix = structure.hamiltonian_path(CHAIN_LINKS, set("adeh"), i, m)
    assert (solved, "".join(n for n, _ in path), prefix) == (True, "iajdkelhm", 9)
    solved, path, prefix = structure.hamiltonian_path(CHAIN_LINKS, set("ad"), i, m)
    assert (solved, len(path), prefix) == (True, 9, 5)
    assert structure.hamiltonian_path(CHAIN_LINKS, set("adeh"), i, m, most_steps=10)[0] is False
    assert structure.hamiltonian_path(CHAIN_LINKS, set("abdeh"), i, m)[:2] == (True, [])
    assert structure.hamiltonian_path(OVERLAPPED, {"11", "13"}, [("13", True)], [("11", True)]) == (True, [("13", True), ("11", True)], 1)
    assert structure.hamiltonian_path([], set()) == (True, [], 0)


def test_alternatives():
    sides, refused = structure.merge_alts([(0, 1), (1, 2), (2, 3), (3, 4)])
    assert {n for n, (_, s) in sides.items() if s == sides[0][1]} == {0, 2, 4} and not refused
    assert structure.merge_alts([(0, 1), (1, 2), (2, 0)])[1] == [(2, 0)]


def test_colouring_and_bubbles(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10)], "a long, b long")
    got = {r.node: (r.component, r.side, r.bipartite) for r in graph.two_colouring(e).collect()}
    assert all(got[n] == (0, n % 2, True) for n in range(5)) and all(not got[n][2] for n in (10, 11, 12))
    b = graph.symmetric_bubbles(halves(spark, CHAIN_LINKS))
    assert sorted(r.node_0 + r.node_1 for r in b.collect()) == ["ab", "cd", "ef", "gh"]
    kinds = {r.node: r.kind for r in graph.chainable(halves(spark, CHAIN_LINKS), nodes(spark, CHAIN_LINKS)).collect()}
    assert all(kinds[n] == "diploid" for n in "abcdefgh") and all(kinds[n] == "haploid" for n in "ijklm")


def test_splice(spark):
    links = [("a", False, "x", False), ("x", False, "y", True), ("y", True, "b", False)]
    out = graph.splice_empty(spark.createDataFrame(links, "node_a string, rev_a boolean, node_b string, rev_b boolean"), spark.createDataFrame([("x",), ("y",)], "node string"))
    assert {tuple(r) for r in out.select("node", "side", "other", "other_side").collect()} == {("a", 1, "b", 0), ("b", 0, "a", 1)}


def test_gfa_round_trip_and_unzip(spark, tmp_path):
    lines = ["H\tVN:Z:1.0", "S\t11\tACCTT", "S\t12\tTCAAGG", "S\t13\tCTTGATT", "L\t11\t+\t12\t-\t4M", "L\t12\t-\t13\t+\t5M", "L\t11\t+\t13\t+\t3M", "P\tp-1\t11+,12-,13+\t4M,5M"]
    (tmp_path / "g.gfa").write_text("\n".join(lines) + "\n")
    segments, links, steps = text.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert {(r.node, r.step_index, r.reversed) for r in steps.collect()} == {("11", 0, False), ("12", 1, True), ("13", 2, False)}
    assert text.dangling(segments, links, steps).count() == 0
    assert assembly.unzip_sequences(steps, segments, links).first().sequence == "ACCTTGATT"
    out = [r.value for r in writers.gfa_lines(segments, links, steps).collect()]
    assert sorted(out[:-1]) == sorted(lines[:-1]) and out[-1] == "P\tp-1\t11+,12-,13+\t0M,0M"
    (tmp_path / "bad.gfa").write_text("P\tx\t1+,2+\t1M,2M\n")
    with pytest.raises(Exception, match="one overlap less"):
        text.read_gfa(spark, str(tmp_path / "bad.gfa"))[2].collect()


def test_other_formats(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:c1\tLN:100\nr1\t16\tc1\t11\t60\t3S5M2D4I1X2H\t*\nr2\t0\tc1\t1\t0\t*\t*")
    lines = spark.read.text(str(tmp_path / "a.sam"))
    assert [tuple(r) for r in text.sam_refs(lines).collect()] == [("c1", 100)]
    b = {r.query_name: r for r in text.alignment_blocks(text.sam_alignments(lines)).collect()}
    r = b["r1"]
    assert (r.n_matches, r.n_mismatches, r.n_inserts, r.n_deletes, r.ref_start, r.ref_stop, r.query_start, r.query_stop) == (5, 1, 4, 2, 10, 18, 2, 12)
    assert b["r2"].n_matches == 0
    (tmp_path / "a.fa").write_text(">x one\nACG\nT\n>y\n\n>z\nGG")
    assert sorted(tuple(r) for r in text.fasta_records(spark, str(tmp_path / "a.fa")).collect()) == [("x", "ACGT"), ("y", ""), ("z", "GG")]
    paf = spark.createDataFrame([("q\t10\t0\t9\t+\tr\t20\t1\t10\t8\t9\t60\ttp:A:P\tcg:Z:9M",)], "value string")
    assert text.paf_alignments(paf).first().cigar == "9M"
    v = spark.createDataFrame([("##contig=<ID=c1,length=9>",), ("#CHROM",), ("c1\t5\t.\tA\tC\t30.5\t.",)], "value string")
    contigs, records = text.vcf_positions(v)
    assert tuple(contigs.first()) == ("c1", 9) and tuple(records.first()) == ("c1", 5, 30.5)
    d = spark.createDataFrame([("a", "b", "3:2 60:1")], "name_a string, name_b string, dist string")
    assert [(r.mapq, r.n) for r in text.mapq_counts(d).orderBy("mapq").collect()] == [(3, 2), (60, 1)]
    rows = spark.createDataFrame([("a", "b", 60, 1), ("a", "b", 3, 2)], "a string, b string, mapq int, weight long")
    assert writers.stratified_rows(rows).first().dist == "3:2 60:1"


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    ops = lambda s: cigar.parse(F.lit(s))
    assert [(x.len, x.op) for x in value(ops("5M1D3I6X1="))] == [(5, "M"), (1, "D"), (3, "I"), (6, "X"), (1, "=")]
    assert value(ops("0M")) == [] and value(ops("*")) == []
    assert value(cigar.render(ops("2D5M"))) == "2D5M" and value(cigar.render(ops("*"))) == "0M"
    assert value(cigar.render(cigar.flipped(ops("2D5M1I")))) == "1D5M2I"
    assert value(sequence.reverse_complement(F.lit("ACCN"))) == "NGGT"
    assert value(sequence.canonical(F.lit("TTT"))) == "AAA"
    assert value(sequence.kmers(F.lit("ACGT"), 3)) == ["ACG", "CGT"] and value(sequence.kmers(F.lit("AC"), 3)) == []
    assert value(sequence.pack_2bit(F.lit("CAT"))) == 1 + 0 * 4 + 3 * 16
    assert value(naming.alt_name(F.lit("PR.0.1.36.0"))) == "PR.0.1.36.1" and value(naming.alt_name(F.lit("UR.0.2"))) is None
    assert abs(value(naming.binomial_p(F.lit(30), F.lit(12))) - 0.0805530935) < 1e-9
    assert value(naming.hex_colour(F.lit(1.0), F.lit(0.0), F.lit(0.5))) == "#FF0080"
    with pytest.raises(ValueError):
        sequence.kmers(F.lit("A"), 65)


def test_contact_phasing_finds_the_planted_partition(spark):
    rng = random.Random(3)
    reads, r = [], 0
    for _ in range(600):
        hap = rng.randrange(2)
        for _ in range(3):
            side = hap if rng.random() < 0.95 else 1 - hap
            reads.append((f"r{r}", f"b{rng.randrange(12)}.{side}", 60, 0))
        r += 1
    a = spark.createDataFrame(reads, "read string, contig string, mapq int, flag int")
    got = {x.node: x.partition for x in pipelines.phase_contacts(a, samples=4, iterations=20).collect()}
    assert len(got) == 24 and len({got[f"b{i}.0"] for i in range(12)}) == 1 and all(got[f"b{i}.0"] == -got[f"b{i}.1"] for i in range(12))
    again = {x.node: x.partition for x in pipelines.phase_contacts(a, samples=3, iterations=10, rounds=2).collect()}
    assert len({again[n] * got[n] for n in got}) == 1
    parts = spark.createDataFrame(list(got.items()), "node string, partition int")
    truth = spark.createDataFrame([(n, n[-1]) for n in got], "node string, reference string")
    assert all(x.hamming == 0 for x in pipelines.evaluate(parts, truth).collect())
    votes = phasing.orientation_votes(parts.withColumn("sample", F.lit(0)), spark.createDataFrame([("b0.0", "b0.1", 1)], "a string, b string, weight long")).first()
    assert (votes.n_different, votes.n_same) == (1, 0)


def test_merge_round():
    held = {"a": ("a", 0), "A": ("a", 1), "b": ("b", 0), "B": ("b", 1), "c": ("c", 0)}
    out = phasing.merge_round([("a", "b", 0, 5), ("A", "c", 5, 0), ("a", "c", 4, 1)], held, 5, {"a": 9, "b": 9})
    assert out == {"a": ("a", 0), "A": ("a", 1), "b": ("a", 0), "B": ("a", 1), "c": ("c", 0)}
    out = phasing.merge_round([("A", "c", 5, 0)], held, 5, {})
    assert out["c"] == ("a", 0) and out["b"] == ("b", 0)


def test_trio(spark):
    s = spark.createDataFrame([("c", 0, "AAAACCCC"), ("c", 1, "ACGTTGCA")], "component string, haplotype int, sequence string")
    p = spark.createDataFrame([("mat", "AAAAC"), ("pat", "GTTGC")], "parent string, kmer string")
    assert tuple(pipelines.phase_trio(s, p, 5).first()) == ("c", 0, 2, True)
    assert kmers.kmer_counts(s.limit(0), 5).collect() == []


def test_no_round_limit_leaves_nodes_out(spark, monkeypatch):
    from strandframe.operators import components, graph

    n = 44
    path = spark.range(n).selectExpr("id AS a", "id + 1 AS b").coalesce(1)
    assert {r.node: r.depth for r in graph.bfs(path, spark.createDataFrame([(0,)], "node long")).collect()} == {k: k for k in range(n + 1)}
    ring = [(0, 1), (1, 2), (2, 3), (3, 1), (3, 9)]
    links = spark.createDataFrame([(a, False, b, False) for a, b in ring], "node_a long, rev_a boolean, node_b long, rev_b boolean")
    empty = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    assert {tuple(r) for r in graph.splice_empty(links, empty).collect()} == {(0, 1, 9, 0), (9, 0, 0, 1)}
    long = spark.range(131).selectExpr("id AS node_a", "id % 3 = 0 AS rev_a", "id + 1 AS node_b", "(id + 1) % 3 = 0 AS rev_b")
    assert {tuple(r) for r in graph.splice_empty(long, spark.range(1, 131).selectExpr("id AS node")).collect()} == {(0, 0, 131, 0), (131, 0, 0, 0)}
    with pytest.raises(RuntimeError):
        graph.splice_empty(long, spark.range(1, 131).selectExpr("id AS node"), most_rounds=3)
    monkeypatch.setattr(components, "SMALL", -1)
    with pytest.raises(RuntimeError):
        components.connected_components(path, most_rounds=1)


@pytest.mark.parametrize("small", [0, 20, 100_000])
def test_components_against_search(spark, monkeypatch, small):
    from strandframe.operators import components
    from strandframe.operators.components import connected_components

    monkeypatch.setattr(components, "SMALL", small)

    rng = random.Random(17)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(400 + rng.randrange(40), 999) for _ in range(80)] + [(1000 - k, 1001 - k) for k in range(0, 60)] + [(5000, 5000), (None, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    pairs = spark.createDataFrame([(("a", 1), ("b", 0)), (("b", 0), ("a", 0)), (("z", 1), ("y", 1))], "a struct<n:string,s:int>, b struct<n:string,s:int>")
    assert {(tuple(r.node), tuple(r.component)) for r in connected_components(pairs).collect()} == {(x, ("a", 0)) for x in (("a", 0), ("a", 1), ("b", 0))} | {(x, ("y", 1)) for x in (("y", 1), ("z", 1))}


def test_refused_alternatives_are_listed(spark):
    from strandframe.operators.structure import alt_components, refused_alts

    alts = spark.createDataFrame([("a", "b", 5), ("b", "c", 4), ("c", "a", 3), ("x", "y", 1)], "a string, b string, weight long")
    assert sorted(map(tuple, alt_components(alts).collect())) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 0), ("x", "x", 0), ("y", "x", 1)]
    assert [tuple(r) for r in refused_alts(alts).collect()] == [("c", "a", "a")]


def test_qualities_beyond_the_grid_are_counted(spark):
    from strandframe.operators import contacts

    h = spark.createDataFrame([(10, 2), (254, 3)], "mapq int, n long")
    got = {r.mapq: r.at_least for r in contacts.reverse_cdf(h, "mapq", 0, 60).collect()}
    assert (got[0], got[11], got[254], len(got)) == (5, 3, 3, 255)
    by = spark.createDataFrame([("a", "b", 200, 7)], "a string, b string, mapq int, weight long")
    parts = spark.createDataFrame([("a", 1), ("b", 1)], "node string, partition int")
    assert [r.consistent for r in contacts.phase_signal(by, parts, 0, 60).orderBy("mapq").collect()] == [7] * 201
