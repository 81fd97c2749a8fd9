"""Pipelines from files to files, the aligner, and searches, on small inputs with known answers."""

import random

import pytest

from strandframe.operators import alignment, evaluation, phasing
from strandframe.plans import pipelines
from strandframe.sources import text


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def mutated(rng, s, share):
    return "".join(rng.choice("ACGT".replace(c, "")) if rng.random() < share else c for c in s)


def test_alignments_of_either_strand():
    rng = random.Random(1)
    a = dna(rng, 3000)
    b = mutated(rng, a[500:2500], 0.02)
    ((s, e, qs, qe, reverse, n, identity),) = alignment.aligned(a, b)
    assert abs(s - 500) < 60 and abs(e - 2500) < 60 and (qs < 60 and qe > 1940) and not reverse and n > 1800 and identity > 0.9
    turned = b[::-1].translate(str.maketrans("ACGT", "TGCA"))
    ((_, _, _, _, reverse, m, _),) = alignment.aligned(a, turned)
    assert reverse and m == n
    assert alignment.aligned(a, dna(rng, 2000)) == [] and alignment.aligned("", "ACGT") == []
    moved = a[:800] + dna(rng, 700) + a[1700:]
    assert sum(x[5] for x in alignment.aligned(a, moved, band=50)) >= 2000


def test_seeds_are_maximal_matches():
    rng = random.Random(2)
    a, b = dna(rng, 400), None
    b = a[:150] + dna(rng, 30) + a[200:]
    for i, j, n in alignment.seeds(a, b, 12):
        assert a[i : i + n] == b[j : j + n] and n >= 12
        assert i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n]


def test_homologous_alternatives(spark):
    rng = random.Random(3)
    base = [dna(rng, 1200) for _ in range(3)]
    rows = [(f"c{i}x", s) for i, s in enumerate(base)] + [(f"c{i}y", mutated(rng, s, 0.01)) for i, s in enumerate(base)]
    sequences = spark.createDataFrame(rows, "name string, sequence string")
    candidates = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "a string, b string")
    got = {}
    for r in alignment.homologous_alts(candidates, sequences).collect():
        got.setdefault(r.component, set()).add((r.node, r.side))
    assert got == {f"c{i}x": {(f"c{i}x", 0), (f"c{i}y", 1)} for i in range(3)}


@pytest.fixture(scope="module")
def bubbles():
    """A chain of four bubbles: segments, links, and reads that link alleles of one phase."""
    rng = random.Random(5)
    seq = {}
    links = []
    for k in range(5):
        seq[f"m{k}"] = dna(rng, 60)
    truth = {}
    for k in range(4):
        one = dna(rng, 90)
        flip = rng.random() < 0.5
        for side in (0, 1):
            name = f"PR.{k}.{side}"
            seq[name] = one if side == 0 else mutated(rng, one, 0.2)
            truth[name] = side ^ flip
            links += [(f"m{k}", name), (name, f"m{k + 1}")]
    return seq, links, truth


def gfa(seq, links, paths=()):
    return "".join(["H\tVN:Z:1.0\n", *[f"S\t{n}\t{s}\n" for n, s in seq.items()], *[f"L\t{a}\t+\t{b}\t+\t0M\n" for a, b in links], *[f"P\t{p}\t{','.join(x + '+' for x in n)}\t{','.join(['0M'] * (len(n) - 1)) or '*'}\n" for p, n in paths]])


def sam(truth, rng):
    names = sorted(truth)
    rows = ["@HD\tVN:1.6"]
    for r in range(400):
        a, b = rng.sample(names, 2)
        if truth[a] == truth[b] or rng.random() < 0.05:
            rows += [f"r{r}\t0\t{x}\t1\t30\t9M\t*\t0\t0\t*\t*" for x in (a, b)]
    return "\n".join(rows) + "\n"


def fastas(spark, path, key):
    found = {}
    for r in spark.read.text(path).select("value", key).collect():
        found.setdefault(r[key], []).append(r.value)
    return {k: [x for x in v if not x.startswith(">")] for k, v in found.items()}


@pytest.mark.parametrize("chain", ["hamiltonian", "simple"])
def test_contact_phasing_from_files_to_files(spark, tmp_path, bubbles, chain):
    seq, links, truth = bubbles
    (tmp_path / "g.gfa").write_text(gfa(seq, links))
    (tmp_path / "a.sam").write_text(sam(truth, random.Random(6)))
    out = str(tmp_path / "out")
    pipelines.phase_assembly_files(spark, str(tmp_path / "g.gfa"), str(tmp_path / "a.sam"), out, samples=4, iterations=20, rounds=1, chain=chain, least_phased=0.0)
    phases = {r.Name: r.Phase for r in text.read_csv(spark, f"{out}/phases", "phases").collect()}
    same = {phases[n] * (2 * truth[n] - 1) for n in truth}
    assert len(same) == 1 and same <= {-1, 1}
    want = set()
    for p in (0, 1):
        parts = []
        for k in range(5):
            parts.append(seq[f"m{k}"])
            parts += [seq[n] for n in truth if k < 4 and n.startswith(f"PR.{k}.") and truth[n] == p]
        want.add("".join(parts))
    got = fastas(spark, f"{out}/fasta", "phase")
    turn = lambda s: min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))
    assert {turn(s) for k in ("phase_0", "phase_1") for s in got[k]} == {turn(s) for s in want}
    whole = text.read_gfa(spark, f"{out}/unzipped")
    assert whole[0].count() == 2 and text.read_gfa(spark, f"{out}/chained")[2].select("path").distinct().count() == 2
    assert spark.read.option("header", True).csv(f"{out}/config").where("key = 'rounds'").first().value == "1"
    with pytest.raises(Exception, match="exists"):
        pipelines.phase_assembly_files(spark, str(tmp_path / "g.gfa"), str(tmp_path / "a.sam"), out, samples=1, iterations=1)


def test_contact_phasing_needs_contacts(spark, tmp_path, bubbles):
    seq, links, truth = bubbles
    (tmp_path / "g.gfa").write_text(gfa(seq, links))
    (tmp_path / "a.sam").write_text("@HD\n")
    with pytest.raises(ValueError, match="no contact"):
        pipelines.phase_assembly_files(spark, str(tmp_path / "g.gfa"), str(tmp_path / "a.sam"), str(tmp_path / "none"))


def test_trio_phasing_from_files_to_files(spark, tmp_path, bubbles):
    seq, links, truth = bubbles
    paths = [(f"{k}.{side}", [f"PR.{k}.{side}"]) for k in range(4) for side in (0, 1)]
    seq = dict(seq) | {"extra": dna(random.Random(8), 300)}
    (tmp_path / "g.gfa").write_text(gfa(seq, links, paths))
    kmers = {p: {seq[n][i : i + 13] for n in truth if truth[n] == p for i in range(len(seq[n]) - 12)} for p in (0, 1)}
    kmers[0] |= {seq["extra"][i : i + 13] for i in range(280)}
    for p, name in ((0, "pat"), (1, "mat")):
        (tmp_path / f"{name}.fa").write_text("".join(f">{i}\n{k}\n" for i, k in enumerate(sorted(kmers[p] - kmers[1 - p]))))
    out = str(tmp_path / "out")
    pipelines.phase_trio_files(spark, str(tmp_path / "g.gfa"), str(tmp_path / "pat.fa"), str(tmp_path / "mat.fa"), 13, out, min_length=200)
    got = fastas(spark, f"{out}/fasta", "parent")
    for p, name in ((0, "pat"), (1, "mat")):
        parts = []
        for k in range(5):
            parts.append(seq[f"m{k}"])
            parts += [seq[n] for n in truth if k < 4 and n.startswith(f"PR.{k}.") and truth[n] == p]
        whole = "".join(parts)
        assert whole in got[name] or whole[::-1].translate(str.maketrans("ACGT", "TGCA")) in got[name]
    assert seq["extra"] in got["pat"]  # rescued by its own k-mers
    with pytest.raises(ValueError, match="from 4 to 64"):
        pipelines.phase_trio_files(spark, str(tmp_path / "g.gfa"), str(tmp_path / "pat.fa"), str(tmp_path / "mat.fa"), 65, str(tmp_path / "x"))


def test_contact_map_of_a_file(spark, tmp_path, bubbles):
    _, _, truth = bubbles
    (tmp_path / "a.sam").write_text("r\t0\tx\t1\t30\t9M\nr\t0\ty\t1\t20\t9M\nr\t256\tz\t1\t20\t9M\ns\t0\ty\t1\t9\t9M\ns\t0\tx\t1\t40\t9M\n")
    pipelines.contact_map_files(spark, str(tmp_path / "a.sam"), str(tmp_path / "map"))
    assert [r.value for r in spark.read.text(str(tmp_path / "map")).collect()] == ["x,y,9:1 20:1"]


def test_legacy_searches(spark):
    rng = random.Random(9)
    side = {i: rng.choice((-1, 1)) for i in range(12)}
    contacts = [(a, b, 6 if side[a] == side[b] else 1) for a in range(12) for b in range(a + 1, 12) if a // 2 != b // 2]
    pairs = [(2 * k, 2 * k + 1) for k in range(6)]
    for a, b in pairs:
        side[b] = -side[a]
    contacts = [(a, b, 6 if side[a] == side[b] else 1) for a in range(12) for b in range(a + 1, 12) if a // 2 != b // 2]
    c = spark.createDataFrame(contacts, "a long, b long, weight long")
    best = {r.node: r.partition for r in phasing.best_sample(phasing.phase_tripartition(c, spark.createDataFrame(pairs, "a long, b long"), 2, 30)).collect()}
    assert len({best[n] * side[n] for n in best}) == 1 and 0 not in best.values()
    score = sum(w * side[a] * side[b] for a, b, w in contacts)
    assert phasing.total_consistency(c, spark.createDataFrame(list(best.items()), "node long, partition int")).first().score == score
    bubbles = spark.createDataFrame([(n, n // 2, n % 2) for n in range(12)], "node long, bubble long, side int")
    flips = {r.bubble: r.flipped for r in phasing.best_sample(phasing.phase_bubbles(phasing.bubble_consistency(c, bubbles), 2, 50)).collect()}
    assert len({(side[2 * k] == 1) ^ bool(flips[k]) for k in range(6)}) == 1


def test_graphs_that_do_not_fit_are_refused(spark, monkeypatch):
    monkeypatch.setattr(phasing, "MOST_ROWS", 3)
    c = spark.createDataFrame([(i, i + 1, 1) for i in range(9)], "a long, b long, weight long")
    with pytest.raises(ValueError, match="do not fit"):
        phasing.sample_partitions(c, spark.createDataFrame([], "node long, component long, side int"))


def test_search_by_parts(spark, monkeypatch):
    """A graph of more rows than a search may hold, none of which comes to the driver, is searched where its parts fit."""
    monkeypatch.setattr(phasing, "MOST_ROWS", 30)
    monkeypatch.setattr(phasing, "PART", 2)
    monkeypatch.delattr(type(spark.range(1)), "toPandas")
    rng, side, rows = random.Random(4), {}, []
    for part in range(5):
        names = [f"{part}.{u}.{p}" for u in range(4) for p in (0, 1)]
        side |= {n: (-1) ** (int(n[-1]) + (rng.random() < 0.5 if n[-1] == "0" else 0)) for n in names}
        side |= {f"{n[:-1]}1": -side[n] for n in names if n[-1] == "0"}
        rows += [(a, b, 9 if side[a] == side[b] else 1) for a in names for b in names if a < b and a[:-1] != b[:-1]]
    c = spark.createDataFrame([*rows, ("6.0.0", "6.0.1", 5)], "a string, b string, weight long")
    alts = spark.createDataFrame([(n, n[:-2], int(n[-1])) for n in [*side, "6.0.0", "6.0.1"]], "node string, component string, side int")
    got = {r.node: r.partition for r in phasing.phase(c, alts, 3, 20).collect()}
    assert set(got) == {*side, "6.0.0", "6.0.1"} and got["6.0.0"] == -got["6.0.1"]
    for part in range(5):
        assert len({got[n] * side[n] for n in side if n[0] == str(part)}) == 1
    best = sum(w if side[a] == side[b] else -w for a, b, w in rows) - 5
    samples = phasing.sample_partitions(c, alts, 3, 20).collect()
    assert len(samples) == 3 * len(got) and max(r.score for r in samples) == best


def test_bubble_phasing_by_names(spark):
    rows = []
    for r in range(60):
        p = r % 2
        rows += [(f"r{r}", f"a.{p}", 30, 0, 1), (f"r{r}", f"b.{1 - p}", 30, 0, 1)]
    a = spark.createDataFrame(rows, "read string, contig string, mapq int, flag int, position int")
    got = {r.node: r.phase for r in pipelines.phase_bubbles(a, samples=2, iterations=5).collect()}
    assert got["a.0"] != got["a.1"] and got["a.0"] == got["b.1"] and got["a.1"] == got["b.0"]


def test_rephasing_of_tables(spark):
    contacts = spark.createDataFrame([("a0", "b1", 9), ("a1", "b0", 9), ("a0", "b0", 1), ("a0", "a1", 5)], "a string, b string, weight long")
    alignments = spark.createDataFrame([("a0", "a1", 50, 1, "x"), ("a1", "a0", 50, 1, "x"), ("b0", "b1", 40, 1, "x")], "name_a string, name_b string, total_matches long, symmetrical int, color string")
    ids = spark.createDataFrame([(i, n) for i, n in enumerate(("a0", "a1", "b0", "b1"))], "id long, name string")
    got = {r.node: r.partition for r in pipelines.rephase(contacts, alignments, ids, 2, 5, 1).collect()}
    assert got["a0"] == got["b1"] == -got["a1"] == -got["b0"]


def test_phases_against_truth(spark):
    rows = lambda pairs: spark.createDataFrame([(n, 0, ref, 30, c, i) for i, (n, ref, c) in enumerate(pairs)], "query_name string, flag int, ref_name string, mapq int, cigar string, position long")
    pat = rows([("x", "p1", "90=10X"), ("y", "p1", "50=50X"), ("x", "p2", "10="), ("z", "p9", "9=")])
    mat = rows([("x", "m1", "50=50X"), ("y", "m1", "100="), ("w", "m1", "8=")])
    lengths = spark.createDataFrame([("x", 100), ("y", 50), ("z", 9), ("w", 8)], "name string, length long")
    phases = spark.createDataFrame([("x", -1), ("y", -1), ("z", 1)], "Name string, Phase int")
    sets, table = pipelines.evaluate_phasing(phases, pat, mat, lengths)
    assert sorted(map(tuple, sets.collect())) == [("x", 0, 0, "p2"), ("y", 1, 0, "m1")]
    assert sorted(map(tuple, table.collect())) == [("m1", 0, 50, 0.0), ("p2", 100, 0, 0.0)]
    assert evaluation.disjoint(lengths, spark.createDataFrame([("q",)], "name string"))
