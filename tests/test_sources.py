"""Readers and writers on small files, sound and unsound."""

import time

import pytest
from pyspark.sql import functions as F

from strandframe.functions import cigar, naming, sequence
from strandframe.operators import assembly, evaluation
from strandframe.sources import shared, text, writers

GFA = "H\tVN:Z:1.0\nS\ta\tACGT\nS\tb\tGG\nS\te\t\nL\ta\t+\tb\t-\t2M\nL\tb\t-\te\t+\t*\nP\tp\ta+,b-,e+\t2M,0M\n"


def put(tmp_path, name, content):
    f = tmp_path / name
    f.write_text(content)
    return str(f)


def test_cache_follows_the_file(spark, tmp_path):
    path, cache = put(tmp_path, "g.gfa", GFA), str(tmp_path / "cache")
    segments, links, steps = text.read_gfa_cached(spark, path, cache)
    assert (segments.count(), links.count(), steps.count()) == (3, 2, 3)
    assert {r.name: r.length for r in text.segment_lengths(segments).collect()} == {"a": 4, "b": 2, "e": 0}
    time.sleep(1.1)
    put(tmp_path, "g.gfa", GFA + "S\tz\tT\n")
    assert text.read_gfa_cached(spark, path, cache)[0].count() == 4


def test_unsound_graphs_are_reported(spark, tmp_path):
    sound = text.read_gfa(spark, put(tmp_path, "s.gfa", GFA))
    assert text.dangling(*sound).collect() == []
    bad = GFA + "S\ta\tT\nL\ta\t+\tnone\t+\t0M\nP\tq\ta+,e+\t0M\nP\tr\ta+,lost-\t0M\n"
    found = {tuple(r) for r in text.dangling(*text.read_gfa(spark, put(tmp_path, "b.gfa", bad))).collect()}
    assert found == {("link", "none"), ("step", "lost"), ("path", "q a e"), ("path", "r a lost"), ("segment", "a")}


def test_contacts_are_checked(spark, tmp_path):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    good = put(tmp_path, "c.csv", "name_a,name_b,weight\nb,a,5\na,b,7\nc,c,1\n")
    assert sorted(map(tuple, text.read_contacts(spark, good, names).collect())) == [("a", "b", 5), ("c", "c", 1)]
    for content, said in (("name_a,name_b,weight\na,x,5\n", "unknown node"), ("name_a,name_b,weight\na,b,5,6\n", "three fields")):
        with pytest.raises(Exception, match=said):
            text.read_contacts(spark, put(tmp_path, "bad.csv", content), names).collect()


def test_ids_bubbles_and_phases(spark, tmp_path):
    assert text.read_ids(spark, put(tmp_path, "i.csv", "1,a\n2,b\n")).count() == 2
    for bad in ("2,a\n3,b\n", "1,a\n1,b\n", "1,a\n2,a\n", "1,a\n3,b\n"):
        with pytest.raises(ValueError, match="one apart"):
            text.read_ids(spark, put(tmp_path, "bad.csv", bad))
    b = put(tmp_path, "b.csv", "Name,BubbleId,Phase,Color\nx.0,7,0,red\nx.1,7,1,blue\n")
    assert [tuple(r) for r in text.read_bubbles(spark, b).collect()] == [(7, "x.0", "x.1")]
    with pytest.raises(ValueError, match="not Phase"):
        text.read_bubbles(spark, put(tmp_path, "b2.csv", "Name,BubbleId,Side,Color\nx.0,7,0,red\n"))
    with pytest.raises(Exception, match="neither 0 nor 1"):
        text.read_bubbles(spark, put(tmp_path, "b3.csv", "Name,BubbleId,Phase,Color\nx.0,7,2,red\n")).collect()
    phases = text.read_csv(spark, put(tmp_path, "p.csv", "Name,Phase,Coverage,Length,Color\na,-1,1,1,x\nb,0,1,1,x\nc,1,1,1,x\n"), "phases")
    assert {tuple(r) for r in text.phase_sets(phases).collect()} == {("a", 0), ("c", 1)}
    assert {tuple(r) for r in text.read_phases(spark, put(tmp_path, "q.csv", "a,1\n\nb,-1\n")).collect()} == {("a", 1), ("b", -1)}
    assert [r.tokens for r in text.csv_tokens(spark, put(tmp_path, "t.csv", "a,b\n\nc")).orderBy("position").collect()] == [["a", "b"], ["c"]]


def test_alternatives_of_an_alignment_table(spark, tmp_path):
    t = text.read_csv(spark, put(tmp_path, "a.csv", "name_a,name_b,total_matches,symmetrical,color\na,b,9,1,x\nb,a,9,1,x\na,c,5,0,x\na,z,7,1,x\n"), "alignments")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert [tuple(r) for r in text.symmetrical_alts(t, nodes).collect()] == [("a", "b", 9)]


def test_sequences_are_checked(spark, tmp_path):
    f = text.fasta_records(spark, put(tmp_path, "f.fa", ">a one\nAC\nGT\n>b\nG\n"))
    assert {tuple(r) for r in text.fasta_lengths(f).collect()} == {("a", 4), ("b", 1)}
    with pytest.raises(Exception, match="more than once"):
        text.fasta_lengths(text.fasta_records(spark, put(tmp_path, "d.fa", ">a\nAC\n>a\nG\n"))).collect()
    k = put(tmp_path, "k.fa", ">1\nACG\n>2\nACG\n>3\nTTT\n")
    assert {tuple(r) for r in text.kmer_set(spark, k, "pat").collect()} == {("ACG", "pat"), ("TTT", "pat")}
    assert text.estimated_records(spark, k) == 3.0
    with pytest.raises(Exception, match="one length"):
        text.kmer_set(spark, put(tmp_path, "u.fa", ">1\nACG\n>2\nACGT\n"), "pat").collect()


def test_report_scans(spark, tmp_path):
    lines = lambda content: spark.createDataFrame([(x,) for x in content.split("\n") if x], "value string")
    bands = text.ideogram(lines("#chr\nchr1\t0\t10\tp1\tgpos50\nchr2\t5\t9\tacen")).collect()
    assert [(r.chrom, r.name, r.stain, r.colour) for r in bands] == [("chr1", "p1", "gpos50", "#808080"), ("chr2", None, "acen", "#D92F27")]
    assert [tuple(r) for r in text.asmgene_rows(lines("H\tMetric ref a\nX\tfull_sgl 30 29")).collect()] == [("full_sgl", 30, 29)]
    assert [r.qv for r in text.first_qv(lines("COMP 1\nQV 40.5 9\nQV 1 2")).collect()] == [40.5]
    (s,) = text.sv_scores(spark, put(tmp_path, "s.json", '{"precision": 0.5, "recall": 1.0, "f1": 0.66, "other": 3}')).collect()
    assert (s.precision, s.recall, s.f1) == (0.5, 1.0, 0.66)
    one = text.phasing_report(spark, put(tmp_path, "w.tsv", "#sample\tchromosome\tall_switch_rate\tblockwise_hamming_rate\tcovered_variants\nx\tchr1\t0.1\t0.2\t30\n"), "x")
    assert {(r.metric, r.value) for r in one.collect()} == {("all_switch_rate", 0.1), ("blockwise_hamming_rate", 0.2), ("covered_variants", 30.0)}
    assert evaluation.pivoted(one, ["x"]).where("metric = 'covered_variants'").first().x == 30.0


def test_long_paf_rows(spark):
    row = "\t".join(["q", "9", "0", "9", "+", "r", "9", "0", "9", "9", "9", "60"] + [f"x{i}:i:1" for i in range(1500)] + ["cg:Z:9="])
    (r,) = text.paf_alignments(spark.createDataFrame([(row,)], "value string")).collect()
    assert r.cigar == "9="


def test_writers_round_trip(spark, tmp_path):
    segments, links, steps = text.read_gfa(spark, put(tmp_path, "s.gfa", GFA))
    out = str(tmp_path / "gfa")
    writers.gfa_lines(segments, links, steps).write.text(out)
    again = text.read_gfa(spark, out)
    for a, b in zip((segments, links.replace("*", "0M", "cigar"), steps.drop("cigar_to_next")), (again[0], again[1], again[2].drop("cigar_to_next")), strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    contacts = spark.createDataFrame([("a", "b", 3), ("b", "b", 1)], "a string, b string, weight long")
    csv = str(tmp_path / "contacts")
    writers.write_csv(writers.contact_rows(contacts), csv)
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert sorted(map(tuple, text.read_contacts(spark, csv, names).collect())) == [("a", "b", 3), ("b", "b", 1)]
    with pytest.raises(Exception, match="exists"):
        writers.write_csv(writers.contact_rows(contacts), csv)
    both = [tuple(r) for r in writers.symmetric_contact_rows(contacts).collect()]
    assert sorted(both) == [("a", "b", 3), ("b", "a", 3), ("b", "b", 1)]
    ids = str(tmp_path / "ids")
    writers.write_csv(writers.id_rows(spark.createDataFrame([("z",), ("m",), ("a",), ("m",)], "name string")), ids, header=False)
    assert sorted(map(tuple, text.read_ids(spark, ids).collect())) == [(1, "a"), (2, "m"), (3, "z")]
    bubbles = spark.createDataFrame([(1, "x.0", "x.1")], "bubble_id long, node_0 string, node_1 string")
    at = str(tmp_path / "bubbles")
    writers.bubble_rows(bubbles).coalesce(1).write.option("header", True).csv(at)
    assert [tuple(r) for r in text.read_bubbles(spark, at).collect()] == [(1, "x.0", "x.1")]
    conf = {r.key: r.value for r in writers.config_rows(spark, {"min_mapq": 1, "rounds": 2}).collect()}
    assert conf == {"min_mapq": "1", "rounds": "2"}
    lists = writers.subgraph_rows(spark.createDataFrame([("a", "a", True), ("b", "a", True)], "node string, subgraph string, flag boolean"))
    assert [tuple(r) for r in lists[1].collect()] == [("a", "Tomato", 2)] and lists[0].count() == 2
    every = writers.alignment_rows(contacts.where("a <> b"), contacts.where("a <> b"), spark.createDataFrame([("a", 5), ("b", 2)], "name string, length long"))
    assert sorted((r.name_a, r.symmetrical, r.color) for r in every.collect()) == [("a", 0, "Cornflower Blue"), ("a", 1, "Cornflower Blue"), ("b", 0, "Tomato"), ("b", 1, "Tomato")]
    shapes = spark.createDataFrame([("line", 0, 0, 5, 5, 1, "red"), ("point", 2, 2, 0, 0, 3, "blue")], "kind string, x int, y int, x2 int, y2 int, size int, color string")
    drawn = [r.value for r in writers.svg(shapes, 10, 10).collect()]
    assert drawn[0].startswith("<svg") and drawn[-1] == "</svg>" and any("circle" in x for x in drawn) and len(drawn) == 4


def test_bad_letters_and_operations_are_errors(spark):
    d = spark.createDataFrame([("ACXT", "5M3Q", "3S2M")], "s string, c string, clipped string")
    for bad in (sequence.reverse_complement(F.col("s")), sequence.pack_2bit(F.col("s")), cigar.parse(F.col("c")), cigar.flipped(cigar.parse(F.col("clipped"))), cigar.summary(cigar.parse(F.lit("5M")))):
        with pytest.raises(Exception, match="letter|not 1 to 31|not a CIGAR|cannot be turned|no identity"):
            d.select(bad).collect()
    assert d.select(sequence.reverse_complement(F.lit("AACGTN")), sequence.unpack_2bit(sequence.pack_2bit(F.lit("GATTACA")), 7)).first()[:] == ("NACGTT", "GATTACA")


def test_colours_and_names(spark):
    d = spark.range(1)
    got = d.select(naming.rgb(F.lit("#FF8000")), naming.blended(F.lit("#FF0000"), F.lit("#FF0000")), naming.is_bubble(F.lit("p.1.0"), F.lit("p.1.1")), naming.is_bubble(F.lit("p.1.0"), F.lit("p.2.1")), naming.map_colour(F.lit(1.0))).first()
    assert got[0] == [255, 128, 0] and got[2] is True and got[3] is False and got[4] == "#B50526"


def test_overlaps_are_kept_from_either_end(spark):
    links = spark.createDataFrame([("a", False, "b", True, "3M1I"), ("b", True, "c", False, "*")], "node_a string, rev_a boolean, node_b string, rev_b boolean, cigar string")
    assert {tuple(r) for r in assembly.recorded_overlaps(links).collect()} == {("a", False, "b", True, "3M1I"), ("b", False, "a", True, "1D3M")}


def test_unzip_rewires_ends(spark):
    names = spark.createDataFrame([(n, "AC") for n in "xabyz"] + [("lone", "G")], "name string, sequence string")
    links = spark.createDataFrame([("x", False, "a", False, "0M"), ("a", False, "b", True, "0M"), ("b", True, "y", False, "0M"), ("y", False, "z", False, "0M")], "node_a string, rev_a boolean, node_b string, rev_b boolean, cigar string")
    steps = spark.createDataFrame([("p", 0, "a", False), ("p", 1, "b", True), ("q", 0, "y", False)], "path string, step_index int, node string, reversed boolean")
    s, ln, left = assembly.unzip(names, links, steps)
    assert {tuple(r) for r in s.collect()} == {("x", "AC"), ("z", "AC"), ("p", "ACGT"), ("q", "AC")}
    assert {tuple(r)[:4] for r in ln.collect()} == {("x", False, "p", False), ("p", False, "q", False), ("q", False, "z", False)}
    assert {tuple(r)[:3] for r in left.collect()} == {("p", 0, "p"), ("q", 0, "q")}
    assert "lone" in {r.name for r in assembly.unzip(names, links, steps, delete_islands=False)[0].collect()}
    assert "lone" in {r.name for r in assembly.unzip(names, links, steps.limit(0))[0].collect()}
    ring = spark.createDataFrame([("a", False, "a", False, "0M")], links.schema)
    one = spark.createDataFrame([("p", 0, "a", False)], steps.schema)
    assert {tuple(r)[:4] for r in assembly.unzip(names, ring, one)[1].collect()} == {("p", False, "p", False)}


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class X:
                    @staticmethod
                    def getCheckpointDir():
                        class No:
                            @staticmethod
                            def isDefined():
                                return False

                        return No

                return X

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
