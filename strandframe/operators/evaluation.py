"""What is measured on phasings, contacts and assemblies: truth by alignment, agreement with it, and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import cigar
from strandframe.functions.naming import binomial_p, is_bubble, log2_ratio


# Truth by alignment to both parents' references.
def cigar_summaries(alignments: DataFrame, indel_cap: int = 20) -> DataFrame:
    """(name, matches, mismatches, inserts, deletes, identity, reference) of primary rows of some quality; indels are capped each.

    ``alignments(query_name, flag, ref_name, mapq, cigar, position)``; the reference is that of the last row in the
    file that is not supplementary.
    """
    a = alignments.where((F.col("mapq") > 0) & (F.col("flag").bitwiseAND(256 | 4) == 0)).withColumn("s", cigar.summary(cigar.parse(F.col("cigar")), indel_cap))
    parts = ["matches", "mismatches", "inserts", "deletes"]
    last = F.max_by(F.when(F.col("flag").bitwiseAND(2048) == 0, F.col("ref_name")), F.when(F.col("flag").bitwiseAND(2048) == 0, F.col("position")))
    g = a.groupBy(F.col("query_name").alias("name")).agg(*[F.sum(f"s.{p}").alias(p) for p in parts], last.alias("reference"))
    return g.withColumn("identity", cigar.summary_identity(*[F.col(p) for p in parts]))


def assigned_phases(names: DataFrame, paternal: DataFrame, maternal: DataFrame, prefix: str = "") -> DataFrame:
    """(name, phase, pat_identity, mat_identity, pat_ref, mat_ref): 1 if the maternal identity is the greater, 0 if not, 2 if either is missing."""
    side = lambda s, x: s.select("name", F.col("identity").alias(f"{x}_identity"), F.col("reference").alias(f"{x}_ref"))
    j = names.where(F.startswith("name", F.lit(prefix))).select("name").join(side(paternal, "pat"), "name", "left").join(side(maternal, "mat"), "name", "left").fillna(0.0, ["pat_identity", "mat_identity"])
    phase = F.when((F.col("pat_identity") == 0) | (F.col("mat_identity") == 0), 2).when(F.col("mat_identity") > F.col("pat_identity"), 1).otherwise(0)
    return j.select("name", phase.alias("phase"), "pat_identity", "mat_identity", "pat_ref", "mat_ref")


def intersections(truth: DataFrame, inferred: DataFrame) -> DataFrame:
    """(name, truth, inferred, reference): phased names in both; where both sides agree, the paternal reference, else the maternal.

    ``truth`` is of ``assigned_phases``, ``inferred(name, side)``.
    """
    j = truth.where("phase IN (0, 1)").join(inferred, "name")
    return j.select("name", F.col("phase").alias("truth"), F.col("side").alias("inferred"), F.when(F.col("phase") == F.col("side"), F.col("pat_ref")).otherwise(F.col("mat_ref")).alias("reference"))


def hamming_by_reference(sets: DataFrame, lengths: DataFrame) -> DataFrame:
    """(reference, cis, trans, hamming): letters of names whose sides agree and disagree, the lesser over the greater."""
    at = lambda c: F.sum(F.when(c, F.col("length")).otherwise(0)).cast("long")
    same = F.col("truth") == F.col("inferred")
    g = sets.join(lengths.select("name", "length"), "name").groupBy("reference").agg(at(same).alias("cis"), at(~same).alias("trans"))
    return g.withColumn("hamming", F.least("cis", "trans") / F.nullif(F.greatest("cis", "trans"), F.lit(0)))


def phase_by_alignment(paternal: DataFrame, maternal: DataFrame, most_indel: int = 50) -> DataFrame:
    """(query, pat_nonmatch, mat_nonmatch, score, parent) of PAF rows against both parents.

    What does not match are mismatches and indels shorter than ``most_indel``; the score is log2 of the maternal
    over the paternal sum. The parent with less wins, and in a tie the one with the longer alignments.
    """

    def side(rows: DataFrame, x: str) -> DataFrame:
        ops = F.filter(cigar.parse(F.col("cigar")), lambda o: (o.op == "X") | (o.op.isin("I", "D") & (o.len < most_indel)))
        bad = F.aggregate(ops, F.lit(0).cast("long"), lambda a, o: a + o.len)
        return rows.groupBy("query").agg(F.sum(bad).alias(f"{x}_nonmatch"), F.sum(F.col("qstop") - F.col("qstart")).alias(f"{x}_length"))

    j = side(paternal, "pat").join(side(maternal, "mat"), "query", "full")
    p, m = F.col("pat_nonmatch"), F.col("mat_nonmatch")
    parent = F.when(p.isNull(), "mat").when(m.isNull(), "pat").when(p < m, "pat").when(m < p, "mat").when(F.col("pat_length") >= F.col("mat_length"), "pat").otherwise("mat")
    return j.select("query", "pat_nonmatch", "mat_nonmatch", log2_ratio(m.cast("double"), p.cast("double")).alias("score"), parent.alias("parent"))


# Contacts.
def read_report(alignments: DataFrame) -> DataFrame:
    """(n_alignments, n_reads, n): how many reads have so many alignments; one of 1 is a singleton."""
    reads = alignments.groupBy("read").agg(F.count("*").alias("n_alignments"))
    return reads.groupBy("n_alignments").agg(F.count("*").alias("n_reads"), F.sum("n_alignments").alias("n"))


def contact_signal(first: DataFrame, second: DataFrame, bubbles: DataFrame) -> DataFrame:
    """(node, same_1, cross_1, same_2, cross_2): weights of a node's contacts with its own and the other side of other bubbles, in two maps.

    ``bubbles(node, bubble, side)``; contacts within a bubble say nothing and are left out.
    """
    both = first.select("a", "b", F.col("weight").alias("w1"), F.lit(0).alias("w2")).unionAll(second.select("a", "b", F.lit(0), "weight"))
    s = lambda x: bubbles.select(F.col("node").alias(x), F.col("bubble").alias(f"u{x}"), F.col("side").alias(f"s{x}"))
    e = both.join(s("a"), "a").join(s("b"), "b").where("ua <> ub").withColumn("same", F.col("sa") == F.col("sb"))
    half = e.select(F.col("a").alias("node"), "same", "w1", "w2").unionAll(e.select("b", "same", "w1", "w2"))
    at = lambda w, c: F.sum(F.when(c, F.col(w)).otherwise(0)).cast("long")
    return half.groupBy("node").agg(at("w1", F.col("same")).alias("same_1"), at("w1", ~F.col("same")).alias("cross_1"), at("w2", F.col("same")).alias("same_2"), at("w2", ~F.col("same")).alias("cross_2"))


def fold_change(first: DataFrame, second: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """(a, b, w1, w2, log_ratio) of two contact maps, each weight as a share of its map's sum."""
    t1, t2 = (d.agg(F.sum("weight").alias("t")).first().t or 1 for d in (first, second))
    j = first.select("a", "b", F.col("weight").alias("w1")).join(second.select("a", "b", F.col("weight").alias("w2")), ["a", "b"], "full").fillna(0, ["w1", "w2"])
    return j.select("a", "b", "w1", "w2", log2_ratio(F.col("w1") / t1, F.col("w2") / t2, epsilon).alias("log_ratio"))


def edge_relations(contacts: DataFrame, parts: DataFrame) -> DataFrame:
    """(mapq, relation, n): weights by quality of edges within a phase, across, and with an unphased end."""
    p = lambda x: parts.select(F.col("node").alias(x), F.col("partition").alias(f"p{x}"))
    product = F.col("pa") * F.col("pb")
    relation = F.when(product == 1, "same").when(product == -1, "other").otherwise("unphased")
    return contacts.where("a <> b").join(p("a"), "a").join(p("b"), "b").groupBy("mapq", relation.alias("relation")).agg(F.sum("weight").alias("n"))


# Homology by hashes.
def hash_confusion(matches: DataFrame, lengths: DataFrame, certainty: float, min_length: int) -> DataFrame:
    """(outcome, names, letters) of directed ``matches(name, other_name, score)``.

    A name is called if its highest score is more than ``certainty`` of all its scores and it is longer than
    ``min_length``; a call is true if both names are sides of one bubble.
    """
    g = matches.groupBy("name").agg(F.max(F.struct("score", "other_name")).alias("best"), F.sum("score").alias("total"))
    j = lengths.select("name", "length").join(g, "name", "left")
    called = F.coalesce((F.col("best.score") > certainty * F.col("total")) & (F.col("length") > min_length), F.lit(False))
    right = is_bubble(F.col("name"), F.col("best.other_name"))
    outcome = F.when(called & right, "true_positive").when(called, "false_positive").when(F.regexp_extract("name", r"\.[01]$", 0) != "", "false_negative").otherwise("true_negative")
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("names"), F.sum("length").cast("long").alias("letters"))


def precision_recall(confusion: DataFrame, of: str = "names") -> DataFrame:
    """(precision, recall) of ``hash_confusion``, by names or letters."""
    n = lambda o: F.sum(F.when(F.col("outcome") == o, F.col(of)).otherwise(0))
    g = confusion.agg(n("true_positive").alias("tp"), n("false_positive").alias("fp"), n("false_negative").alias("fn"))
    share = lambda x: F.col("tp") / F.nullif((F.col("tp") + F.col(x)).cast("double"), F.lit(0.0))
    return g.select(share("fp").alias("precision"), share("fn").alias("recall"))


# Tables of reports.
def proportions(rows: DataFrame) -> DataFrame:
    """``rows(metric, reference, sample)`` with the sample's share of the reference."""
    return rows.withColumn("share", F.col("sample") / F.nullif(F.col("reference").cast("double"), F.lit(0.0)))


def density(positions: DataFrame, width: int) -> DataFrame:
    """(chrom, bin_start, n) of ``positions(chrom, pos)``."""
    return positions.groupBy("chrom", (F.floor(F.col("pos") / width) * width).cast("long").alias("bin_start")).agg(F.count("*").alias("n"))


def weighted_lengths(lengths: DataFrame, width: int) -> DataFrame:
    """(bin_start, n, letters, remaining): lengths by bin, the letters in it, and those in it and in longer bins."""
    h = lengths.groupBy((F.floor(F.col("length") / width) * width).cast("long").alias("bin_start")).agg(F.count("*").alias("n"), F.sum("length").cast("long").alias("letters"))
    return h.withColumn("remaining", F.sum("letters").over(Window.orderBy(F.desc("bin_start"))))  # one row a bin


def signal_points(histogram: DataFrame) -> DataFrame:
    """(mapq, consistent, inconsistent, log_ratio): log10 of the consistent over the inconsistent weight at a quality or above."""
    return histogram.select("mapq", "consistent", "inconsistent", (F.log10(F.col("consistent") + F.lit(1e-12)) - F.log10(F.col("inconsistent") + F.lit(1e-12))).alias("log_ratio"))


def score_points(scores: DataFrame, min_hits: int = 30, threshold: float = 0.02) -> DataFrame:
    """(name, score, size, called) for a scatter of k-mer scores: names with enough hits, the size by their length."""
    size = F.pow(F.greatest(F.lit(1.0), F.log10("length") - 2), F.lit(3))
    return scores.where(F.col("maternal") + F.col("paternal") >= min_hits).select("name", "score", size.alias("size"), (F.abs("score") > threshold).alias("called"))


def binomial_cdf(n: int, grid: DataFrame) -> DataFrame:
    """(k, p, cdf) of fair draws for ``grid(k)``, which has every k from 0 on."""
    p = binomial_p(F.lit(n), F.col("k"))
    return grid.select("k", p.alias("p")).withColumn("cdf", F.sum("p").over(Window.orderBy("k")))


def observed_cdf(values: DataFrame, column: str) -> DataFrame:
    """(value, n, share): how many values are not greater; one row a value."""
    h = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    w = Window.orderBy("value")
    return h.select("value", F.sum("n").over(w).alias("n"), (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("share"))


def alignment_weights(rows: DataFrame) -> DataFrame:
    """(a, b, n, weight) of ``rows(name_a, name_b, total_matches, position)``: a pair's last row, weight max(1, log10(n / 10))."""
    last = rows.groupBy(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).agg(F.max_by("total_matches", "position").alias("n"))
    return last.withColumn("weight", F.greatest(F.lit(1.0), F.log10(F.col("n") / 10)))


def pivoted(report: DataFrame, samples: list[str]) -> DataFrame:
    """``report(sample, chromosome, metric, value)`` with a column for each sample."""
    return report.groupBy("chromosome", "metric").pivot("sample", samples).agg(F.first("value"))


# Sequences and intervals.
def disjoint(a: DataFrame, b: DataFrame) -> bool:
    """Whether no name is in both."""
    return a.select("name").join(b.select("name"), "name", "left_semi").limit(1).count() == 0


def merged_fasta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, sequence) of both; if any name is in both, all of either side get its suffix."""
    if disjoint(a, b):
        return a.select("name", "sequence").unionAll(b.select("name", "sequence"))
    with_ = lambda d, x: d.select(F.concat("name", F.lit(x)).alias("name"), "sequence")
    return with_(a, "_hap_a").unionAll(with_(b, "_hap_b"))


def filled(segments: DataFrame, records: DataFrame) -> DataFrame:
    """``segments(name, sequence)`` with sequences of ``records(name, sequence)`` where those have the name."""
    r = records.select("name", F.col("sequence").alias("given"))
    return segments.join(r, "name", "left").select("name", F.coalesce("given", "sequence").alias("sequence"))


def fasta_lines(records: DataFrame) -> DataFrame:
    """(value): FASTA records."""
    return records.select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value"))


def stripped(segments: DataFrame) -> DataFrame:
    """Segments without their sequence."""
    return segments.select("name", F.lit("*").alias("sequence"))


def interval_map(intervals: DataFrame, *by: str) -> DataFrame:
    """(*by, start, stop, ids): half-open ``intervals(start, stop, id)`` cut where any begins or ends, with the ids that cover each part.

    An interval covers the parts from its own start to its own stop, whose numbers among the cuts are looked up;
    it costs those parts and nothing else.
    """
    cuts = intervals.select(*by, F.explode(F.array("start", "stop")).alias("start")).distinct()
    w = Window.partitionBy(*by).orderBy("start")
    parts = cuts.select(*by, "start", F.lead("start").over(w).alias("stop"), F.row_number().over(w).alias("place"))
    at = lambda x, n: parts.select(*by, F.col("start").alias(x), F.col("place").alias(n))
    spans = intervals.where("start < stop").join(at("start", "low"), [*by, "start"]).join(at("stop", "high"), [*by, "stop"])
    covered = spans.select(*by, "id", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("place"))
    return covered.join(parts, [*by, "place"]).groupBy(*by, "start", "stop").agg(F.array_sort(F.collect_set("id")).alias("ids"))


# Sides of alternatives' components, as arrays.
def compatible(first_a: Column, second_a: Column, first_b: Column, second_b: Column) -> Column:
    """Whether two components can be joined with the sides of one crossed: no node may come on both sides."""
    return ~F.arrays_overlap(first_a, first_b) & ~F.arrays_overlap(second_a, second_b)


def crossed(first_a: Column, second_a: Column, first_b: Column, second_b: Column) -> Column:
    """Struct of both sides of the joined component."""
    return F.struct(F.array_sort(F.array_union(first_a, second_b)).alias("first"), F.array_sort(F.array_union(second_a, first_b)).alias("second"))


def conflicts(first_a: Column, second_a: Column, first_b: Column, second_b: Column) -> Column:
    """Nodes that would come on both sides."""
    return F.array_sort(F.array_union(F.array_intersect(first_a, first_b), F.array_intersect(second_a, second_b)))
