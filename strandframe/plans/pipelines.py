"""End-to-end plans: contact phasing, trio phasing, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.naming import alt_name, split_path_name
from strandframe.operators import alignment, assembly, chainer, chains, contact_graph, evaluation
from strandframe.operators import contacts as C
from strandframe.operators import graph as G
from strandframe.operators import paths as H
from strandframe.operators import kmers as K
from strandframe.operators import phasing as P
from strandframe.operators.structure import alt_components
from strandframe.sources import text, writers
from strandframe.sources.shared import stash


def named_alts(nodes: DataFrame) -> DataFrame:
    """(a, b, weight) of nodes whose names are partners."""
    other = nodes.select(alt_name(F.col("node")).alias("node"), F.col("node").alias("other"))
    return nodes.join(other, "node").where("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"), F.lit(1).alias("weight"))


def named_bubbles(nodes: DataFrame) -> DataFrame:
    """(node_0, node_1) of every name's bubble, a partner that is not among ``nodes`` put in."""
    side = F.regexp_extract("node", r"\.([01])$", 1)
    pair = nodes.where(side != "").select(F.when(side == "0", F.col("node")).otherwise(alt_name(F.col("node"))).alias("node_0"), F.when(side == "1", F.col("node")).otherwise(alt_name(F.col("node"))).alias("node_1"))
    return pair.distinct()


def phase_contacts(alignments: DataFrame, min_mapq: int = 1, samples: int = 30, iterations: int = 200, seed: int = 0, alts: DataFrame | None = None, rounds: int = 0) -> DataFrame:
    """(node, partition): contacts of reads, alternatives by name unless given, nodes without one left out, then the search.

    No contact left between such nodes gives no rows.
    """
    contacts, _ = stash(C.contact_map(C.usable(alignments, min_mapq)), "contacts")
    nodes = contacts.select(F.col("a").alias("node")).union(contacts.select("b")).distinct()
    components, _ = stash(alt_components(named_alts(nodes) if alts is None else alts), "alternatives")
    has = lambda x: components.select(F.col("node").alias(x))
    kept = contacts.where("a <> b").join(has("a"), "a", "left_semi").join(has("b"), "b", "left_semi")
    same = components.select(F.col("node").alias("a"), F.col("component").alias("ca")), components.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    kept = kept.join(same[0], "a").join(same[1], "b").where("ca <> cb").select("a", "b", "weight")
    if rounds:
        return P.phase_in_rounds(kept, components, rounds, samples, iterations, seed)
    return P.phase(kept, components, samples, iterations, seed)


def phase_trio(sequences: DataFrame, parental: DataFrame, k: int) -> DataFrame:
    """(component, forward, swapped, flipped) of haplotype pairs by their parents' k-mers."""
    if not 4 <= k <= 64:
        raise ValueError("k must be from 4 to 64")
    return K.bubble_order(K.parental_matrix(sequences, parental, k))


def evaluate(phases: DataFrame, truth: DataFrame) -> DataFrame:
    """(reference, n0, n1, hamming): per true reference, nodes of either phase and the share of the rarer one."""
    j = phases.where("partition <> 0").join(truth, "node")
    n = lambda p: F.sum((F.col("partition") == p).cast("long"))
    return j.groupBy("reference").agg(n(-1).alias("n0"), n(1).alias("n1")).withColumn("hamming", F.least("n0", "n1") / (F.col("n0") + F.col("n1")))


def phase_assembly(
    segments: DataFrame, links: DataFrame, alignments: DataFrame, out: str, *, min_mapq: int = 1, samples: int = 30, iterations: int = 200, rounds: int = 2, seed: int = 0,
    homology: bool = False, chain: str = "hamiltonian", unzip: bool = True, least_phased: float = 0.1, k: int = 22, sample_rate: float = 0.04, hash_iterations: int = 6,
) -> dict[str, DataFrame]:
    """Contact phasing from a graph and alignments to files under ``out``, which must not exist: every table is written and read again.

    config, contacts, phases (one header each), components, chained (GFA), phase_chains, unzipped (GFA, unless not
    wished) and fasta (a folder for each phase). Alternatives come from names, or with ``homology`` from min-hash
    candidates, aligned. ``chain`` is ``hamiltonian`` or ``simple``.
    """
    spark = segments.sparkSession
    options = {"min_mapq": min_mapq, "samples": samples, "iterations": iterations, "rounds": rounds, "seed": seed, "homology": homology, "chain": chain, "unzip": unzip, "least_phased": least_phased}
    writers.write_csv(writers.config_rows(spark, options), f"{out}/config")
    usable = C.usable(alignments, min_mapq)
    contacts, _ = stash(C.contact_map(usable), "contacts")
    names = segments.select(F.col("name").alias("node"))
    if homology:
        sequences = segments.select("name", "sequence")
        hits = K.top_hits(K.shared_bins(K.minhash_bins(sequences, k, sample_rate, hash_iterations)), 5, 0.05)
        candidates = K.not_adjacent(K.alignment_candidates(hits, segments.select("name", "length"), 0.05, 0.7), links)
        alts = alignment.homologous_alts(candidates, sequences)
    else:
        alts = alt_components(named_alts(names))
    alts, _ = stash(alts, "alternatives")
    kept, _ = stash(contact_graph.with_alternatives(contacts, alts), "contacts")
    if not kept.limit(1).count():
        raise ValueError("no contact is left between nodes with alternatives")
    writers.write_csv(writers.contact_rows(kept), f"{out}/contacts")
    phases, _ = stash(P.phase_in_rounds(kept, alts, rounds, samples, iterations, seed), "phases")
    coverage = C.coverage(usable).withColumnRenamed("contig", "node")
    rows = phases.join(coverage, "node", "left").join(segments.select(F.col("name").alias("node"), "length"), "node", "left").fillna(0, ["coverage", "length"])
    writers.write_csv(writers.phase_rows(rows.withColumnRenamed("node", "name")), f"{out}/phases")
    writers.write_csv(writers.component_rows(alts), f"{out}/components")
    halves = G.half_edges(links)
    if chain == "hamiltonian":
        steps = chainer.chain_haplotypes(halves, segments.select(F.col("name").alias("node"), "length"), alts, phases, least_phased)
    elif chain == "simple":
        steps = chains.chain_paths(chains.chains(halves, names), phases)
    else:
        raise ValueError(f"no such chainer: {chain}")
    steps, _ = stash(steps.select("path", "phase", F.col("step").cast("int").alias("step_index"), "node", "reversed"), "haplotype-steps")
    writers.gfa_lines(segments, links, steps).write.mode("errorifexists").text(f"{out}/chained")
    writers.write_csv(H.provenance(steps).withColumnRenamed("path", "path_name"), f"{out}/phase_chains")
    made = steps.select("path", "phase").distinct()
    if unzip:
        segments, links, left = assembly.unzip(segments.select("name", "sequence"), links, steps, delete_islands=False)
        writers.gfa_lines(segments, links, left).write.mode("errorifexists").text(f"{out}/unzipped")
    side = phases.select(F.col("node").alias("name"), "partition").unionAll(made.select(F.col("path").alias("name"), (F.col("phase") * 2 - 1).alias("partition")))
    writers.fasta_by_phase(segments, side).write.mode("errorifexists").partitionBy("phase").text(f"{out}/fasta")
    return {"contacts": kept, "phases": phases, "alternatives": alts, "steps": steps}


def phase_assembly_files(spark: SparkSession, gfa: str, alignments: str, out: str, **options) -> dict[str, DataFrame]:
    """``phase_assembly`` from a GFA file and a SAM or BAM file."""
    segments, links, _ = text.read_gfa(spark, gfa)
    return phase_assembly(segments, links, contact_alignments(spark, alignments), out, **options)


def contact_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(read, contig, mapq, flag, position) of a SAM or BAM file."""
    from strandframe.sources.bam import bam_alignments

    rows = bam_alignments(spark, path) if path.endswith(".bam") else text.sam_alignments(spark.read.text(path))
    return rows.select(F.col("query_name").alias("read"), F.col("ref_name").alias("contig"), "mapq", "flag", F.col("ref_start").alias("position"))


def contact_map_files(spark: SparkSession, alignments: str, out: str, prefix: str | None = None, min_mapq: int = 0) -> None:
    """The contact map by quality of a SAM or BAM file, as CSV without a header."""
    rows = C.contact_map_by_mapq(C.usable(contact_alignments(spark, alignments), min_mapq, prefix))
    writers.write_csv(writers.stratified_rows(rows), out, header=False)


def phase_paths_by_kmers(segments: DataFrame, links: DataFrame, steps: DataFrame, parental: DataFrame, k: int) -> dict[str, DataFrame]:
    """Trio phasing of a graph with haplotype paths ``<component>.<0 or 1>``: matrix, order, phased (segments, links, steps) and parents.

    Paths that share an end are a bubble's alleles. K-mers of their own nodes, a neighbour on either side with them,
    decide which allele is the father's; paths become nodes, and chains of bubbles become one path a parent.
    """
    if not 4 <= k <= 64:
        raise ValueError("k must be from 4 to 64")
    halves = G.half_edges(links)
    wide = H.extended(steps, halves).select("path", "step_index", "node", "reversed")
    component, haplotype = split_path_name(F.col("path"))
    kmers = H.haplotype_kmers(wide, segments, k).select(component.alias("component"), haplotype.alias("haplotype"), F.col("kmer").alias("sequence"))
    matrix, _ = stash(K.parental_matrix(kmers, parental, k), "kmer-matrix")
    order = K.bubble_order(matrix)
    one, joined, _ = assembly.unzip(segments.select("name", "sequence"), links, steps, delete_islands=False)
    one, _ = stash(one, "unzipped-segments")
    joined, _ = stash(joined, "unzipped-links")
    comp, hap = split_path_name(F.col("node"))
    alleles = steps.select(F.col("path").alias("node")).distinct().select("node", comp.alias("component"), hap.alias("haplotype"))
    turned = alleles.join(order.select("component", "flipped"), "component", "left").fillna(False, ["flipped"])
    partition = turned.select("node", F.when((F.col("haplotype") == 1) != F.col("flipped"), 1).otherwise(-1).alias("partition"))
    every = one.select(F.col("name").alias("node"))
    walked = chains.chain_paths(chains.chains(G.half_edges(joined), every), partition)
    walked, _ = stash(walked.select("path", "phase", F.col("step").cast("int").alias("step_index"), "node", "reversed"), "parental-steps")
    final, final_links, left = assembly.unzip(one, joined, walked, delete_islands=False)
    parent = walked.select(F.col("path").alias("name"), F.when(F.col("phase") == 0, "pat").otherwise("mat").alias("parent")).distinct()
    lone = partition.join(walked.select("node").distinct(), "node", "left_anti").select(F.col("node").alias("name"), F.when(F.col("partition") == -1, "pat").otherwise("mat").alias("parent"))
    return {"matrix": matrix, "order": order, "segments": final, "links": final_links, "steps": left, "provenance": H.provenance(walked), "parents": parent.unionAll(lone)}


def phase_trio_files(spark: SparkSession, gfa: str, paternal: str, maternal: str, k: int, out: str, min_length: int = 100_000) -> dict[str, DataFrame]:
    """Trio phasing from files to files under ``out``: matrix, phase_chains, phased (GFA), unphased_parental_counts and fasta by parent."""
    segments, links, steps = text.read_gfa(spark, gfa)
    parental = text.kmer_set(spark, paternal, "pat").unionByName(text.kmer_set(spark, maternal, "mat"))
    found = phase_paths_by_kmers(segments, links, steps, parental, k)
    writers.write_csv(found["matrix"], f"{out}/matrix")
    writers.write_csv(found["provenance"], f"{out}/phase_chains")
    whole, _ = stash(found["segments"], "phased-segments")
    writers.gfa_lines(whole, found["links"], found["steps"]).write.mode("errorifexists").text(f"{out}/phased")
    rest = whole.join(found["parents"].select("name"), "name", "left_anti")
    scores, _ = stash(K.unphased_scores(rest, parental, k, min_length), "unphased-scores")
    writers.write_csv(scores.select("name", F.col("maternal").alias("maternal_count"), F.col("paternal").alias("paternal_count"), F.col("unique_maternal").alias("unique_maternal_count"), F.col("unique_paternal").alias("unique_paternal_count"), "score", "unique_score"), f"{out}/unphased_parental_counts")
    rescued = found["parents"].unionByName(scores.where("parent <> 'none'").select("name", "parent"))
    routed = whole.join(rescued, "name", "left").select(F.coalesce("parent", F.lit("unphased")).alias("parent"), F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value"))
    routed.write.mode("errorifexists").partitionBy("parent").text(f"{out}/fasta")
    return found | {"scores": scores}


def rephase(contacts: DataFrame, alignments: DataFrame, ids: DataFrame, samples: int = 30, iterations: int = 200, rounds: int = 2, seed: int = 0) -> DataFrame:
    """(node, partition) from a contact CSV's rows and an alignment CSV's symmetrical rows."""
    alts, _ = stash(alt_components(text.symmetrical_alts(alignments, ids.select(F.col("name").alias("node")))), "alternatives")
    return P.phase_in_rounds(contact_graph.with_alternatives(contacts, alts), alts, rounds, samples, iterations, seed)


def phase_bubbles(alignments: DataFrame, min_mapq: int = 1, prefix: str | None = None, samples: int = 8, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """(node, bubble, phase) by flipping bubbles of names; a bubble is named by its first node."""
    contacts = C.contact_map(C.usable(alignments, min_mapq, prefix))
    nodes = contacts.select(F.col("a").alias("node")).union(contacts.select("b")).distinct()
    pairs = named_bubbles(nodes)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("node_0").alias("node"), F.col("node_0").alias("bubble"), F.lit(0).alias("side")), F.struct(F.col("node_1").alias("node"), F.col("node_0").alias("bubble"), F.lit(1).alias("side")))).alias("s")).select("s.*")
    best = P.best_sample(P.phase_bubbles(P.bubble_consistency(contacts, sides), samples, iterations, seed))
    return sides.join(best, "bubble").select("node", "bubble", F.expr("side ^ flipped").alias("phase"))


def evaluate_phasing(phases: DataFrame, paternal: DataFrame, maternal: DataFrame, lengths: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Rows (name, truth, inferred, reference) and (reference, cis, trans, hamming) of a phase table against alignments to both parents."""
    truth = evaluation.assigned_phases(lengths, evaluation.cigar_summaries(paternal), evaluation.cigar_summaries(maternal), prefix)
    sets = evaluation.intersections(truth, text.phase_sets(phases))
    return sets, evaluation.hamming_by_reference(sets, lengths)
