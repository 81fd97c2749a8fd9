"""K-mers as packed integers: counts, parental matrices, scores, positions on paths, and min-hash overlaps.

A k-mer is a pair of BIGINTs, two bits a letter, the first letter lowest: ``code`` holds up to 32 letters,
``high`` those beyond (0 for k of 32 or less). Codes are made per sequence, a piece at a time, by shifts over whole
arrays; a window with a letter other than A, C, G, T is left out. With ``canonical`` the lesser code of both
strands stands for either, so membership of either strand is plain equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.naming import log2_ratio
from strandframe.sources.shared import stash

U = np.uint64
#: Windows of a sequence that are packed at once, and rows of an output batch, about.
PIECE = 1 << 20
#: Sets of so many k-mers or fewer are broadcast.
FEW = 4_000_000
#: Moduli and factors of the min-hash; a seed turns the factors.
P, Q, A, C = 2147483647, 2147483629, 1103515245, 69069

_LETTER = np.full(256, 4, dtype=np.uint8)
_LETTER[list(b"ACGT")] = range(4)


def _packed(letters: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.zeros(n, dtype=U), np.zeros(n, dtype=U)
    for j in range(k):
        part = letters[j : j + n].astype(U)
        if j < 32:
            low |= part << U(2 * j)
        else:
            high |= part << U(2 * (j - 32))
    return low, high


def pack(sequence: str, k: int, canonical: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, high, position) of every window of k letters that has none but A, C, G, T."""
    letters = _LETTER[np.frombuffer(sequence.encode("ascii", "replace"), dtype=np.uint8)]
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(letters > 3)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    low, high = _packed(letters & 3, k, n)
    if canonical:
        # The other strand's window is the complement read backwards.
        other_low, other_high = (x[::-1] for x in _packed((3 - (letters & 3))[::-1], k, n))
        less = (other_high < high) | ((other_high == high) & (other_low < low))
        low, high = np.where(less, other_low, low), np.where(less, other_high, high)
    return low[at].view(np.int64), high[at].view(np.int64), at.astype(np.int64)


def packed_kmers(sequences: DataFrame, k: int, *by: str, canonical: bool = True, distinct: bool = False) -> DataFrame:
    """(*by, code, high, at) of ``sequences(*by, sequence)``; ``distinct`` drops a k-mer's repeats within a piece of a sequence."""
    if not 1 <= k <= 64:
        raise ValueError("k must be from 1 to 64")
    rows = sequences.select(*by, "sequence")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def flush(batch=batch) -> pa.RecordBatch:
                owner = pa.array(np.repeat([h[0] for h in held], [len(h[1]) for h in held]))
                columns = [batch.column(c).take(owner) for c in by]
                return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate([h[i] for h in held])) for i in (1, 2, 3))], names=[*by, "code", "high", "at"])

            for i, sequence in enumerate(batch.column("sequence").to_pylist()):
                for start in range(0, max(0, len(sequence or "") - k + 1), PIECE):
                    code, high, at = pack(sequence[start : start + PIECE + k - 1], k, canonical)
                    if distinct and len(code):
                        _, first = np.unique(np.stack([code, high], axis=1), axis=0, return_index=True) if k > 32 else np.unique(code, return_index=True)
                        code, high, at = code[first], high[first], at[first]
                    held.append((i, code, high, at + start))
                    size += len(code)
                    if size >= PIECE:
                        yield flush()
                        held, size = [], 0
            if size:
                yield flush()

    return rows.mapInArrow(run, ", ".join([*kinds, "code long, high long, at long"]))


def unpacked(code: Column, high: Column, k: int) -> Column:
    """The letters of a packed k-mer."""
    letter = lambda x, i: F.substring(F.lit("ACGT"), F.shiftrightunsigned(x, 2 * i).bitwiseAND(3).cast("int") + 1, F.lit(1))
    return F.concat(*[letter(code, i) if i < 32 else letter(high, i - 32) for i in range(k)])


def kmer_counts(sequences: DataFrame, k: int) -> DataFrame:
    """(kmer, n) over ``sequences(sequence)``."""
    n = packed_kmers(sequences, k, canonical=False).groupBy("code", "high").agg(F.count("*").alias("n"))
    return n.select(unpacked(F.col("code"), F.col("high"), k).alias("kmer"), "n")


def parental_sets(parental: DataFrame, k: int) -> DataFrame:
    """(parent, code, high) of ``parental(parent, kmer)``, either strand, once each; a table in the shared folder."""
    sets = packed_kmers(parental.select("parent", F.col("kmer").alias("sequence")), k, "parent").select("parent", "code", "high").distinct()
    return stash(sets, "parental-kmers")[0]


def _members(kmers: DataFrame, sets: DataFrame) -> DataFrame:
    """Semi-join by code: most k-mers are in no set, and few sets are large."""
    return kmers.join(F.broadcast(sets) if sets.limit(FEW + 1).count() <= FEW else sets, ["code", "high"])


def parental_matrix(sequences: DataFrame, parental: DataFrame, k: int) -> DataFrame:
    """(component, haplotype, parent, n): distinct k-mers of each haplotype that a parent's set holds, either strand."""
    own = packed_kmers(sequences, k, "component", "haplotype", distinct=True).drop("at")
    return _members(own, parental_sets(parental, k)).distinct().groupBy("component", "haplotype", "parent").agg(F.count("*").alias("n"))


def normalised(matrix: DataFrame, parental: DataFrame, k: int) -> DataFrame:
    """The matrix with ``share``, the counts over the size of the parent's set."""
    sizes = parental_sets(parental, k).groupBy("parent").agg(F.count("*").alias("size"))
    return matrix.join(F.broadcast(sizes), "parent").withColumn("share", F.col("n") / F.col("size"))


def bubble_order(matrix: DataFrame) -> DataFrame:
    """(component, flipped): whether exchanging haplotypes 0 and 1 scores more as paternal and maternal; a tie does not."""
    cell = lambda h, p: F.sum(F.when((F.col("haplotype") == h) & (F.col("parent") == p), F.col("n")).otherwise(0))
    g = matrix.groupBy("component").agg((cell(0, "pat") + cell(1, "mat")).alias("forward"), (cell(1, "pat") + cell(0, "mat")).alias("swapped"))
    return g.select("component", "forward", "swapped", (F.col("swapped") > F.col("forward")).alias("flipped"))


def unphased_scores(contigs: DataFrame, parental: DataFrame, k: int, min_length: int = 100_000, min_hits: int = 30, threshold: float = 0.02) -> DataFrame:
    """(name, maternal, paternal, unique_maternal, unique_paternal, score, unique_score, parent) of ``contigs(name, sequence)``.

    A k-mer is unique if it stands once in all contigs. The score is log2 of the paternal over the maternal share
    of each set; the unique score compares plain counts and decides: over the threshold paternal, under its
    negative maternal, for contigs longer than ``min_length`` with more than ``min_hits`` hits; else none.
    """
    kmers, _ = stash(packed_kmers(contigs, k, "name").groupBy("name", "code", "high").agg(F.count("*").alias("c")), "contig-kmers")
    sets = parental_sets(parental, k)
    sizes = {r.parent: r.n for r in sets.groupBy("parent").agg(F.count("*").alias("n")).collect()}  # one row a parent
    hits = _members(kmers, sets)
    unique = kmers.join(hits.select("code", "high").distinct(), ["code", "high"]).groupBy("code", "high").agg((F.sum("c") == 1).alias("unique"))
    n = lambda p, once=False: F.sum(F.when((F.col("parent") == p) & (F.col("unique") if once else F.lit(True)), F.col("c")).otherwise(0)).cast("long")
    s = hits.join(unique, ["code", "high"]).groupBy("name").agg(n("mat").alias("maternal"), n("pat").alias("paternal"), n("mat", True).alias("unique_maternal"), n("pat", True).alias("unique_paternal"))
    s = contigs.select("name", F.length("sequence").alias("length")).join(s, "name", "left").fillna(0, ["maternal", "paternal", "unique_maternal", "unique_paternal"])
    share = lambda c, p: (F.col(c) + 0.000001) / max(1, sizes.get(p, 0))
    s = s.withColumn("score", F.log2(share("paternal", "pat") / share("maternal", "mat"))).withColumn("unique_score", log2_ratio(F.col("unique_paternal"), F.col("unique_maternal"), 0.000001))
    told = (F.col("length") > min_length) & (F.col("maternal") + F.col("paternal") > min_hits)
    parent = F.when(told & (F.col("unique_score") > threshold), "pat").when(told & (F.col("unique_score") < -threshold), "mat").otherwise("none")
    return s.withColumn("parent", parent)


def located(paths: DataFrame, parental: DataFrame, k: int, min_length: int = 0) -> DataFrame:
    """(path, at, is_pat, is_mat): where k-mers of either parent stand on the sequences of ``paths(path, sequence)``."""
    hits = _members(packed_kmers(paths.where(F.length("sequence") >= min_length), k, "path"), parental_sets(parental, k))
    has = lambda p: F.max((F.col("parent") == p).cast("int")) == 1
    return hits.groupBy("path", "at").agg(has("pat").alias("is_pat"), has("mat").alias("is_mat"))


def minhash(code: Column, high: Column, seed: int) -> Column:
    """62 bits of two linear hashes; plain integer arithmetic, the same in any engine."""
    turn = lambda x, f, m: F.pmod(F.pmod(x, F.lit(m)) * F.lit((f * (2 * seed + 1)) % m) + F.lit(seed + 1), F.lit(m))
    x, y = turn(code, A, P), turn(code, C, Q)
    return F.pmod(x + F.pmod(high, F.lit(P)), F.lit(P)) * F.lit(1 << 31) + F.pmod(y + F.pmod(high, F.lit(Q)), F.lit(Q))


def minhash_bins(sequences: DataFrame, k: int, share: float, iterations: int = 1) -> DataFrame:
    """(name, iteration, bin), distinct: the k-mers of either strand whose hash is under the threshold; an iteration has a seed and a part of the share."""
    limit = int(share / iterations * (P << 31))
    kmers = packed_kmers(sequences, k, "name", distinct=True)
    each = F.array(*[F.struct(F.lit(i).alias("iteration"), minhash(F.col("code"), F.col("high"), i).alias("bin")) for i in range(iterations)])
    return kmers.select("name", F.explode(F.filter(each, lambda x: x.bin < limit)).alias("h")).select("name", "h.iteration", "h.bin").distinct()


def bin_sizes(bins: DataFrame) -> DataFrame:
    """(size, n): how many bins hold so many names."""
    return bins.groupBy("iteration", "bin").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def shared_bins(bins: DataFrame, most_in_bin: int = 30) -> DataFrame:
    """(name, other_name, score, total_hashes): bins that two names share, and those of the first that count.

    Bins of more than ``most_in_bin`` names say nothing of homology and are left out of both numbers, which is
    this operator's own rule and bounds the pairs of a bin.
    """
    sizes = bins.groupBy("iteration", "bin").agg(F.count("*").alias("c")).where(F.col("c") <= most_in_bin)
    kept = bins.join(sizes, ["iteration", "bin"])
    totals = kept.groupBy("name").agg(F.count("*").alias("total_hashes"))
    some = kept.where("c > 1").select("name", "iteration", "bin")
    pairs = some.join(some.withColumnRenamed("name", "other_name"), ["iteration", "bin"]).where("name <> other_name").groupBy("name", "other_name").agg(F.count("*").alias("score"))
    return pairs.join(totals, "name")


def top_hits(shared: DataFrame, max_hits: int = 10, min_similarity: float = 0.0, min_hashes: int = 40) -> DataFrame:
    """(name, other_name, score, total_hashes, similarity): the highest distinct scores of each name; of equal ones, the first name."""
    one = shared.where(F.col("total_hashes") >= min_hashes).groupBy("name", "score", "total_hashes").agg(F.min("other_name").alias("other_name"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score")))
    best = one.withColumn("rank", rank).where(F.col("rank") <= max_hits).withColumn("similarity", F.col("score") / F.col("total_hashes"))
    return best.where(F.col("similarity") > min_similarity).select("name", "other_name", "score", "total_hashes", "similarity")


def best_matches(shared: DataFrame, certainty: float = 0.0, min_hashes: int = 40) -> DataFrame:
    """(name, other_name): the highest score of each name, if over a share of its hashes."""
    return top_hits(shared, 1, certainty, min_hashes).select("name", "other_name")


def mutual_best(best: DataFrame) -> DataFrame:
    """(a, b), a < b: names that are each other's best match."""
    back = best.select(F.col("name").alias("other_name"), F.col("other_name").alias("name"))
    return best.join(back, ["name", "other_name"]).where("name < other_name").select(F.col("name").alias("a"), F.col("other_name").alias("b"))


def overlap_graph(shared: DataFrame, min_similarity: float, min_hashes: int, max_overlaps: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, coverage) and edges (a, b, weight): up to ``max_overlaps`` hits of each name that are similar enough.

    An edge that both ends list keeps the score of the lesser name's list.
    """
    enough = shared.where(F.col("total_hashes") >= min_hashes)
    hits = top_hits(enough.where(F.col("score") / F.col("total_hashes") >= min_similarity), max_overlaps, -1.0, min_hashes)
    first = F.min_by("score", "name")
    edges = hits.groupBy(F.least("name", "other_name").alias("a"), F.greatest("name", "other_name").alias("b")).agg(first.alias("weight"))
    nodes = enough.groupBy(F.col("name").alias("node")).agg(F.first("total_hashes").alias("coverage"))
    return nodes, edges


def alignment_candidates(hits: DataFrame, lengths: DataFrame, min_over_a: float, min_over_b: float) -> DataFrame:
    """(a, b, ab_over_a, ab_over_b, mean_length): pairs, the longer sequence as ``a``, similar enough in both directions; longest pairs first.

    ``hits`` are directed; a direction that is not listed counts as 0. ``lengths(name, length)``.
    """
    size = lambda x, y: lengths.select(F.col("name").alias(x), F.col("length").alias(y))
    j = hits.join(size("name", "n"), "name").join(size("other_name", "m"), "other_name")
    longer = F.col("n") > F.col("m")
    a, b = F.when(longer, F.col("name")).otherwise(F.col("other_name")), F.when(longer, F.col("other_name")).otherwise(F.col("name"))
    over = lambda c: F.coalesce(F.max(F.when(c, F.col("similarity"))), F.lit(0.0))
    g = j.groupBy(a.alias("a"), b.alias("b")).agg(over(longer).alias("ab_over_a"), over(~longer).alias("ab_over_b"), F.max(F.expr("(n + m) div 2")).alias("mean_length"))
    return g.where((F.col("ab_over_a") >= min_over_a) & (F.col("ab_over_b") >= min_over_b)).orderBy(F.desc("mean_length"), "a", "b")


def not_adjacent(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Candidates (a, b) without a link between the two, in either direction; ``links(node_a, node_b)``."""
    ends = links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return candidates.join(ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), ["a", "b"], "left_anti")
