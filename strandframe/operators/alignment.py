"""Alignment of candidate pairs in process: exact seeds, chained along the diagonal, and what the chains cover.

Pairs are independent rows; both sequences of a pair must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.chains import best_overlaps, non_overlapping_matches
from strandframe.operators.structure import alt_components

SEED, BAND, FEWEST = 15, 200, 40
BLOCKS = "ref_start long, ref_stop long, query_start long, query_stop long, is_reverse boolean, n_matches long, identity double"
_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def seeds(ref: str, query: str, k: int = SEED) -> list[tuple[int, int, int]]:
    """(ref start, query start, length) of maximal exact matches that begin with a k-mer which stands once in the reference."""
    where: dict[str, int | None] = {}
    for i in range(len(ref) - k + 1):
        w = ref[i : i + k]
        where[w] = None if w in where else i
    out, reached = [], {}
    for j in range(len(query) - k + 1):
        i = where.get(query[j : j + k])
        if i is None or reached.get(i - j, -1) > j:
            continue
        n = k
        while i + n < len(ref) and j + n < len(query) and ref[i + n] == query[j + n]:
            n += 1
        out.append((i, j, n))
        reached[i - j] = j + n - k + 1
    return out


def chained(found: list[tuple[int, int, int]], band: int = BAND) -> list[list[tuple[int, int, int]]]:
    """Chains of seeds that go on in both sequences, with diagonals no more than ``band`` apart, best first; a seed is in one chain."""
    found = sorted(found)
    chains, free = [], list(range(len(found)))
    while free:
        score: dict[int, tuple[int, int]] = {}
        for x, at in enumerate(free):
            i, j, n = found[at]
            best = (n, -1)
            for before in free[max(0, x - 64) : x]:
                p, q, m = found[before]
                overlap = max(0, p + m - i, q + m - j)
                if p < i and q < j and abs((i - j) - (p - q)) <= band and n > overlap:
                    best = max(best, (score[before][0] + n - overlap, before))
            score[at] = best
        at = max(free, key=lambda a: (score[a][0], -a))
        chain = []
        while at >= 0:
            chain.append(found[at])
            at = score[at][1]
        chains.append(chain[::-1])
        gone = set(chain)
        free = [a for a in free if found[a] not in gone]
    return chains


def block(chain: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int, float]:
    """(ref start, ref stop, query start, query stop, matches, identity) of a chain; between seeds nothing matches."""
    matches, ref_at, query_at = 0, chain[0][0], chain[0][1]
    for i, j, n in chain:
        cut = max(0, ref_at - i, query_at - j)
        matches += max(0, n - cut)
        ref_at, query_at = i + n, j + n
    span = max(ref_at - chain[0][0], query_at - chain[0][1])
    return chain[0][0], ref_at, chain[0][1], query_at, matches, matches / span


def aligned(ref: str, query: str, k: int = SEED, band: int = BAND, fewest: int = FEWEST) -> list[tuple]:
    """Blocks of both strands with ``fewest`` matches or more; a reversed query's places are those of the forward one."""
    out = []
    for reverse in (False, True):
        q = query[::-1].translate(_COMPLEMENT) if reverse else query
        for chain in chained(seeds(ref, q, k), band):
            a, b, c, d, n, identity = block(chain)
            if n >= fewest:
                out.append((a, b, len(q) - d if reverse else c, len(q) - c if reverse else d, reverse, n, identity))
    return sorted(out)


def align_pairs(pairs: DataFrame, k: int = SEED, band: int = BAND, fewest: int = FEWEST) -> DataFrame:
    """Blocks of ``pairs(a, b, sequence_a, sequence_b)``: (a, b, ref_start, ...), the first sequence as the reference."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(a, b, *hit) for a, b, x, y in pdf[["a", "b", "sequence_a", "sequence_b"]].itertuples(index=False, name=None) for hit in aligned(x, y, k, band, fewest)]
            yield pd.DataFrame(rows, columns=["a", "b", "ref_start", "ref_stop", "query_start", "query_stop", "is_reverse", "n_matches", "identity"])

    return pairs.select("a", "b", "sequence_a", "sequence_b").mapInPandas(run, f"a {kind}, b {kind}, {BLOCKS}")


def alignment_graph(candidates: DataFrame, sequences: DataFrame, min_share: float = 0.05, k: int = SEED, fewest: int = FEWEST) -> DataFrame:
    """(a, b, weight): candidate pairs with letters of ``a`` covered by the alignment, ``min_share`` of it or more.

    Pairs whose shorter sequence is under that share of the longer one are not aligned. ``sequences(name, sequence)``.
    """
    side = lambda x: sequences.select(F.col("name").alias(x), F.col("sequence").alias(f"sequence_{x}"))
    j = candidates.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    long = F.length("sequence_a")
    j = j.where(F.length("sequence_b") >= min_share * long).repartition("a", "b")
    matches = non_overlapping_matches(align_pairs(j, k, BAND, fewest), "a", "b")
    covered = matches.join(sequences.select(F.col("name").alias("a"), F.length("sequence").alias("n")), "a")
    weight = F.least(F.col("n").cast("long"), "matches")
    return covered.where(weight >= min_share * F.col("n")).select("a", "b", weight.alias("weight"))


def homologous_alts(candidates: DataFrame, sequences: DataFrame, min_similarity: float = 0.2, min_share: float = 0.05) -> DataFrame:
    """(node, component, side): alternatives among candidates, by mutually best alignments, heaviest first."""
    graph = alignment_graph(candidates, sequences, min_share)
    lengths = sequences.select(F.col("name").alias("node"), F.length("sequence").cast("long").alias("length"))
    return alt_components(best_overlaps(graph, lengths, min_similarity))
