"""Sequence packing by Karmarkar-Karp multiway differencing.

Each document's ids (its end id included) are cut at multiples of the window; the rest is cut into
items of at most ``piece`` ids. Whole windows are sequences already and are numbered where they are cut. The
items are dealt by a hash of the item over blocks of bounded size, and each block is divided into ``k``
windows by multiway differencing: every item begins as a partial partition with one filled window; the two
partial partitions of the widest spread are merged, the fullest window of one with the emptiest of
the other, until one partition is left. ``k`` starts at the smallest count that could hold the
block and rises whenever the fullest window exceeds the capacity.

Only (doc, start, length, checksum) rows of items are shuffled: texts and ids stay where they are read.

Ids are those of the plain library call: control strings of the vocabulary that stand in a text are their
special ids.

Defined results: null or empty texts are one piece with the end id alone; repeated rows (equal
``doc_id``) are packed each for itself; a null ``doc_id`` is packed like another; items of equal size keep
the order of their documents' rows; an empty table gives no pieces; columns other than those named are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import encoder, slices, stash, table

WINDOW = 2048
#: Items are no longer than this, so that a window holds four of them or more and the spread stays small.
PIECE = 512
#: Items that one block should hold; a block is one task's unit of work.
BLOCK = 2048

PIECES = "doc_id long, doc_row long, start long, length long, ids_crc32 long, doc_tokens long, whole long"


def differencing(sizes: list[int], k: int) -> list[int]:
    """Window (0 to k - 1) of each item, from Karmarkar-Karp multiway differencing.

    A partial partition keeps its non-empty windows only, fullest first; those that are not there are
    empty. Merging pairs them with opposing imbalances. Windows are remembered as pairs of windows of
    the two parts, and are taken apart at the end.
    """
    if k <= 1 or not sizes:
        return [0] * len(sizes)
    made: list[tuple] = [(i,) for i in range(len(sizes))]
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {i: np.array([s], dtype=np.int64) for i, s in enumerate(sizes)}
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = sums.pop(a), sums.pop(b)
        both = np.zeros(min(k, len(x) + len(y)), dtype=np.int64)
        both[: len(x)] = x
        both[len(both) - len(y) :] += y[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[len(made)] = both
        heapq.heappush(heap, (-int(both[0] - (both[-1] if len(both) == k else 0)), len(made)))
        made.append((a, b, len(x), len(y), order))
    window = [0] * len(sizes)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        at, names = todo.pop()
        node = made[at]
        if len(node) == 1:
            window[node[0]] = int(names[0])
            continue
        a, b, n, m, order = node
        own = np.empty(len(order), dtype=np.int64)
        own[order] = names[: len(order)]
        todo.append((a, own[:n]))
        todo.append((b, own[::-1][:m]))
    return window


def pack_block(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Windows of one block's items and how many there are: as few as fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window = differencing(sizes, k)
        full = [0] * k
        for w, s in zip(window, sizes, strict=True):
            full[w] += s
        if max(full, default=0) <= capacity:
            return window, k
        k += 1


def cut_points(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` ids: whole windows, then items."""
    out = [(s, window) for s in range(0, n - n % window, window)]
    rest = n - n % window
    return out + [(s, min(piece, n - s)) for s in range(rest, n, piece)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """One row per piece of every document, with the checksum of its ids as 32-bit little-endian integers; ``whole`` numbers whole windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end, row = encoder(tokenizer, drops_space=True, most=1_500_000), np.array([end_id], dtype="<u4").tobytes(), 0
        whole = 0
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, part, ids in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), model.encode(texts), strict=True):
                raw = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() + end
                n = len(raw) // 4
                for s, m in cut_points(n, window, piece):
                    out.append((doc_id, (part << 40) + row, s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), n, (part << 40) + whole if m == window else None))
                    whole += m == window
                row += 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "doc_row", "start", "length", "ids_crc32", "doc_tokens", "whole"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    The blocks' number follows from the number of items, so a block's size is bounded at any scale.
    A document's items may lie in several blocks; a hash of the item decides. Sequences of items are even,
    ``2 * (local * blocks + block)``, and whole windows odd, so they never meet. The pieces are written to
    the shared folder once, because they are counted before they are dealt.
    """
    cut, _ = stash(pieces(docs, tokenizer, end_id, window, piece), "pieces")
    items = cut.where(F.col("whole").isNull())
    blocks = max(1, -(-items.count() // block))
    keyed = items.drop("whole").withColumn("block", F.pmod(F.xxhash64("doc_row", "start", "ids_crc32"), F.lit(blocks)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come one after another, each whole within the partition."""
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            held.sort(key=lambda r: (-r[3], r[1], r[2]))
            windows, k = pack_block([r[3] for r in held], window)
            fill, out = [0] * k, []
            for r, w in zip(held, windows, strict=True):
                out.append((r[0], r[2], r[3], r[4], r[5], 2 * (w * blocks + r[6]), fill[w]))
                fill[w] += r[3]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][6] != r[6]:
                    yield packed()
                    held = []
                held.append(r)
        if held:
            yield packed()

    dealt = keyed.repartition("block").sortWithinPartitions("block")
    some = dealt.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    alone = cut.where(F.col("whole").isNotNull()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("whole") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return some.unionAll(alone)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
