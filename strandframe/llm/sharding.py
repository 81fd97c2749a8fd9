"""Sharding over fixed virtual slots, in built-in DataFrame functions only.

A document's id is hashed into one of ``SLOTS`` virtual slots, which never change. Bytes and rows are
aggregated per slot; that table has ``SLOTS`` rows at most, whatever the input, so it may come to the
driver, which keeps a *versioned* map of slots to shards in a folder: ``version=0`` deals the slots in
turn, and each later version is an edit of the one before. ``rebalance`` moves single slots until the
sizes are close again, ``grow`` moves slots to a new shard only. Assignment applies the version that was
read from the folder, so any reader of an older version can tell where a document was then.

The law kept is ``bytes``: sizes of the shards are near equal. A document beyond the mean size of a
shard cannot be split, so its shard stays as heavy as its slot.

Defined results: null text has 16 bytes and the checksum of nothing; rows of null doc_id are
spread over all slots by their place in the scan; repeated rows go to the same shard at places of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.llm.common import fresh_path, stash, table

SLOTS, SHARDS, OVERHEAD = 16_384, 40, 16
#: The map is edited when shards differ by more than this share of their mean.
TOLERANCE = 0.002


def virtual_slot(doc_id: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """What is needed to place a document; the text stays where it is.

    Rows without an id have no key of their own, so they are dealt over all slots by their number in the
    scan; the caller writes the table before it is read twice, which fixes that number.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    spread = F.when(F.col("doc_id").isNotNull(), virtual_slot(F.col("doc_id"), slots)).otherwise(virtual_slot(F.monotonically_increasing_id(), slots))
    return docs.select("doc_id", (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), spread.alias("virtual_slot"))


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) of the slots that have any: ``SLOTS`` entries at most."""
    return {r.virtual_slot: (r.b, r.n) for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def lookup(values: list[int], slot: Column) -> Column:
    """``values[slot]``, from a literal of fixed-width digits, which is found by position."""
    width = max(len(str(v)) for v in values)
    digits = "".join(f"{v:0{width}d}" for v in values).encode()
    return F.substring(F.lit(digits), slot * width + 1, F.lit(width)).cast("string").cast("long")


class SlotMap:
    """A version of the slot-to-shard map, held as one small list."""

    def __init__(self, shard: list[int], shards: int, version: int = 0) -> None:
        self.shard, self.shards, self.version = shard, shards, version

    @classmethod
    def dealt(cls, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """Version 0, made before any size is known: the slots one after another."""
        return cls([k % shards for k in range(slots)], shards)

    @classmethod
    def balanced(cls, sizes: dict[int, tuple[int, int]], shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        """Largest slot first, to the lightest shard (fewest slots, then lowest number, when equal)."""
        heap = [(0, 0, s) for s in range(shards)]
        shard = [0] * slots
        for slot in sorted(range(slots), key=lambda k: (-sizes.get(k, (0, 0))[0], k)):
            b, n, s = heapq.heappop(heap)
            shard[slot] = s
            heapq.heappush(heap, (b + sizes.get(slot, (0, 0))[0], n + 1, s))
        return cls(shard, shards)

    def loads(self, sizes: dict[int, tuple[int, int]]) -> list[int]:
        out = [0] * self.shards
        for slot, (b, _) in sizes.items():
            out[self.shard[slot]] += b
        return out

    def drift(self, sizes: dict[int, tuple[int, int]]) -> float:
        """How much the heaviest shard exceeds the mean, as a share of it."""
        load = self.loads(sizes)
        return max(load) * self.shards / max(1, sum(load)) - 1

    def rebalance(self, sizes: dict[int, tuple[int, int]], tolerance: float = TOLERANCE) -> SlotMap:
        """The next version: slots move, one at a time, from the heaviest shard to the lightest.

        The slot that moves is the one whose size comes nearest to half of the gap, so each edit narrows it
        as far as one slot can. A shard that no move can lighten (a slot beyond the mean fills it) is set
        aside, and the others are levelled without it.
        """
        shard, load = list(self.shard), self.loads(sizes)
        own: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, (b, _) in sizes.items():
            if b:
                bisect.insort(own[shard[slot]], (b, slot))
        level = set(range(self.shards))
        while len(level) > 1:
            a, b = max(level, key=lambda s: (load[s], -s)), min(level, key=lambda s: (load[s], s))
            gap = load[a] - load[b]
            if gap <= tolerance * sum(load[s] for s in level) / len(level):
                break
            at = bisect.bisect_left(own[a], (gap // 2, -1))
            fit = [x for x in own[a][max(0, at - 1) : at + 1] if x[0] < gap]
            if not fit:
                level.discard(a)
                continue
            moved = min(fit, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
            own[a].remove(moved)
            bisect.insort(own[b], moved)
            shard[moved[1]] = b
            load[a] -= moved[0]
            load[b] += moved[0]
        return SlotMap(shard, self.shards, self.version + 1)

    def grow(self, sizes: dict[int, tuple[int, int]]) -> SlotMap:
        """One more shard, filled from the heaviest ones; no slot moves between the old shards."""
        shard, load, new = list(self.shard), [*self.loads(sizes), 0], self.shards
        own: list[list[int]] = [[] for _ in range(self.shards)]
        for slot in sorted(sizes, key=lambda k: (sizes[k][0], k)):
            own[shard[slot]].append(slot)
        mean = sum(load) / (new + 1)
        while load[new] < mean:
            a = max((s for s in range(new) if own[s]), key=lambda s: (load[s], -s), default=None)
            if a is None:
                break
            k = own[a].pop()
            if load[new] + sizes[k][0] > 1.05 * mean and load[new]:
                break
            shard[k] = new
            load[a] -= sizes[k][0]
            load[new] += sizes[k][0]
        return SlotMap(shard, new + 1, self.version + 1)

    def column(self, slot: Column) -> Column:
        """The map as a literal: ``SLOTS`` small integers in the plan."""
        return lookup(self.shard, slot).cast("int")

    def frame(self, spark: SparkSession) -> DataFrame:
        """(virtual_slot, shard, shards) rows of this version."""
        return spark.range(len(self.shard)).select(F.col("id").cast("int").alias("virtual_slot"), self.column(F.col("id").cast("int")).alias("shard"), F.lit(self.shards).alias("shards"))

    def store(self, spark: SparkSession, path: str) -> None:
        """Write this version beside the earlier ones; a version is never written twice."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest one if none is named."""
        maps = spark.read.parquet(path)
        at = maps.agg(F.max("version")).first()[0] if version is None else version
        rows = maps.where(F.col("version") == at).collect()  # one row a slot
        if sorted(r.virtual_slot for r in rows) != list(range(len(rows))) or not rows:
            raise ValueError(f"version {at} of the slot map at {path} is not whole")
        shard = [0] * len(rows)
        for r in rows:
            shard[r.virtual_slot] = r.shard
        return cls(shard, rows[0].shards, at)


def current_map(spark: SparkSession, path: str, sizes: dict[int, tuple[int, int]], shards: int = SHARDS, slots: int = SLOTS, tolerance: float = TOLERANCE) -> SlotMap:
    """The latest stored map, edited and stored as the next version if the sizes have drifted from it.

    Where no map is stored yet, version 0 is. What is applied is always what was read back.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        SlotMap.dealt(shards, slots).store(spark, path)
    found = SlotMap.load(spark, path)
    if sizes and found.drift(sizes) > tolerance:
        edited = found.rebalance(sizes, tolerance)
        if edited.shard != found.shard:
            edited.store(spark, path)
            found = SlotMap.load(spark, path, edited.version)
    return found


def assign(rows: DataFrame, slot_map: SlotMap, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Shard and gapless place in it: the rows of the shard's earlier slots, plus the place within the slot."""
    before, used = [0] * len(slot_map.shard), [0] * slot_map.shards
    for slot in sorted(sizes):
        before[slot] = used[slot_map.shard[slot]]
        used[slot_map.shard[slot]] += sizes[slot][1]
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.select("*", slot_map.column(F.col("virtual_slot")).alias("shard"), (lookup(before, F.col("virtual_slot")) + place).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = stash(sized(table(spark, sf_dir, "documents")), "sized")
    sizes = slot_sizes(rows)
    out = assign(rows, current_map(spark, fresh_path(spark, "slot-map"), sizes), sizes)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
