"""Near-duplicate detection: MinHash bands for candidates, Odd sketches to sift them, whole sets to decide.

1. Every text becomes its set of 5-word shingles, as 64-bit hashes. Texts of equal sets are one class, a
   node of the link graph; only a class's representative goes on, so groups of exact copies of any size
   collapse in a pre-aggregated group-by.
2. ``SAMPLES`` MinHash values per set make ``BANDS`` band keys of ``ROWS`` values each (two texts of
   similarity 0.75 share none of them once in about 200,000 pairs), and an Odd sketch: each (index,
   value) pair flips one of ``BITS`` bits, so two sketches' XOR holds the samples that differ, and its
   population count estimates a high similarity far more precisely than the samples' agreement could
   in the same space.
3. Pivot rounds: each member of a band bucket is compared with one of them, the pivot, and what the
   sketches let pass is confirmed on both full shingle sets, from the texts. Labels are joined after a
   round. While a bucket has over ``BLOCK`` members outside its largest component, a further round takes
   the first of those as pivot, ``ROUNDS`` times at most.
4. What is left are pairs of different components within a bucket. The members of the largest component
   have been joined to each other, so they meet only the others: both kinds are cut into blocks of bounded
   size, and each pair of blocks that may hold a link is compared inside one task, sketches first, then
   full sets. All pairs are decided, but only links that join components come out, so no list of pairs
   exists anywhere, and no link is lost to a cap. The work of this step grows with the members outside the
   largest component times the bucket; the sketches make it 16 words a pair.

Defined results: null or empty texts have no shingles and are linked with nothing; fewer than five words
are one shingle. Rows that share a doc_id are told apart by their texts: links hold between texts, so each
row gets the component of its own. A component's id is the smallest doc_id in it, null if it has none; a row
of null doc_id takes part in links and is not ``kept`` by ``near_duplicates``. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.common import discard, forget_encoders, renamed, slices, stash, table
from strandframe.operators.components import connected_components

WORDS = 5
BANDS, ROWS = 32, 4
SAMPLES, BITS = BANDS * ROWS, 1024
#: Most bits in which sketches of linked texts may differ: similarity 0.75 gives about 60, and 112 lies more than five deviations away.
ODD_LIMIT = 112
#: Members of a block; a task compares two blocks at a time.
BLOCK = 256
#: Pivot rounds beyond the first, for buckets with more than a block of members outside their largest component.
ROUNDS = 4
#: A text is confirmed against so many others at most in one group of a join.
FAN = 1024
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20

U = np.uint64


def _table(seed: int, n: int, kind: type = np.uint64) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, np.iinfo(kind).max, size=n, dtype=kind, endpoint=True)


_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_STEP = U(0x9E3779B97F4A7C15)
_MUL, _ADD = _table(2, SAMPLES, np.uint32) | np.uint32(1), _table(3, SAMPLES, np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z lowered, a piece that ends with a word at a time."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw):
            blank = np.flatnonzero(_SPACE[raw[end : end + PIECE]])
            if len(blank):
                end += int(blank[0])
                break
            end = min(len(raw), end + PIECE)
        out.append(_hashes(raw[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=U)


def _hashes(raw: np.ndarray) -> np.ndarray:
    """Each byte is mixed with its place in its word, the words' sums are mixed again: no arithmetic of the bytes survives that words could share."""
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    place = (np.flatnonzero(inside) - np.repeat(start, size)).astype(U)
    mixed = mix(((place << U(8)) | raw[inside]) * _STEP + U(1))
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(mixed, dtype=U)])
    stop = np.cumsum(size)
    return mix(sums[stop] - sums[stop - size] + size.astype(U))


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < WORDS:
        h = np.array([len(w)], dtype=U)
        for x in w:
            h = h * _STEP + x
        return mix(h)
    h = np.zeros(len(w) - WORDS + 1, dtype=U)
    for k in range(WORDS):
        h = h * _STEP + w[k : len(w) - WORDS + 1 + k]
    return np.unique(mix(h + U(WORDS)))


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.iinfo(np.uint32).max, dtype=np.uint32)
    x = (s >> U(32)).astype(np.uint32)
    for a in range(0, len(x), 1024):
        np.minimum(out, (x[a : a + 1024, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=U)
    for column in sig.reshape(BANDS, ROWS).astype(U).T:
        h = mix(h * _STEP + column)
    return h.astype(np.int64)


def odd_sketch(sig: np.ndarray) -> bytes:
    """Parity of how many (index, value) pairs fall on each bit."""
    at = mix(sig.astype(U) + (np.arange(SAMPLES, dtype=U) << U(32))) % U(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def odd_similarity(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two sets from their sketches' XOR."""
    z = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    if 2 * z >= BITS:
        return 0.0
    return max(0.0, 1 - float(np.log(1 - 2 * z / BITS) / np.log(1 - 2 / BITS)) / 2 / SAMPLES)


FEATURES = "doc_id long, th long, tl int, n_shingles long, digest binary, bands array<long>, marks binary, sketch binary"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes of the text (96 bits): with the id, they tell rows of different content apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("th"), F.hash(text).alias("tl"))


def features(docs: DataFrame) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in slices(batches, "text"):
            n, digest, bands, marks, sketch = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                n.append(len(s))
                if len(s):
                    sig = minhash(s)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(sig))
                    marks.append(bands[-1].astype(np.uint32).tobytes())
                    sketch.append(odd_sketch(sig))
                else:
                    digest.append(None)
                    bands.append(None)
                    marks.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), batch.column("tl"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(sketch, pa.binary())],
                names=["doc_id", "th", "tl", "n_shingles", "digest", "bands", "marks", "sketch"],
            )

    return keyed(docs).mapInArrow(made, FEATURES)


def sift(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow the similarity. ``known``: (node, n, sketch)."""
    side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").where((4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=U).reshape(-1, BITS // 64) for c in ("sa", "sb"))
            near = np.bitwise_count(x ^ y).sum(axis=1) <= ODD_LIMIT
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return j.select("a", "b", "sa", "sb").mapInArrow(close, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs (a table in the shared folder) with ``100 * |A & B| >= percent * |A | B|`` on full shingle sets.

    A pivot ``a`` comes once before its partners, so its text is not copied for each of them; one of many
    pairs is given to several groups of about ``FAN`` of them.
    """

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, dtype=U)
        for batch in slices(batches, "text"):
            keep = []
            for b, text in zip(batch.column("b").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingles(text)
                if b is None:
                    pivot = found
                    keep.append(False)
                    continue
                both = len(np.intersect1d(pivot, found, assume_unique=True))
                keep.append(100 * both >= percent * (len(pivot) + len(found) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
    pivots = texts.join(fans, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("slice"), F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("slice"), "b")
    partners = right.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "slice", "b", "text")
    rows = pivots.unionAll(partners).repartition("a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
    return rows.mapInArrow(exact, "a long, b long")


KEYS = ["key", "i", "j"]
GROUPED = "key long, i int, j int, band int, own int, node long, label long, n long, sketch binary, marks binary"


def grouped(members: DataFrame) -> DataFrame:
    """Buckets cut into blocks of about ``BLOCK`` members, first those of the largest component, then the others'.

    Each pair of blocks, and each block by itself, is a group of its own, but for those that hold the
    largest component alone.
    """
    first, rest = F.ceil(F.col("most") / BLOCK).cast("int"), F.ceil(F.col("others") / BLOCK).cast("int")
    at, main = F.xxhash64("node"), F.col("label") == F.col("main")
    own = F.when(main, F.pmod(at, first)).otherwise(first + F.pmod(at, rest)).cast("int")
    other = F.explode(F.when(main, F.sequence(first, first + rest - 1)).otherwise(F.sequence(F.lit(0), first + rest - 1)))
    m = members.withColumn("own", own).withColumn("other", other)
    return m.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "own", "node", "label", "n", "sketch", "marks")


def candidates(rows: list[tuple]) -> np.ndarray:
    """Index pairs of a group's rows that may be linked: labels differ, sizes and sketches allow it, and no
    earlier band holds both (which would compare them there)."""
    i, j, band = rows[0][1], rows[0][2], rows[0][3]
    ids, labels, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in (5, 6, 7))
    sk = np.frombuffer(b"".join(r[8] for r in rows), dtype=U).reshape(-1, BITS // 64)
    marks = np.frombuffer(b"".join(r[9] for r in rows), dtype=np.uint32).reshape(-1, BANDS)[:, :band]
    side = np.array([r[4] for r in rows]) == i
    left = np.arange(len(rows)) if i == j else np.flatnonzero(side)
    right = left if i == j else np.flatnonzero(~side)
    out = []
    for at in range(0, len(left), 64):
        l = left[at : at + 64]  # noqa: E741
        ok = (labels[l][:, None] != labels[right][None, :]) & (4 * np.minimum(n[l][:, None], n[right][None, :]) >= 3 * np.maximum(n[l][:, None], n[right][None, :]))
        if i == j:
            ok &= ids[l][:, None] < ids[right][None, :]
        x, y = np.nonzero(ok)
        for part in range(0, len(x), 1 << 15):
            p, q = l[x[part : part + (1 << 15)]], right[y[part : part + (1 << 15)]]
            near = np.bitwise_count(sk[p] ^ sk[q]).sum(axis=1) <= ODD_LIMIT
            p, q = p[near], q[near]
            new = ~(marks[p] == marks[q]).any(axis=1)
            out.append(np.stack([p[new], q[new]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """A partition's rows, sorted by their first three columns, group by group."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != r[:3]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def shared_counts(sets: dict[int, np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Intersection sizes of many pairs; many at once by products of incidence matrices, a range of shingles at a time."""
    if len(pairs) < 500:
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in pairs.tolist()], dtype=np.int64)
    rows = np.unique(pairs)
    at = {int(r): k for k, r in enumerate(rows)}
    every, column = np.unique(np.concatenate([sets[int(r)] for r in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(sets[int(r)]) for r in rows])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    counts = np.zeros((len(rows), len(rows)), dtype=np.float32)
    for start in range(0, len(every), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        m = np.zeros((len(rows), min(4096, len(every) - start)), dtype=np.float32)
        m[row[a:b], column[a:b] - start] = 1
        counts += m @ m.T
    index = np.array([[at[int(p)], at[int(q)]] for p, q in pairs])
    return counts[index[:, 0], index[:, 1]].astype(np.int64)


def forest(rows: list[tuple], pairs: np.ndarray) -> list[tuple[int, int]]:
    """Of confirmed pairs, those that join two components of the group."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for p, q in pairs.tolist():
        a, b = find(rows[p][6]), find(rows[q][6])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((rows[p][5], rows[q][5]))
    return out


def cross_links(members: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """Links between different labels within buckets: all of them are decided, those of a forest come out.

    First the sketches tell which rows of a group have a candidate at all; only those get their texts.
    Each pair is decided in the first band that holds both, inside the group, so no pair is a row.
    """

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_groups(batches):
            kept = [rows[k] for k in np.unique(candidates(rows))]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), KINDS, strict=True)], names=NAMES)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_groups(batches):
            pairs = candidates(rows)
            sets = {int(k): shingles(rows[k][10]) for k in np.unique(pairs)}
            both = shared_counts(sets, pairs)
            sizes = {k: len(v) for k, v in sets.items()}
            total = np.array([sizes[p] + sizes[q] for p, q in pairs.tolist()], dtype=np.int64)
            found = forest(rows, pairs[100 * both >= percent * (total - both)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    NAMES = ["key", "i", "j", "band", "own", "node", "label", "n", "sketch", "marks"]
    KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    sifted, at = stash(grouped(members).repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(having, GROUPED), "neardup-groups")
    whole = sifted.join(texts, "node").select(*NAMES, "text")
    found, found_at = stash(whole.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(decided, "a long, b long"), "neardup-links")
    discard(members.sparkSession, at)
    return found, found_at


def divided(rows: DataFrame) -> DataFrame:
    """(key, main, most, others): buckets of more than one component, the largest of these, its members there and the others'."""
    each = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    g = each.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("total"), F.count("*").alias("labels")).where("labels > 1")
    return g.select("key", F.col("m.label").alias("main"), F.col("m.c").alias("most"), (F.col("total") - F.col("m.c")).alias("others"))


class Classes:
    """What ``classes`` finds: ``rows`` (doc_id, th, tl, n_shingles, digest), and ``nodes`` (digest, node, component, o, copies)."""

    def __init__(self, rows: DataFrame, nodes: DataFrame) -> None:
        self.rows, self.nodes = rows, nodes

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """``rows`` with ``nodes(digest, ...)``, null where there is no shingle.

        A digest of more than a thousandth of all rows is one of fewer than a thousand, so those are
        broadcast; no other digest is hot.
        """
        rows, total = self.rows, self.rows.count()
        hot = nodes.where(F.col("copies") * 1000 > total).drop("copies")
        some, none = rows.where("digest IS NOT NULL"), rows.where("digest IS NULL")
        cold = some.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(nodes.drop("copies"), "digest")
        return cold.unionByName(some.join(F.broadcast(hot), "digest")).unionByName(none, allowMissingColumns=True)


def classes(docs: DataFrame, percent: int = 75) -> Classes:
    """Link the classes of equal shingle sets and label their components."""
    spark, gone = docs.sparkSession, []

    def kept(df: DataFrame, what: str) -> DataFrame:
        df, at = stash(df, what)
        gone.append(at)
        return df

    feats, _ = stash(features(docs), "neardup-features")
    usable = feats.where(F.col("digest").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "tl"))
    any_of = F.first(F.struct(F.col("n_shingles").alias("n"), "sketch", "marks", "bands"))
    reps, _ = stash(usable.groupBy("digest").agg(first.alias("o"), any_of.alias("r"), F.count("*").alias("copies")).select("digest", "o", "copies", "r.*", F.monotonically_increasing_id().alias("node")), "neardup-classes")
    known = reps.select("node", "n", "sketch", "marks")

    banded = reps.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n_members")).where("n_members > 1")
    members = kept(banded.join(buckets, "key").select("key", "band", "pivot", "node"), "neardup-buckets")
    wanted = reps.join(members.select("node").distinct(), "node").select("node", F.col("o.doc_id").alias("id"), F.col("o.th").alias("wh"), F.col("o.tl").alias("wl"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("wh")) & (F.col("tl") == F.col("wl"))
    texts = keyed(docs).join(wanted, same).select("node", "text")
    if usable.groupBy("doc_id", "th", "tl").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["node"])
    texts = kept(texts, "neardup-texts")

    star = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = kept(confirm(kept(sift(star, known), "neardup-pairs"), texts, percent), "neardup-links")

    def labelled() -> tuple[DataFrame, DataFrame | None]:
        labels = connected_components(links) if links.limit(1).count() else None
        rows = members.select("key", "band", "node")
        if labels is None:
            return kept(rows.withColumn("label", F.col("node")), "neardup-labels"), None
        rows = rows.join(labels, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("label"))
        return kept(rows, "neardup-labels"), labels

    rows, labels = labelled()
    parts = kept(divided(rows), "neardup-divided")
    for _ in range(ROUNDS):
        wide = parts.where(F.col("others") > BLOCK)
        if not wide.limit(1).count():
            break
        unsettled = rows.join(wide, "key")
        pivots = unsettled.where("label <> main").groupBy("key").agg(F.min(F.struct("node", "label")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.label").alias("own"))
        pairs = unsettled.join(pivots, "key").where("label <> own").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        more = kept(confirm(kept(sift(pairs, known), "neardup-pairs"), texts, percent), "neardup-links")
        if not more.limit(1).count():
            break
        links = links.unionAll(more)
        rows, labels = labelled()
        parts = kept(divided(rows), "neardup-divided")
    found, found_at = cross_links(rows.join(parts, "key").join(known, "node"), texts, percent)
    gone.append(found_at)
    if found.limit(1).count():
        labels = connected_components(links.unionAll(found))
    nodes = reps.select("digest", "node", "o", "copies")
    nodes = nodes.withColumn("component", F.col("node")) if labels is None else nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes, _ = stash(nodes.select("digest", "node", "component", "o", "copies"), "neardup-nodes")
    discard(spark, *gone)
    return Classes(feats.select("doc_id", "th", "tl", "n_shingles", "digest"), nodes)


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, a row per document."""
    c = classes(docs, percent)
    least = c.nodes.groupBy("component").agg(F.min("o.doc_id").alias("component_id"))
    nodes = c.nodes.join(least, "component").select("digest", "component_id", "copies")
    out = c.labelled(nodes)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group, all columns as they are: the one of the smallest doc_id, rows without one coming last.

    Rows of one doc_id with unrelated texts stay, each for itself; of rows that repeat a doc_id and a text,
    one stays (the first by its columns as JSON). Documents without shingles are in no group and all stay.
    """
    plain, name = renamed(docs)
    mine = plain.select(F.col(name["doc_id"]).cast("long").alias("doc_id"), F.col(name["text"]).alias("text"))
    c = classes(mine, percent)
    winners = c.nodes.groupBy("component").agg(F.min("o").alias("w"))
    rows = c.labelled(c.nodes.join(winners, "component").select("digest", "w", "copies")).where("digest IS NOT NULL")
    key = lambda x: F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("th"), F.col("tl")).eqNullSafe(F.col(x))
    lost = rows.where(~key("w")).select(F.col("doc_id").alias("id"), F.col("th").alias("wh"), F.col("tl").alias("wl")).distinct()
    text = F.coalesce(F.col(name["text"]), F.lit(""))
    left = plain.withColumns({"_th": F.xxhash64(text), "_tl": F.hash(text), "_id": F.col(name["doc_id"]).cast("long")})
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("wh")) & (F.col("_tl") == F.col("wl"))
    left = left.join(lost, same, "left_anti")
    repeated = c.rows.where("digest IS NOT NULL").groupBy(F.col("doc_id").alias("id"), F.col("th").alias("wh"), F.col("tl").alias("wl")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if repeated.limit(1).count():
        whole = F.struct(*plain.columns)
        once = left.join(repeated, same, "left_semi").groupBy("_id", "_th", "_tl").agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
        left = left.join(repeated, same, "left_anti").select(*plain.columns).unionByName(once)
    return left.select(*plain.columns).toDF(*docs.columns)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
