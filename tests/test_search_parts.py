"""One part of a search's graph: what a task holds of it, and the search in it."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from strandframe.operators import phasing


def part_of(units, pairs, weights, own, seed):
    """Packed rows of a connected graph in the order in which a task gets them, and the same graph as ``search`` takes it."""
    rng = np.random.default_rng(seed)
    k = len(units)
    x = np.unique(rng.integers(0, k * k, pairs))
    a, b = np.divmod(x, k)
    a, b = a[a < b], b[a < b]
    w = weights(rng, len(a))
    rows = np.array([(p, q) for p, q in zip([*a, *b, *range(k)], [*b, *a, *range(k)], strict=True)])
    w2 = np.concatenate([w, w, np.full(k, own)])
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows, w2 = rows[order], w2[order]
    columns = [np.full(len(rows), 5), units[rows[:, 0]] // 4000, units[rows[:, 0]], units[rows[:, 1]], w2]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 10_000]) for c in columns], names=["part", "range", "a", "b", "w"]) for i in range(0, len(rows), 10_000)]
    blocks = [r for batch in phasing.packed(iter(batches)) for r in batch.to_pylist()]
    assert [(r["a0"], r["b0"]) for r in blocks] == sorted((r["a0"], r["b0"]) for r in blocks) and {r["part"] for r in blocks} == {5}
    edges = np.concatenate([np.stack([a, b], 1), np.repeat(np.arange(k)[:, None], 2, 1)])
    return blocks, 2 * len(edges), edges, np.concatenate([w, np.full(k, own)])


def filled(blocks, room):
    part = phasing.Part(room)
    for r in blocks:
        part.add(*(np.frombuffer(r[x], kind) for x, kind in zip("anbw", ["i8", "i8", *r["kinds"].split()], strict=True)))
    return part


@pytest.mark.parametrize(("first", "weights", "own", "bytes_each"), [
    (7, lambda rng, n: rng.integers(-9, 10, n).astype(float), 2.0, 6),
    (7, lambda rng, n: rng.integers(-(10**6), 10**6, n).astype(float), 0.0, 14),
    (2**40, lambda rng, n: rng.normal(size=n), 0.25, 28),
])
def test_a_large_part_is_held_in_few_bytes_and_searched_as_before(monkeypatch, first, weights, own, bytes_each):
    monkeypatch.setattr(phasing, "CONTACTS", 50_000)
    units = first + 7 * np.arange(2000)
    blocks, room, edges, w = part_of(units, 800_000, weights, own, 1)
    phasing.search(edges[:10], w[:10], np.arange(2000), np.ones(2000), 1, 0)  # nothing is loaded while it is measured
    tracemalloc.start()
    part = filled(blocks, room)
    names, *graph = part.ended()
    signs, score = phasing.climb(*graph, 3, 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (names == units).all()
    want, best = phasing.search(edges, w, np.arange(2000), np.ones(2000), 3, 11)
    assert (signs == want).all() and score + part.own == pytest.approx(best)
    assert score == pytest.approx((w * signs[edges[:, 0]] * signs[edges[:, 1]])[:-2000].sum())
    assert peak < bytes_each * room + 3_000_000
