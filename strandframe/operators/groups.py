"""Imperative work on whole groups, many small ones at a time: a partition's groups come one after another, without a call of pandas for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
#: Rows of an output batch, about.
ROWS = 20_000


def map_groups(rows: DataFrame, key: str, run: Callable[[object, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``run(key, rows)`` for every value of the column ``key``, the rows being tuples of the other columns; a group must fit a task."""
    rest = [c for c in rows.columns if c != key]
    fields = [f.split() for f in schema.split(", ")]
    names, kinds = [f[0] for f in fields], [_KINDS[f[1]] for f in fields]

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for k, *r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and k != now:
                    out += run(now, held)
                    held = []
                    if len(out) >= ROWS:
                        yield made(out)
                        out = []
                now = k
                held.append(tuple(r))
        if held:
            out += run(now, held)
        if out:
            yield made(out)

    return rows.select(key, *rest).repartition(key).sortWithinPartitions(key).mapInArrow(go, schema)
