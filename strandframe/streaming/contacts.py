"""Contact counting over a stream of alignments: whole reads arrive together, so each micro-batch is paired by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandframe.operators.contacts import contact_map, usable


def contact_stream(alignments: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, min_mapq: int = 0) -> StreamingQuery:
    """Give each micro-batch's contact map to ``sink(contacts, batch_id)``; sums over batches are the whole map."""
    return usable(alignments, min_mapq).writeStream.foreachBatch(lambda df, n: sink(contact_map(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
