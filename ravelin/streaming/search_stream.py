"""A stream of queries (qid, q) against an index: each micro-batch is one batch search, handed to a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ravelin.index import VectorIndex


def search_stream(queries: DataFrame, index: VectorIndex, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10, nprobe: int = 2, **trigger) -> StreamingQuery:
    """sink gets (results, batch number); with a sink that overwrites by batch number, each query is answered once."""

    def answer(batch: DataFrame, number: int) -> None:
        sink(index.search_batch(batch, k, nprobe), number)

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
