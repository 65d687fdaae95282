"""Count-or-timeout batches: nearest neighbours and recommendations for a stream of queries.

A trigger's processing time is the timeout, the source's files (or rows) per trigger the batch size.
Each micro-batch is a whole query against the static side; writing it by its batch id makes a replayed
batch replace its own output.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cellweave.operators.knn import nearest


def serve(requests: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, timeout: str | None = "1 second") -> StreamingQuery:
    """Apply work to each micro-batch of the stream and write its rows under out/batch=<id>."""

    def each(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=timeout) if timeout else writer.trigger(availableNow=True)
    return writer.start()


def serve_neighbors(requests: DataFrame, collection: DataFrame, k: int, out: str, checkpoint: str, timeout: str | None = "1 second", normalise: bool = False) -> StreamingQuery:
    """Nearest neighbours of streamed (key, vec) queries; the same rows as nearest() on all of them."""
    return serve(requests, lambda batch: nearest(batch, collection, k, normalise), out, checkpoint, timeout)
