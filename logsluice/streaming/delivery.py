"""Micro-batch delivery: several outputs of one stream, each batch once."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from logsluice.session import checkpoint_dir

BatchWriter = Callable[[DataFrame, int], None]


def fan_out(writers: Mapping[str, BatchWriter]) -> BatchWriter:
    """One foreachBatch function that gives the same micro-batch to every writer.

    The batch is computed once. Writers get the batch id and are expected to replace what an
    earlier attempt with that id left.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for writer in writers.values():
                writer(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def deliver(
    stream: DataFrame, writers: Mapping[str, BatchWriter], name: str, checkpoint: str = "", every: str | None = None
) -> StreamingQuery:
    """Start delivering a stream. ``every`` is the flush interval; None takes what is there and stops.

    Progress is kept in ``checkpoint``, by default a folder of this name in the cluster's shared
    checkpoint folder.
    """
    folder = checkpoint or f"{checkpoint_dir(stream.sparkSession)}/{name}"
    writer = stream.writeStream.queryName(name).foreachBatch(fan_out(writers)).option("checkpointLocation", folder)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
