"""Linking a stream of names against a static table, with a fixed threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.link import link


def link_stream(stream: DataFrame, right: DataFrame, path: str, checkpoint: str, *, max_dist: float, trigger_available_now: bool = True, **options) -> StreamingQuery:
    """Link each micro-batch of stream with right and append the links to a Parquet table.

    The threshold is fixed, as calibration needs a bounded table. A batch that is run again overwrites its own folder,
    so every batch counts once.
    """

    def one(batch: DataFrame, number: int) -> None:
        link(batch, right, max_dist=max_dist, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_available_now else writer).start()
