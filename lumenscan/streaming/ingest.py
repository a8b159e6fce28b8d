"""Continuous insertion into an entity."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from lumenscan.engine import Engine


def stream_insert(engine: Engine, entity: str, stream: DataFrame, checkpoint: str, available_now: bool = True, interval: str = "10 seconds"):
    """Inserts each micro-batch of a streaming DataFrame once.

    The number of a batch is kept with the entity; a batch that Spark replays
    after a failure and that was already inserted is passed over.
    """

    def insert(batch: DataFrame, number: int) -> None:
        engine.insert(entity, batch, stream_batch=number)

    writer = stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
