"""A clock stream that brings the index up to date at each tick.

A file stream tells additions only. Here each micro-batch of a clock runs the full comparison of hashes, so edits
and deletions are found as well, and a tick that finds no change, or is repeated after a failure, writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.engine import Engine


def watch(engine: Engine, checkpoint: str, interval: str = "30 seconds", once: bool = False) -> StreamingQuery:
    """Sync with docs_dir every ``interval``; ``once`` handles what is there and stops. A sync that fails ends the stream.

    A sync that takes longer than the interval delays the next one, so two never run together. A checkpoint of the
    older file stream cannot be taken on: name a new one.
    """
    ticks = engine.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def handle(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.sync(lazy=True)

    writer = ticks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
