"""Keeps an index fresh: a trigger by processing time, whose batches run one after another."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from repograph.engine import Engine


def watch(engine: Engine, interval: str = "300 milliseconds") -> StreamingQuery:
    """Changes that come while a batch runs are found by the next one. A batch that finds none writes nothing."""
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.trigger(processingTime=interval).foreachBatch(lambda _, k: engine.index() and None).start()
