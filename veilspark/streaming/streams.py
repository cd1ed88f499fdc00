"""The engine on streams. Every document is its own unit, so no state, watermark or shuffle is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import DeidEngine


def anonymize_stream(stream: DataFrame, engine: DeidEngine, text: str = "text") -> DataFrame:
    """A stream of texts with the engine's columns."""
    return engine.anonymize(stream, text)


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet exactly once; ``once`` ends after what is there."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
