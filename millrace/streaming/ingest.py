"""Streams that upsert into a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.keyed import KeyedTable


def upsert_stream(stream: DataFrame, table: KeyedTable, checkpoint: str, name: str, **trigger) -> StreamingQuery:
    """Upsert each micro-batch.  The manifest records the last epoch with the batch itself, so a replayed one changes nothing."""

    def batch(rows: DataFrame, epoch: int) -> None:
        table.put(rows, stream=name, epoch=epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
