"""Streams into columns: each micro-batch is one put, repeated batches change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wordmesh.operators.kv import ColumnStore


def put_stream(rows: DataFrame, store: ColumnStore, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Inserts the rows (key, seq, value) of a stream whose keys the column lacks. A batch that is run again finds its keys there."""

    def put(batch: DataFrame, _: int) -> None:
        store.try_put(name, batch)

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
