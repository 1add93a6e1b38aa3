"""Rows that arrive as a stream: each micro-batch is one append, made once however often it is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mosaica.plans.engine import Engine


def ingest(engine: Engine, table: str, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a streaming DataFrame to a table.

    The table's pointer remembers the last batch of the stream (named by its checkpoint) in the same step that
    makes its rows visible, so a batch that Spark runs again after a failure adds nothing.  Text indexes of the table are
    built anew when next asked for.
    """

    def add(batch: DataFrame, number: int) -> None:
        engine.load(table, batch, stream=(checkpoint, number))

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(add).start()
