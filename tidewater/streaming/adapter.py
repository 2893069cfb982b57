"""Structured Streaming into a table: each micro-batch is appended, then the views over it are refreshed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewater.database import Database


def stream_into(db: Database, stream: DataFrame, table: str, checkpoint: str, views: list[str] | None = None, order: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Late rows are corrections, never dropped. A batch that is delivered again after a failure is appended once: the version of the table that
    holds a batch names it, so both are published by one rename. A batch belongs to the stream of its checkpoint folder."""

    def batch(df: DataFrame, number: int) -> None:
        db.table(table).append_frame(df, order, (checkpoint, number))
        for v in views or []:
            db.refresh_view(v)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
