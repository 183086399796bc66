"""Streams whose records or rows are interned as they come.

A layer's ids follow the order of arrival: batch by batch, and in a batch by the order column. A batch that is delivered again,
as Spark does after a failure, finds its records in the layer and adds nothing, so each record is interned once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.layers import Layer


def insert_stream(stream: DataFrame, layer: Layer, kind: str, identity: Sequence[str], order: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Intern a stream's records of a kind into a layer; the running query takes what is there and ends (availableNow).

    each: called with every batch's result of Layer.insert (identity..., id, layer, created) and the batch's number.
    """

    def batch(rows: DataFrame, number: int) -> None:
        out = layer.insert(kind, rows, identity, order)
        if each:
            each(out, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def insert_row_stream(stream: DataFrame, layer: Layer, pool: str, values: Sequence[str], order: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """The same for rows of a pool: a batch with a value that doesn't fit its column ends the query and adds nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        out = layer.insert_rows(pool, rows, values, order)
        if each:
            each(out, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
