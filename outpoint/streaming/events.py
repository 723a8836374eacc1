"""The event feed of peers, routed by type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import materialize

# Fixed values.
EVENT_TYPES = ["Connected", "Disconnected", "Addr", "Tx", "Block", "Headers", "Inv"]
INV_TX, INV_BLOCK = 1, 2


def route(events: DataFrame) -> dict[str, DataFrame]:
    """One branch per event type."""
    return {kind: events.filter(F.col("event_type") == kind) for kind in EVENT_TYPES}


def split_inventory(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transactions, blocks) that inventory objects offer."""
    return objects.filter(F.col("code") == INV_TX), objects.filter(F.col("code") == INV_BLOCK)


def route_stream(
    events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, **trigger
) -> StreamingQuery:
    """Hand each micro-batch of a streaming feed to the handlers of its types.

    The batch is written once, by type, so the source is read once however
    many handlers there are, and each handler reads only its own types.
    """

    def apply(df: DataFrame, batch: int) -> None:
        branches = route(materialize(df, "events", ("event_type",)))
        for kind, handler in handlers.items():
            handler(branches[kind], batch)

    return (
        events.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def append_batches(folder: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Handler that writes the rows ``make`` gives, one folder per micro-batch."""

    def handle(df: DataFrame, batch: int) -> None:
        make(df).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return handle
