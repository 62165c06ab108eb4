"""Referential integrity of streams: every micro-batch changes the kept counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.orphans import ReferenceState, Referrer


def maintain(stream: DataFrame, of: Referrer, state: ReferenceState, checkpoint: str, once_only: bool = True) -> StreamingQuery:
    """Take a stream of log rows into ``state``; a replayed micro-batch has its old name and does nothing."""
    w = stream.writeStream.foreachBatch(lambda batch, n: state.apply(f"{of.table}-{n}", (batch, of))).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once_only else w).start()
