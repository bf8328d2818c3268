"""New targets matched as they arrive against records that do not change. An extension: batch linkage does not need it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.textnorm import normalize_records
from ..operators import blocking, retrieve


def normalized_stream(raw: DataFrame, watermark: str | None = None, at: str = "arrived") -> DataFrame:
    """Normalization is local to a row, so a stream goes through it as a table does. Re-delivered ids are dropped within the watermark."""
    if watermark:
        raw = raw.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["entity_id"])
    return normalize_records(raw)


def link_stream(records: DataFrame, s1: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Retrieve candidates for each micro-batch of normalized targets; sink gets the pairs and the batch's number."""
    purity = blocking.state_purity(s1)

    def each(batch: DataFrame, number: int) -> None:
        sink(retrieve.retrieve(s1, blocking.target_blocks(batch, purity)), number)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
