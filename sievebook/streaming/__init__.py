"""Batch screening over streams; an addition, not a capability of the reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.fuzzy import screen


def screen_stream(lines: DataFrame, indexed: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, threshold: float = 0.88):
    """Screen each micro-batch of (row_no, raw) lines and hand the results to ``write``."""

    def each(batch: DataFrame, number: int) -> None:
        write(screen(batch, indexed, threshold), number)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
