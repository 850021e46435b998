"""Bounds on what tasks and executors hold at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few fixed-size columns that may be sent to every executor (some tens of MB).
BROADCAST_ROWS = 500_000


def counted(stored_rows: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """A written table of short rows, marked for broadcast if it has ``limit`` rows at most.

    A larger one takes part in a shuffle join; the result is the same. The count comes
    from the footers of the Parquet files. ``weight`` is what a row counts for, if rows hold lists.
    """
    size = stored_rows.count() if weight is None else stored_rows.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(stored_rows) if size <= limit else stored_rows


#: Rows of an Arrow batch of texts.
ARROW_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of ``ARROW_ROWS`` rows at most: with the default of 10,000, long texts fill the workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
