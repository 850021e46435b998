"""The store of points by date and hour: late days are reopened, and only what a batch touched is merged again.

Below one folder: ``raw`` has what each batch brought, ``rejected`` what was too old, ``touched`` the dates and hours of each
batch, ``hours`` the merged points. A batch writes folders of its own, which a repeated batch replaces as a
whole; merged hours are a function of the raw rows. So a batch may be repeated after a crash at any point.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import late_reroute

PARTS = ("event_date", "event_hour")
POINT = ("level", "id", "key", "unit")


def _epoch(store: str, kind: str, epoch: int) -> str:
    return f"{store}/{kind}/epoch={epoch:010d}"


def land(points: DataFrame, store: str, epoch: int, today: dt.date, max_age_days: int, closed_before: dt.date, time: str = "timeissued") -> DataFrame:
    """Write a batch: rows that are current, of an open day, or of a closed day young enough; the rest is set aside.

    Returns (event_date, event_hour, route, n): what the batch touched. Rows are dealt by date, hour and a salt, so an
    hour that a third of the rows are in is written by many tasks. Rows without a time are set aside.
    """
    spark = points.sparkSession
    routed = late_reroute(points, today, max_age_days, closed_before, time)
    routed = routed.withColumn("event_hour", F.hour(F.timestamp_seconds(time)))
    taken = F.coalesce(F.col("route") != "reject", F.lit(False)) & F.col("event_date").isNotNull()
    accepted = routed.where(taken)
    accepted.hint("rebalance", *PARTS).write.mode("overwrite").partitionBy(*PARTS).parquet(_epoch(store, "raw", epoch))
    routed.where(~taken).drop("event_hour").write.mode("overwrite").parquet(_epoch(store, "rejected", epoch))
    per = accepted.groupBy(*PARTS, "route").agg(F.count(F.lit(1)).alias("n"))
    path = _epoch(store, "touched", epoch)
    per.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema(per.schema).parquet(path)


def compact(spark: SparkSession, store: str, touched: DataFrame, schema: str, epoch: int, unique: bool = True, key: Sequence[str] = POINT) -> None:
    """Merge the raw rows of the touched dates and hours, up to an epoch; other hours and their files stay as they are.

    With ``unique`` one point per ``key``, date, hour and frame is kept: of the latest batch, then the latest, then the largest
    value. ``schema`` is that of the points. The touched dates and hours prune the raw rows that are read.
    """
    raw = spark.read.schema(f"{schema}, epoch int, {PARTS[0]} date, {PARTS[1]} int").parquet(f"{store}/raw").where(F.col("epoch") <= epoch)
    # at most 24 rows a day and a row per date: a small table
    hit = F.broadcast(touched.select(*PARTS).distinct())
    rows = raw.join(hit, list(PARTS), "left_semi")
    if unique:
        by = [*PARTS, *key, "frame"]
        rest = [c for c in raw.columns if c not in (*by, "epoch")]
        rows = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("epoch", "timeissued", "val")).alias("__r")).select(*by, "__r.*")
    else:
        rows = rows.drop("epoch")
    out = rows.hint("rebalance", *PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*PARTS).parquet(f"{store}/hours")


def ingest(store: str, today: Callable[[int], dt.date], open_days: int, max_age_days: int, unique: bool = True) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: land a batch, then merge what it touched.

    ``today`` gives the date of an epoch, the same again when it is repeated; days older than ``open_days`` are closed and
    reopened by rows of ``max_age_days`` at most.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        day = today(epoch)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
        touched = land(batch, store, epoch, day, max_age_days, day - dt.timedelta(days=open_days))
        compact(batch.sparkSession, store, touched, f"{schema}, route string", epoch, unique)

    return run


def touched_dates(spark: SparkSession, store: str, since: int = 0) -> DataFrame:
    """(event_date, reopened) of the batches from an epoch on: the days whose roll-ups are to be made again."""
    seen = spark.read.parquet(f"{store}/touched").where(F.col("epoch") >= since)
    return seen.groupBy("event_date").agg(F.max(F.col("route") == "reopen").alias("reopened"))
