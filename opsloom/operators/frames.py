"""Keyed-frame arrays: key x frame -> value, in long form.

A dataset is ``DataFrame(key, frame, val)``; a cell that is absent is 0. Every
operator here keeps to partial aggregation on (key, frame), so a key that holds a
third of the cells costs one row per task and cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import Expr, as_col
from .sorts import head

OPS = ("add", "sub", "mul", "div", "min", "max", "wavg")


def load(
    df: DataFrame, key: Expr, values: Sequence[Expr], frame: Expr | None = None, average: bool = False
) -> DataFrame:
    """(key[, frame]) lines with several value columns.

    Without ``frame`` the i-th value column is frame i; with it, several values
    are consecutive frames from ``frame``. Duplicates are summed or averaged.
    """
    base = as_col(frame).cast("int") if frame is not None else F.lit(0)
    agg = F.avg if average else F.sum
    cells = [
        F.struct((base + i).alias("frame"), as_col(v).cast("double").alias("val"))
        for i, v in enumerate(values)
    ]
    k = as_col(key).cast("string").alias("key")
    rows = df.select(k, F.explode(F.array(*cells)).alias("c")).select("key", "c.frame", "c.val")
    return rows.groupBy("key", "frame").agg(agg("val").alias("val"))


def frame_count(ds: DataFrame) -> Column:
    """Number of frames of a dataset (its highest frame + 1), as a value of the plan."""
    return ds.agg(F.coalesce(F.max("frame") + 1, F.lit(0))).scalar()


def cat(datasets: Sequence[DataFrame], counts: Sequence[int] | None = None) -> DataFrame:
    """Append along the frame axis; ``counts`` are the frame counts if known."""
    counts = [F.lit(n) for n in counts] if counts is not None else [frame_count(d) for d in datasets[:-1]]
    out, off = None, F.lit(0)
    for i, d in enumerate(datasets):
        part = d.select("key", (F.col("frame") + off).cast("int").alias("frame"), "val")
        out = part if out is None else out.unionByName(part)
        off = off + counts[i] if i < len(counts) else off
    return out


def _tagged(datasets: Sequence[DataFrame]) -> DataFrame:
    out = None
    for i, d in enumerate(datasets):
        part = d.select("key", "frame", F.col("val").cast("double").alias("val"), F.lit(i).alias("__i"))
        out = part if out is None else out.unionByName(part)
    return out


def combine(op: str, datasets: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Cell-wise arithmetic over datasets; an absent cell counts as 0.

    A product or quotient is 0 unless the cell is present in all inputs, and a
    quotient by 0 is 0.
    """
    if op not in OPS:
        raise ValueError(op)
    n = len(datasets)
    vs = [F.sum(F.when(F.col("__i") == i, F.col("val"))).alias(f"v{i}") for i in range(n)]
    cells = _tagged(datasets).groupBy("key", "frame").agg(*vs)
    v = [F.coalesce(F.col(f"v{i}"), F.lit(0.0)) for i in range(n)]
    present = F.lit(True)
    for i in range(n):
        present = present & F.col(f"v{i}").isNotNull()
    val = v[0]
    if op == "add":
        for x in v[1:]:
            val = val + x
    elif op == "sub":
        for x in v[1:]:
            val = val - x
    elif op == "mul":
        for x in v[1:]:
            val = val * x
        val = F.when(present, val).otherwise(F.lit(0.0))
    elif op == "div":
        for x in v[1:]:
            val = F.coalesce(F.try_divide(val, x), F.lit(0.0))
        val = F.when(present, val).otherwise(F.lit(0.0))
    elif op in ("min", "max") and n > 1:
        val = (F.least if op == "min" else F.greatest)(*v)
    elif op == "wavg":
        w = list(weights) if weights else [1.0] * n
        val = sum((x * F.lit(float(a)) for x, a in zip(v, w)), F.lit(0.0)) / F.lit(float(sum(w)))
    return cells.select("key", "frame", val.alias("val"))


def mean_sdev(datasets: Sequence[DataFrame]) -> DataFrame:
    """Mean and sample deviation per cell over the datasets, absent = 0.

    The absent zeros are folded in: with c of n values present and their mean m,
    M2 = M2_present + m^2 c (n-c) / n.
    """
    n = len(datasets)
    one = None
    for i, d in enumerate(datasets):
        part = d.groupBy("key", "frame").agg(F.sum("val").cast("double").alias("val"))
        one = part if one is None else one.unionByName(part)
    c, m, m2 = F.col("__c"), F.col("__m"), F.col("__v") * F.col("__c")
    total = m2 + m * m * c * (n - c) / n
    sdev = F.sqrt(F.greatest(total, F.lit(0.0)) / (n - 1)) if n > 1 else F.lit(0.0)
    return (
        one.groupBy("key", "frame")
        .agg(F.count("val").alias("__c"), F.avg("val").alias("__m"), F.var_pop("val").alias("__v"))
        .select("key", "frame", (m * c / n).alias("mean"), sdev.alias("sdev"))
    )


def _collapse(ds: DataFrame, by: str, how: str, size: Column) -> DataFrame:
    v = F.sum("val") if how == "add" else (F.min if how == "min" else F.max)("val")
    out = ds.groupBy(by).agg(v.alias("val"), F.count(F.lit(1)).alias("__n"))
    if how != "add":
        pick = F.least if how == "min" else F.greatest
        # some cell of the row is absent, that is 0
        out = out.withColumn("val", F.when(F.col("__n") < size, pick("val", F.lit(0.0))).otherwise(F.col("val")))
    return out.drop("__n")


def sum_frames(ds: DataFrame, how: str = "add", n_frames: int | None = None) -> DataFrame:
    """Collapse the frames of every key with add, min or max."""
    size = F.lit(n_frames) if n_frames is not None else ds.agg(F.max("frame") + 1).scalar()
    return _collapse(ds, "key", how, size)


def sum_items(ds: DataFrame, how: str = "add", n_keys: int | None = None) -> DataFrame:
    """Collapse the keys of every frame with add, min or max."""
    size = F.lit(n_keys) if n_keys is not None else ds.agg(F.count_distinct("key")).scalar()
    return _collapse(ds, "frame", how, size)


def reaggregate(ds: DataFrame, key_map: DataFrame) -> DataFrame:
    """Map keys through (key, newkey) and add; keys without an entry are dropped."""
    m = key_map.select("key", F.col("newkey")).distinct()
    return (
        ds.join(m, "key")
        .groupBy(F.col("newkey").alias("key"), "frame")
        .agg(F.sum("val").alias("val"))
    )


def extract(ds: DataFrame, keys: DataFrame) -> DataFrame:
    return ds.join(keys.select("key").distinct(), "key", "left_semi")


def print_select(
    ds: DataFrame, key: str | None = None, frame: int | None = None
) -> DataFrame:
    """The cells of one key and/or frame."""
    out = ds
    if key is not None:
        out = out.where(F.col("key") == key)
    if frame is not None:
        out = out.where(F.col("frame") == frame)
    return out


def topn(
    ds: DataFrame, n: int, largest: bool = True, frames: tuple[int, int] | None = None, value: Sequence[str] = ("val",)
) -> DataFrame:
    """Top n cells over a frame range; several value columns compare in order."""
    src = ds.where(F.col("frame").between(*frames)) if frames else ds
    order = [F.col(v).desc() if largest else F.col(v).asc() for v in value]
    return head(src, n, [*order, "frame", "key"])

