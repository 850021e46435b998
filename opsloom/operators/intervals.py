"""Ranges that overwrite each other, or lie in each other, as disjoint segments.

The ends of all ranges are cut into chunks of about equal numbers. A range gives its first and its last chunk a piece;
the chunks between are covered whole, and of all ranges that cover a chunk only the one that counts most matters. That
one is found over aligned blocks of chunks, at most two per bit, reduced in the map tasks. So no chunk
sees more than the ends that lie in it, however many ranges reach over it or start at one point.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .ordered import in_order

CHUNK = 50_000  # ends of ranges that one task sweeps at a time
CHUNKS = 20_000  # at most so many chunks: their bounds are numbers that go to every task


def flat_segments(ranges: DataFrame, lo: str, hi: str, value: str, order: str, per_chunk: int = CHUNK) -> DataFrame:
    """(lo, hi, value): what is left when the ranges are set one after the other.

    A later range (by ``order``, ties by the larger value) overwrites what it overlaps; a null value erases. Neighbours
    with equal values are merged. Both ends are included; ranges with a null end or lo above hi are left out.
    """
    return _segments(ranges, lo, hi, value, F.struct(F.col(order).alias("a"), F.lit(0).cast("bigint").alias("b")), per_chunk)


def nested_segments(ranges: DataFrame, lo: str, hi: str, value: str, order: str, per_chunk: int = CHUNK) -> DataFrame:
    """(lo, hi, value): every point belongs to the smallest range that holds it.

    Of equal ranges the later one (by ``order``, then the larger value) counts. Ranges should lie in or beside each other;
    of ranges that cross, the shorter one counts where they overlap. Neighbours with equal values are merged.
    """
    size = F.col(hi).cast("bigint") - F.col(lo).cast("bigint")
    return _segments(ranges, lo, hi, value, F.struct((-size).alias("a"), F.col(order).alias("b")), per_chunk)


def _segments(ranges: DataFrame, lo: str, hi: str, value: str, weight: Column, per_chunk: int) -> DataFrame:
    kind = ranges.schema[value].dataType.simpleString()
    rows = ranges.select(
        F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi"),
        weight["a"].cast("bigint").alias("a"), weight["b"].cast("bigint").alias("b"), F.col(value).alias("value"),
    ).where("lo <= hi")
    best = F.max(F.struct("a", "b", "value"))
    # copies of a range count once
    rows = stored(rows.groupBy("lo", "hi").agg(best.alias("w")).select("lo", "hi", "w.*"), "ranges")
    n = 2 * rows.count()
    pieces = min(CHUNKS, max(1, -(-n // per_chunk)))
    ends = rows.select(F.explode(F.array("lo", "hi")).alias("e"))
    cuts = []
    if pieces > 1:
        shares = [i / pieces for i in range(1, pieces)]
        cuts = sorted(set(ends.agg(F.percentile_approx("e", shares, 10 * pieces)).first()[0]))
    place = _placer(np.array(cuts, np.int64))
    placed = stored(rows.mapInPandas(place, f"block int, at bigint, lo bigint, hi bigint, a bigint, b bigint, value {kind}"), "range-pieces")
    local = placed.where("block < 0").groupBy("at", "lo", "hi").agg(best.alias("w"))
    whole = placed.where("block >= 0").groupBy("block", "at").agg(best.alias("w"))
    count = len(cuts) + 1
    bits = max(1, count.bit_length())
    # every chunk looks at the blocks that hold it: one row per chunk and bit
    asked = rows.sparkSession.range(count).select(F.col("id").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("block"))
    asked = asked.withColumn("at", F.expr("shiftright(chunk, block)"))
    base = asked.join(whole, ["block", "at"]).groupBy("chunk").agg(F.max("w").alias("w"))
    edges = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    first = F.when(F.col("chunk") > 0, F.element_at(edges, F.col("chunk").cast("int")))
    last = F.when(F.col("chunk") < count - 1, F.element_at(edges, F.col("chunk").cast("int") + 1) - 1)
    everywhere = base.where((F.col("chunk") > 0) & (F.col("chunk") < count - 1)).select(F.col("chunk").alias("at"), first.alias("lo"), last.alias("hi"), "w")
    work = local.unionByName(everywhere).select("at", "lo", "hi", "w.*")
    swept = work.groupBy("at").applyInPandas(_sweep, f"lo bigint, hi bigint, value {kind}")
    return merge_neighbours(swept)


def _placer(cuts: np.ndarray):
    """Ranges to pieces: in their first and last chunk (block -1), and blocks of the chunks between."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lo, hi = pdf["lo"].to_numpy(np.int64), pdf["hi"].to_numpy(np.int64)
            a, b = np.searchsorted(cuts, lo, "right"), np.searchsorted(cuts, hi, "right")
            one = a == b
            yield pdf[one].assign(block=-1, at=a[one])[_PIECE]
            far = pdf[~one]
            if not len(far):
                continue
            a, b = a[~one], b[~one]
            yield far.assign(block=-1, at=a, hi=cuts[a] - 1)[_PIECE]
            yield far.assign(block=-1, at=b, lo=cuts[b - 1])[_PIECE]
            # [first, end) as aligned blocks, from small to large
            row, first, end, k = np.arange(len(far)), a + 1, b.copy(), 0
            while len(row):
                row, first, end = (x[first < end] for x in (row, first, end))
                odd = (first & 1) == 1
                yield far.iloc[row[odd]].assign(block=k, at=first[odd])[_PIECE]
                first = first + odd
                odd = ((end & 1) == 1) & (first < end)
                yield far.iloc[row[odd]].assign(block=k, at=end[odd] - 1)[_PIECE]
                end = end - odd
                first, end, k = first >> 1, end >> 1, k + 1

    return run


_PIECE = ["block", "at", "lo", "hi", "a", "b", "value"]


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """The segments of one chunk: at every end the open range that counts most."""
    known = pdf["value"].notna()
    order = pdf.assign(v=pdf["value"].where(known, None)).sort_values(["a", "b"], kind="stable")
    lo, hi, value = order["lo"].tolist(), order["hi"].tolist(), [v if k else None for v, k in zip(order["value"].tolist(), order["value"].notna().tolist())]
    # ranges are numbered by weight; equal weights by value
    starts = sorted(range(len(lo)), key=lambda i: lo[i])
    points = sorted({*lo, *(h + 1 for h in hi)})
    heap: list[int] = []
    out: list[list] = []
    k = 0
    for p, nxt in zip(points, points[1:]):
        while k < len(starts) and lo[starts[k]] <= p:
            heapq.heappush(heap, -starts[k])
            k += 1
        while heap and hi[-heap[0]] < p:
            heapq.heappop(heap)
        if not heap:
            continue
        v = value[-heap[0]]
        if v is None:
            continue
        if out and out[-1][1] == p - 1 and out[-1][2] == v:
            out[-1][1] = nxt - 1
        else:
            out.append([p, nxt - 1, v])
    return pd.DataFrame(out, columns=["lo", "hi", "value"])


def merge_neighbours(segments: DataFrame, value: str = "value") -> DataFrame:
    """Disjoint (lo, hi, value) with neighbours of equal values made one, without a single-task window."""
    o = in_order(segments, ["lo"]).lag("__p", F.struct("hi", F.col(value).alias("v")))
    joins = (F.col("__p.hi") + 1 == F.col("lo")) & F.col("__p.v").eqNullSafe(F.col(value))
    o = o.with_columns({"__new": F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)})
    rows = o.scan("__run", F.col("__new").cast("bigint"), "sum").rows()
    return rows.groupBy("__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.any_value(value).alias(value)).drop("__run")


def innermost_join(points: DataFrame, point: str, segments: DataFrame, columns: Sequence[str] = ("value",), how: str = "inner") -> DataFrame:
    """Points with the segment that holds them: segments are disjoint, so each point meets one at most."""
    from .joins import interval_join

    return interval_join(points, point, segments.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), *columns), "__lo", "__hi", how).drop("__lo", "__hi")
