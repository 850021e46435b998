"""Aggregates written by the user, on frames of rows: partial states in every task before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .aggs import cell_rows


@dataclass(frozen=True)
class UserAggregate:
    """How rows become states, and states one state.

    ``start(rows, keys)`` and ``merge(states, keys)`` take a pandas frame with the key columns and
    return one row per key, with the keys and the columns of ``state`` (DDL). Merging must not
    depend on the order of states. ``finish`` are the result columns, by name, as expressions over the state.
    """

    state: str
    start: Callable[[pd.DataFrame, list[str]], pd.DataFrame]
    merge: Callable[[pd.DataFrame, list[str]], pd.DataFrame]
    finish: dict[str, Column]


def user_aggregate(df: DataFrame, keys: Sequence[str], aggregate: UserAggregate, reads: Sequence[str], held: int = 50_000) -> DataFrame:
    """The columns of ``finish`` per distinct ``keys`` (null is a key), from the columns that ``reads`` names.

    A task starts a state per Arrow batch and merges it into those it holds; beyond ``held`` keys it sends
    them on. So a key with a third of all rows costs a row or a few per task in the shuffle, and a task never
    holds more than ``held`` keys and a batch. After the shuffle states come sorted by key and are merged batch by batch;
    only the last key of a batch waits for the next one. Without keys there is one row if there are rows, else none.
    """
    names = [f"__k{i}" for i in range(len(keys))] or ["__k0"]
    rows = df.select(*([F.col(k).alias(n) for k, n in zip(keys, names, strict=True)] if keys else [F.lit(0).alias("__k0")]), *reads)
    schema = T.StructType([*rows.schema.fields[: len(names)], *T.StructType.fromDDL(aggregate.state).fields])
    columns = schema.fieldNames()
    start, merge = aggregate.start, aggregate.merge

    arrow = to_arrow_schema(schema)

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            if not batch.num_rows:
                continue
            have = _joined(have, start(_frame(batch), names)[columns], merge, names, columns)
            if len(have) > held:
                yield from _batches(have, arrow)
                have = None
        if have is not None:
            yield from _batches(have, arrow)

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = _frame(batch)
            last = frame[names].iloc[-1]
            # a key may be split over batches only at their ends
            have = _joined(have, frame, merge, names, columns)
            waits = pd.Series(True, have.index)
            for n in names:
                waits &= have[n].isna() if pd.isna(last[n]) else (have[n] == last[n])
            yield from _batches(have[~waits], arrow)
            have = have[waits]
        if have is not None:
            yield from _batches(have, arrow)

    dealt = rows.mapInArrow(early, schema).repartition(*names).sortWithinPartitions(*names)
    merged = dealt.mapInArrow(late, schema)
    return merged.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=False)], *[c.alias(n) for n, c in aggregate.finish.items()])


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """Whole numbers stay exact if there are nulls among them."""
    return batch.to_pandas(integer_object_nulls=True)


def _batches(frame: pd.DataFrame, schema: pa.Schema) -> list[pa.RecordBatch]:
    return pa.Table.from_pandas(frame, schema, preserve_index=False).combine_chunks().to_batches()


def _joined(have: pd.DataFrame | None, more: pd.DataFrame, merge: Callable, names: list[str], columns: list[str]) -> pd.DataFrame:
    both = more if have is None or not len(have) else pd.concat([have, more], ignore_index=True)
    return merge(both, names)[columns].reset_index(drop=True)


def key_frame_aggregate(df: DataFrame, cells: Sequence[tuple], aggregate: UserAggregate, split: Sequence[str] = ()) -> DataFrame:
    """``aggregate`` over the column ``val`` of (key, frame) cells, of each dataset that ``split`` names, as ``key_frame_sum`` does with a sum."""
    rows = cell_rows(df, cells, split).select(*split, "c.key", "c.frame", "c.val")
    return user_aggregate(rows, [*split, "key", "frame"], aggregate, ["val"])


def second_largest() -> UserAggregate:
    """``val``: the second largest of the distinct values, null if there is one only; ``top``: the largest. Nulls do not count."""

    def top_two(pairs: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        long = pairs.melt(names, value_name="v")[[*names, "v"]]
        ranked = long.drop_duplicates().sort_values("v", ascending=False, na_position="last")
        place = ranked.groupby(names, dropna=False, sort=False).cumcount()
        ranked = ranked.assign(first=ranked["v"].where(place == 0), second=ranked["v"].where(place == 1))
        return ranked.groupby(names, dropna=False, sort=False)[["first", "second"]].max().reset_index()

    return UserAggregate(
        "first double, second double", lambda rows, names: top_two(rows[[*names, "val"]], names), top_two, {"top": F.col("first"), "val": F.col("second")}
    )
