"""Projection, filtering, conversion, composition and validation of rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import number_rows

Expr = str | Column
Transform = Callable[[DataFrame], DataFrame]


def as_col(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def truth(p: Expr) -> Column:
    """A predicate with unknown taken as false."""
    return F.coalesce(as_col(p), F.lit(False))


def extract_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.select(*fields)


def filter_expr(df: DataFrame, keep: Expr, assign: Mapping[str, Expr] | None = None) -> DataFrame:
    """Keep rows by a predicate on the input fields, and rewrite fields."""
    out = df.where(truth(keep))
    return out.withColumns({k: as_col(v) for k, v in assign.items()}) if assign else out


def convert_schema(
    df: DataFrame, emits: Sequence[tuple[Expr | None, Mapping[str, Expr]]], schema: T.StructType | None = None
) -> DataFrame:
    """Map every input row to 0..n output rows.

    ``emits`` holds (condition or None, {out field: expression}); a condition that
    is not true emits nothing.
    """
    fields = list(emits[0][1])
    structs = [
        F.when(truth(cond) if cond is not None else F.lit(True),
               F.struct(*[as_col(cols[f]).alias(f) for f in fields]))
        for cond, cols in emits
    ]
    if len(structs) == 1:
        cond, cols = emits[0]
        src = df.where(truth(cond)) if cond is not None else df
        out = src.select(*[as_col(cols[f]).alias(f) for f in fields])
    else:
        one = F.explode(F.filter(F.array(*structs), lambda s: s.isNotNull())).alias("__o")
        out = df.select(one).select("__o.*")
    return conform(out, schema) if schema else out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a target schema; fields that are missing become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def choose_by_index(
    df: DataFrame, order: Sequence[Expr], index: DataFrame, index_col: str = "idx"
) -> DataFrame:
    """Rows whose 0-based ordinal in ``order`` is in the index table."""
    wanted = index.select((F.col(index_col) + 1).cast("long").alias("__rn")).distinct()
    return number_rows(df, order, "__rn").join(wanted, "__rn", "left_semi").drop("__rn")


def choose_by_file_index(df: DataFrame, index: DataFrame) -> DataFrame:
    """The same relative to files: ``index`` holds (file name, 0-based idx).

    Uses the row positions the Parquet reader knows, so nothing is sorted.
    """
    keyed = df.select("*", F.col("_metadata.file_name").alias("__f"), F.col("_metadata.row_index").alias("__i"))
    idx = index.select(F.col("file").alias("__f"), F.col("idx").cast("long").alias("__i")).distinct()
    return keyed.join(idx, ["__f", "__i"], "left_semi").drop("__f", "__i")


def even_odd(df: DataFrame, order: Sequence[Expr], parity: str) -> DataFrame:
    """Rows with an even or odd 1-based ordinal."""
    want = {"even": 0, "odd": 1}[parity]
    return number_rows(df, order, "__rn").where(F.col("__rn") % 2 == want).drop("__rn")


# --- predicates -----------------------------------------------------------------


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """``=~``: the whole value matches."""
    return c.rlike(f"{'(?i)' if ignore_case else ''}^(?:{pattern})$")


def nested(path: str, default: object) -> Column:
    """A dotted member, with 0 or '' when it is missing."""
    return F.coalesce(F.col(path), F.lit(default))


def search_any(
    df: DataFrame,
    conditions: Sequence[tuple[str, str]],
    *,
    ignore_case: bool = False,
    every: bool = False,
    time_col: str | None = None,
    time_range: tuple[object, object] | None = None,
) -> DataFrame:
    """Generic search: (field, regular expression) conditions, any or every."""
    flag = "(?i)" if ignore_case else ""
    tests = [F.col(k).cast("string").rlike(flag + rx) for k, rx in conditions]
    p = F.lit(every)
    for t in tests:
        p = (p & t) if every else (p | t)
    if time_col and time_range:
        p = F.col(time_col).between(*time_range) & p
    return df.where(truth(p))


def search_keys(
    df: DataFrame, key: str, keys: DataFrame, key_col: str = "key",
    time_col: str | None = None, time_range: tuple[object, object] | None = None,
) -> DataFrame:
    """Generic search: exact key in a list, within a time range."""
    src = df.where(F.col(time_col).between(*time_range)) if time_col and time_range else df
    wanted = keys.select(F.col(key_col).alias("__k")).distinct()
    return src.join(wanted, src[key] == F.col("__k"), "left_semi")


def in_time_ranges(df: DataFrame, time_col: str, ranges: Sequence[tuple[object, object]]) -> DataFrame:
    """Rows in any of n inclusive ranges. The ranges are literals, so they reach the scan."""
    p = F.lit(False)
    for lo, hi in merge_ranges(ranges):
        p = p | F.col(time_col).between(lo, hi)
    return df.where(p)


def merge_ranges(ranges: Sequence[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def prefix_lookup(
    df: DataFrame, c: str, prefix: str, *, dictionary: bool = False, ignore_case: bool = False
) -> DataFrame:
    """Lines that start with ``prefix``; a plain prefix reaches the scan."""
    if not dictionary and not ignore_case:
        return df.where(F.col(c).startswith(prefix))
    v, p = F.col(c), prefix
    if dictionary:
        v, p = F.regexp_replace(v, "[^\\p{L}\\p{N}\\s]", ""), re.sub(r"[^\w\s]", "", prefix)
    if ignore_case:
        v, p = F.lower(v), p.lower()
    return df.where(v.startswith(p))


# --- composition ----------------------------------------------------------------


def pipe(df: DataFrame, *steps: Transform) -> DataFrame:
    """``A|B``: each step sees what the one before selected."""
    for s in steps:
        df = df.transform(s)
    return df


def branch(
    df: DataFrame, select: Expr, then: Transform | None = None, otherwise: Transform | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """``A?B:C``: B over selected rows, C over the rejected; either may be left out."""
    p = truth(select)
    return (
        then(df.where(p)) if then else None,
        otherwise(df.where(~p)) if otherwise else None,
    )


def fanout(df: DataFrame, *steps: Transform) -> list[DataFrame]:
    """``A;B``: every step over the same input."""
    return [df.transform(s) for s in steps]


def callout(df: DataFrame, fn: Callable, schema: T.StructType | None = None) -> DataFrame:
    """User code per batch of records: accept, change, delete or insert rows.

    ``fn`` maps a pandas frame to a pandas frame; Spark feeds it Arrow batches of
    every partition, ahead of a sort or any other operator.
    """

    def run(batches):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema or df.schema)


def count_selected(df: DataFrame, select: Expr) -> DataFrame:
    """Matched and total rows in one pass."""
    return df.agg(F.count_if(truth(select)).alias("matched"), F.count(F.lit(1)).alias("total"))


# --- validation -----------------------------------------------------------------


@dataclass(frozen=True)
class Constraint:
    """What a valid field looks like. ``default`` is what repair puts in."""

    name: str
    min: float | None = None
    max: float | None = None
    pattern: str | None = None
    expression: str | None = None
    members: Sequence | None = None
    default: object = None

    def valid(self) -> Column:
        c, ok = F.col(self.name), F.lit(True)
        if self.min is not None:
            ok = ok & (c >= F.lit(self.min))
        if self.max is not None:
            ok = ok & (c <= F.lit(self.max))
        if self.pattern is not None:
            ok = ok & matches(c.cast("string"), self.pattern)
        if self.expression is not None:
            ok = ok & F.expr(self.expression)
        if self.members is not None:
            ok = ok & c.isin(list(self.members))
        return F.coalesce(ok, F.lit(False))


def validate_discard(df: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    p = F.lit(True)
    for c in constraints:
        p = p & c.valid()
    return df.where(p)


def validate_repair(df: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """Put the default into invalid fields; rows that cannot be repaired are dropped."""
    hopeless = F.lit(False)
    for c in constraints:
        if c.default is None:
            hopeless = hopeless | ~c.valid()
    fixed = {
        c.name: F.when(c.valid(), F.col(c.name)).otherwise(F.lit(c.default).cast(df.schema[c.name].dataType))
        for c in constraints
        if c.default is not None
    }
    return df.where(~hopeless).withColumns(fixed)


def validate_list(df: DataFrame, constraints: Sequence[Constraint]) -> list[tuple[str, str]]:
    """The constraints in words, per field of ``df``."""
    out = []
    for c in constraints:
        if c.name in df.columns:
            parts = [f"{k}={getattr(c, k)}" for k in ("min", "max", "pattern", "expression", "members", "default")
                     if getattr(c, k) is not None]
            out.append((c.name, " ".join(parts)))
    return out


def validate_summary(df: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """Count per invalid (field, value).

    The first invalid field of a row is the one reported.
    """
    first = F.lit(None)
    for c in reversed(constraints):
        bad = F.struct(F.lit(c.name).alias("field"), F.col(c.name).cast("string").alias("value"))
        first = F.when(~c.valid(), bad).otherwise(first)
    return (
        df.select(first.alias("__b"))
        .where("__b is not null")
        .groupBy("__b.field", "__b.value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def validate_totals(df: DataFrame, constraints: Sequence[Constraint], mode: str = "none") -> DataFrame:
    """Invalid, discarded and repaired counts per field."""
    s = validate_summary(df, constraints).groupBy("field").agg(F.sum("count").alias("invalid"))
    repairable = [c.name for c in constraints if c.default is not None]
    fix = F.col("field").isin(repairable) if repairable and mode == "repair" else F.lit(False)
    zero = F.lit(0).cast("long")
    drop = ~fix if mode in ("discard", "repair") else F.lit(False)
    return s.select(
        "field",
        "invalid",
        F.when(drop, F.col("invalid")).otherwise(zero).alias("discarded"),
        F.when(fix, F.col("invalid")).otherwise(zero).alias("repaired"),
    )
