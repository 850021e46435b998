"""Counting, summing, statistics and the line-oriented aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import Expr, as_col

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def count_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def sum_by_key(
    df: DataFrame, keys: Sequence[str], value: str, first_by: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Sum per key; ``keep`` fields come from the first row in ``first_by`` order."""
    aggs = [F.sum(value).alias(value)]
    if keep:
        aggs.append(F.min_by(F.struct(*keep), F.struct(*first_by)).alias("__first"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, value, *[F.col(f"__first.{k}").alias(k) for k in keep])


def key_frame_sum(
    df: DataFrame, cells: Sequence[tuple[Expr, Expr, Expr]], split: Sequence[str] = ()
) -> DataFrame:
    """Add values to (key, frame) cells; one row may add to several cells.

    ``split`` columns give one dataset per distinct value (use with
    ``sink_split_by_key``).
    """
    return (
        cell_rows(df, cells, split)
        .groupBy(*split, F.col("c.key").alias("key"), F.col("c.frame").alias("frame"))
        .agg(F.sum("c.val").alias("val"))
    )


def cell_rows(df: DataFrame, cells: Sequence[tuple[Expr, Expr, Expr]], split: Sequence[str] = ()) -> DataFrame:
    """The ``split`` columns and ``c``, a struct (key, frame, val), for every cell that a row adds to; frames below 0 are none."""
    structs = [
        F.struct(
            as_col(k).cast("string").alias("key"), as_col(f).cast("int").alias("frame"), as_col(v).cast("double").alias("val")
        )
        for k, f, v in cells
    ]
    if len(structs) == 1:
        rows = df.select(*split, structs[0].alias("c"))
    else:
        rows = df.select(*split, F.explode(F.array(*structs)).alias("c"))
    return rows.where("c.frame >= 0")


def distinct_first(df: DataFrame, keys: Sequence[str], first_by: Sequence[Expr]) -> DataFrame:
    """One record per key, the first in ``first_by`` order.

    ``min_by`` is combined before the shuffle, so hot keys cost one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*[as_col(o) for o in first_by])).alias("__r")
    out = df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest])
    return out.select(*df.columns)


def stats(
    df: DataFrame, by: Sequence[str] = (), fields: Sequence[str] | None = None,
    max_groups: int = 100, first_by: Sequence[str] = (),
) -> DataFrame:
    """Count, sum, average, unbiased deviation, min and max of numeric fields.

    Long form: one row per (group, field). ``group`` shows the group's values with commas, NULL
    as nothing; groups that look alike are rows of their own. Groups beyond the first
    ``max_groups``, in the order they are first seen by ``first_by``, are merged in OVERFLOW.
    """
    if fields is None:
        fields = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in by]
    aggs: list[Column] = []
    for f in fields:
        v = F.col(f).cast("double")
        aggs += [
            F.count(v).alias(f"{f}__n"), F.sum(v).alias(f"{f}__s"),
            (F.var_pop(v) * F.count(v)).alias(f"{f}__m2"),
            F.min(v).alias(f"{f}__lo"), F.max(v).alias(f"{f}__hi"),
        ]
    if not by:
        return _long_stats(df.agg(*aggs).withColumn("group", F.lit("")), fields, ["group"]).drop("group")
    order = F.min(F.struct(*first_by) if first_by else F.struct(*by)).alias("__o")
    per = df.groupBy(*by).agg(*aggs, order)
    # top-k by first sight: at most max_groups rows, whatever the number of groups
    named = per.orderBy("__o", *by).limit(max_groups).select(*[F.col(b).alias(f"__g{i}") for i, b in enumerate(by)])
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & per[b].eqNullSafe(F.col(f"__g{i}"))
    label = F.concat_ws(",", *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by])
    known = F.broadcast(named.withColumn("__known", F.lit(True)))
    # an id of the group besides its label: groups with one label, or named OVERFLOW, stay apart
    marked = per.join(known, same, "left").withColumns(
        {
            "group": F.when(F.col("__known"), label).otherwise(F.lit("OVERFLOW")),
            "__id": F.when(F.col("__known"), F.struct(*by)),
        }
    )
    merged: list[Column] = []
    for f in fields:
        n, s, m2 = F.col(f"{f}__n"), F.col(f"{f}__s"), F.col(f"{f}__m2")
        # only OVERFLOW has several parts: M2 = sum(m2 + s^2/n) - S^2/N
        many = F.sum(m2 + s * s / F.nullif(n, F.lit(0))) - F.sum(s) * F.sum(s) / F.nullif(F.sum(n), F.lit(0))
        merged += [
            F.sum(n).alias(f"{f}__n"), F.sum(s).alias(f"{f}__s"),
            F.when(F.count(F.lit(1)) == 1, F.sum(m2)).otherwise(many).alias(f"{f}__m2"),
            F.min(f"{f}__lo").alias(f"{f}__lo"), F.max(f"{f}__hi").alias(f"{f}__hi"),
        ]
    return _long_stats(marked.groupBy("group", "__id").agg(*merged), fields, ["group"])


def _long_stats(wide: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    one = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field"), F.col(f"{f}__n").alias("n"), F.col(f"{f}__s").alias("s"),
                    F.col(f"{f}__m2").alias("m2"), F.col(f"{f}__lo").alias("lo"), F.col(f"{f}__hi").alias("hi"),
                )
                for f in fields
            ]
        )
    ).alias("x")
    sdev = F.when(F.col("x.n") > 1, F.sqrt(F.greatest(F.col("x.m2"), F.lit(0.0)) / (F.col("x.n") - 1)))
    return wide.select(*keys, one).select(
        *keys,
        F.col("x.field").alias("field"),
        F.col("x.n").alias("count"),
        F.col("x.s").alias("sum"),
        (F.col("x.s") / F.nullif(F.col("x.n"), F.lit(0))).alias("average"),
        F.when(F.col("x.n") > 0, F.coalesce(sdev, F.lit(0.0))).alias("deviation"),
        F.col("x.lo").alias("min"),
        F.col("x.hi").alias("max"),
    )


def sort_count(df: DataFrame, keys: Sequence[str], minimum: int = 1) -> DataFrame:
    return count_by_key(df, keys).where(F.col("count") >= minimum)


def sort_summarise(
    df: DataFrame, keys: Sequence[str], fields: Mapping[str, str], weight: str | None = None
) -> DataFrame:
    """Collapse equal keys; per field one of max, min, avg, sum, wcount.

    ``wcount`` is the average weighted by the ``weight`` field.
    """
    fns = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}
    aggs = []
    for f, how in fields.items():
        if how == "wcount":
            aggs.append((F.sum(F.col(f) * F.col(weight)) / F.sum(weight)).alias(f))
        else:
            aggs.append(fns[how](f).alias(f))
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("count"))


def uniq(
    df: DataFrame, line: str, mode: str, *, skip_fields: int = 0, skip_chars: int = 0,
    width: int | None = None, ignore_case: bool = False, first_by: Sequence[Expr] | None = None,
) -> DataFrame:
    """Equal lines of sorted input: ``count``, ``repeated``, ``all_repeated``, ``unique``.

    Lines are compared on what is left after skipping leading fields and
    characters, at most ``width`` characters of it.
    """
    key = F.col(line)
    if skip_fields:
        key = F.regexp_replace(key, f"^(?:\\s*\\S+){{0,{skip_fields}}}", "")
    if skip_chars:
        key = F.substring(key, F.lit(skip_chars + 1), F.length(key))
    if width is not None:
        key = F.substring(key, 1, width)
    if ignore_case:
        key = F.lower(key)
    whole = not (skip_fields or skip_chars or width is not None or ignore_case)
    order = F.struct(*[as_col(o) for o in (first_by or [line])])
    keyed = df.withColumn("__k", key)
    if whole:
        # the line is its own key: a plain hash count
        per = keyed.groupBy("__k").agg(F.count(F.lit(1)).alias("count")).withColumn(line, F.col("__k"))
    else:
        per = keyed.groupBy("__k").agg(F.min_by(line, order).alias(line), F.count(F.lit(1)).alias("count"))
    if mode == "count":
        return per.select("count", line)
    if mode == "repeated":
        return per.where("count > 1").select(line)
    if mode == "unique":
        return per.where("count = 1").select(line)
    dup = per.where("count > 1").select("__k")
    return keyed.join(dup, "__k", "left_semi").drop("__k")


def word_count(df: DataFrame, text: str, by: str) -> DataFrame:
    """Lines, words, bytes, characters and the longest line per input and in total.

    ``df`` has one text per row; line ends inside a text count, as does the end
    of a text that does not end in one.
    """
    t = F.col(text)
    body = F.regexp_replace(t, "\n$", "")
    per = df.select(
        by,
        F.size(F.split(body, "\n")).cast("long").alias("lines"),
        F.size(F.regexp_extract_all(t, F.lit(r"(\S+)"), F.lit(1))).cast("long").alias("words"),
        F.octet_length(t).cast("long").alias("bytes"),
        F.length(t).cast("long").alias("chars"),
        F.array_max(F.transform(F.split(body, "\n"), lambda s: F.length(s))).cast("long").alias("longest"),
    )
    sums = [F.sum(c).alias(c) for c in ("lines", "words", "bytes", "chars")]
    return (
        per.rollup(by)
        .agg(*sums, F.max("longest").alias("longest"), F.grouping(by).alias("__g"))
        .withColumn(by, F.when(F.col("__g") == 1, F.lit("total")).otherwise(F.col(by).cast("string")))
        .drop("__g")
    )


def infer_widths(df: DataFrame) -> DataFrame:
    """Average and maximum text width per column, in one pass."""
    aggs = []
    for c in df.columns:
        n = F.length(F.coalesce(F.col(c).cast("string"), F.lit("")))
        aggs += [F.avg(n).alias(f"{c}__a"), F.max(n).alias(f"{c}__m")]
    wide = df.agg(*aggs)
    rows = [
        F.struct(F.lit(c).alias("field"), F.col(f"{c}__a").alias("average"), F.col(f"{c}__m").alias("maximum"))
        for c in df.columns
    ]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def usage_by_day(log: DataFrame, ts: str, tool: str, user: str, kind: Expr) -> DataFrame:
    """Users, requests and filtered requests per day and tool."""
    return log.groupBy(F.to_date(ts).alias("day"), F.col(tool).alias("tool")).agg(
        F.count_distinct(user).alias("users"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(as_col(kind)).alias("filtered"),
    )
