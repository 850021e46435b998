"""Sorting, merging, head/tail, numbering and other order reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggs import distinct_first
from .ordered import in_order, number_rows, spread_ties
from .rows import Expr, as_col

# Copies of one value that a task writes out at a time.
COPIES = 100_000
HEAP = 10_000  # rows that the first rows of an input may be without a sort of all


def sort_keys(
    df: DataFrame, keys: Sequence[tuple[str, bool]], *, unique: bool = False, first_by: Sequence[Expr] = ()
) -> DataFrame:
    """Sort by (field, reverse) keys; ``unique`` keeps the first row per key."""
    if unique:
        df = distinct_first(df, [k for k, _ in keys], first_by)
    by = [F.col(k).desc() if rev else F.col(k).asc() for k, rev in keys]
    return df.orderBy(*by, *([] if unique else spread_ties(df)))


def sort_merge(inputs: Sequence[DataFrame], keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Merge inputs on keys, each normal or reverse."""
    out = inputs[0]
    for d in inputs[1:]:
        out = out.unionByName(d)
    return sort_keys(out, keys)


def sort_key(
    c: Column, *, numeric: bool = False, general: bool = False, dictionary: bool = False,
    fold: bool = False, printable: bool = False, blanks: bool = False,
    span: tuple[int, int | None] | None = None,
) -> Column:
    """A key expression with the usual modifiers.

    numeric: leading number, else 0; general: floating number, else below all;
    dictionary: blanks and alphanumerics only; fold: upper case; printable: drop
    control characters; blanks: skip leading blanks; span: 1-based characters.
    """
    if blanks:
        c = F.regexp_replace(c, "^[ \\t]+", "")
    if span:
        lo, hi = span
        c = F.substring(c, F.lit(lo), F.length(c) if hi is None else F.lit(hi - lo + 1))
    if printable:
        c = F.regexp_replace(c, "[^ -~]", "")
    if dictionary:
        c = F.regexp_replace(c, "[^A-Za-z0-9 \\t]", "")
    if fold:
        c = F.upper(c)
    if numeric:
        return F.coalesce(
            F.nullif(F.regexp_extract(c, "^\\s*(-?[0-9]+(?:\\.[0-9]*)?)", 1), F.lit("")).cast("decimal(38,10)"),
            F.lit(0).cast("decimal(38,10)"),
        )
    if general:
        return F.coalesce(
            F.nullif(F.regexp_extract(c, "^\\s*([-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1), F.lit(""))
            .cast("double"),
            F.lit(float("-inf")),
        )
    return c


def sort_check(df: DataFrame, arrival: Sequence[Expr], key: Expr, unique: bool = False) -> DataFrame:
    """Is the input, in arrival order, sorted by ``key`` (strictly, for unique)?"""
    o = in_order(df.withColumn("__key", as_col(key)), arrival).lag("__prev", F.col("__key"))
    bad = F.col("__prev") >= F.col("__key") if unique else F.col("__prev") > F.col("__key")
    return o.rows().agg(
        (F.count_if(F.coalesce(bad, F.lit(False))) == 0).alias("ordered"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("disorders"),
    )


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """Random order by seed. The key is computed from the row and its input partition,
    so that a task that is run again repeats it."""
    return df.orderBy(F.xxhash64(F.lit(seed), *spread_ties(df)))


def head(df: DataFrame, n: int, order: Sequence[Expr], skip: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """The first n rows per input after ``skip``, ties in the order of a row hash.

    Up to ``HEAP`` rows of one input are a bounded heap per partition. Else every input partition keeps its own first
    rows (at most ``skip + n`` per input); what is left of all is numbered, which sorts over many tasks.
    """
    keys = [as_col(o) for o in order]
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = df.withColumns({"__h": F.xxhash64(*[F.col(f"`{c}`") for c in plain]), "__p": F.spark_partition_id()})
    if not by and skip + n <= HEAP:
        out = marked.orderBy(*keys, "__h")
        return (out.offset(skip) if skip else out).limit(n).drop("__h", "__p")
    first = F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*keys, "__h"))
    some = marked.withColumn("__rn", first).where(F.col("__rn") <= skip + n).drop("__rn", "__p")
    out = number_rows(some, [*order, "__h"], "__rn", by).where(F.col("__rn").between(skip + 1, skip + n))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def tail(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The last n rows per input."""
    back = [F.col(o).desc() for o in order]
    return head(df, n, back, by=by)


def reverse_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(o).desc() for o in order])


def reverse_chars(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.reverse(c))


def line_number(
    df: DataFrame, order: Sequence[Expr], *, start: int = 1, increment: int = 1, width: int = 6, name: str = "label"
) -> DataFrame:
    """Number rows in order; the label is right-aligned in ``width``."""
    n = number_rows(df, order, "__rn")
    num = (F.col("__rn") - 1) * increment + start
    text = num.cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)
    return n.withColumn(name, padded).drop("__rn")


def running_extrema(
    df: DataFrame, order: Sequence[Expr], value: str, by: Sequence[str] = (), absolute: bool = False
) -> DataFrame:
    """Records that set a new minimum or maximum of their category so far.

    ``absolute`` gives only the final extremes: the earliest record of each.
    """
    if absolute:
        o = F.struct(*[as_col(x) for x in order])
        rest = [c for c in df.columns if c not in by]
        rec = F.struct(*rest)
        both = df.groupBy(*by).agg(
            F.min_by(rec, F.struct(F.col(value), o)).alias("min"),
            F.min_by(rec, F.struct(-F.col(value), o)).alias("max"),
        )
        parts = [both.select(*by, F.lit(k).alias("kind"), f"{k}.*") for k in ("min", "max")]
        return parts[0].unionByName(parts[1])
    o = in_order(df, order, by)
    o = o.scans({"__lo": (F.col(value), "min", False), "__hi": (F.col(value), "max", False)})
    first = F.col("__lo").isNull()
    kind = F.when(first, F.lit("first")).when(F.col(value) < F.col("__lo"), F.lit("min")).when(
        F.col(value) > F.col("__hi"), F.lit("max")
    )
    return o.rows().withColumn("kind", kind).where("kind is not null").drop("__lo", "__hi")


def comm(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """Multiset comparison: how often each value is only in A, only in B, in both.

    One shuffle on the value instead of three set operations.
    """
    both = a.select(F.col(c).alias("value"), F.lit(1).alias("__a")).unionByName(
        b.select(F.col(c).alias("value"), F.lit(0).alias("__a"))
    )
    n = both.groupBy("value").agg(F.sum("__a").alias("__na"), F.sum(1 - F.col("__a")).alias("__nb"))
    zero = F.lit(0).cast("long")
    return n.select(
        "value",
        F.greatest(F.col("__na") - F.col("__nb"), zero).alias("only_a"),
        F.greatest(F.col("__nb") - F.col("__na"), zero).alias("only_b"),
        F.least("__na", "__nb").alias("both"),
    )


def comm_rows(a: DataFrame, b: DataFrame, c: str, column: str) -> DataFrame:
    """One of the three columns of ``comm`` as rows, with repetition.

    A value with very many copies is written out in blocks by many tasks.
    """
    n = comm(a, b, c).where(F.col(column) > 0).select("value", F.col(column).alias("n"))
    blocks = n.select("value", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("b"))
    spread = blocks.repartition("value", "b")
    size = F.least(F.lit(COPIES), F.col("n") - F.col("b") * COPIES).cast("int")
    return spread.select(F.explode(F.array_repeat("value", size)).alias(c))
