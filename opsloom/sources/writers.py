"""Sinks: split, group, tee, table, formatted text, conversion and export."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import Expr, as_col, conform
from ..plans.dashboard import hide_attributes
from ..session import scratch, stored


def sink_split_by_key(df: DataFrame, path: str, keys: Sequence[str], mode: str = "append", fmt: str = "parquet") -> None:
    """One output folder per key combination.

    Rows are rebalanced on the keys: a folder gets few files, small keys share a task, and
    a key with a large share of the rows is written by many tasks. Replacing is
    per key that occurs in ``df``.
    """
    out = df.hint("rebalance", *[F.col(k) for k in keys])
    w = out.write.partitionBy(*keys).format(fmt)
    if mode == "overwrite":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.mode(mode).save(path)


def sink_group_by_expr(df: DataFrame, path: str, group: Expr, mode: str = "append") -> None:
    """One output per non-negative group number; other rows are left out."""
    g = as_col(group).cast("int")
    sink_split_by_key(df.withColumn("grp", g).where("grp >= 0"), path, ["grp"], mode)


def sink_tee(df: DataFrame, sinks: Sequence[Callable[[DataFrame], None]]) -> None:
    """Send the same rows to several sinks, computing the input once.

    The rows are a table in the shared folder meanwhile, which goes when all sinks are done.
    """
    with scratch(df.sparkSession):
        kept = stored(df, "tee")
        for s in sinks:
            s(kept)


def sink_table(df: DataFrame, path: str, sep: str = "|") -> None:
    """Pipe table with a header line per file."""
    df.write.option("sep", sep).option("header", True).mode("errorifexists").csv(path)


def sink_xml(df: DataFrame, path: str, row_tag: str = "row", root: str = "rows") -> None:
    df.write.option("rowTag", row_tag).option("rootTag", root).mode("errorifexists").xml(path)


def formatted(df: DataFrame, template: str, fields: Sequence[Expr]) -> DataFrame:
    """One text line per row: a printf template over expressions."""
    return df.select(F.format_string(template, *[as_col(f) for f in fields]).alias("value"))


def sink_formatted(df: DataFrame, path: str, template: str, fields: Sequence[Expr]) -> None:
    formatted(df, template, fields).write.mode("errorifexists").text(path)


def delimited(df: DataFrame, sep: str = "|", encode: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows as delimited lines; NULL is empty."""
    cols = []
    for f in df.schema.fields:
        c = F.coalesce(F.col(f.name).cast("string"), F.lit(""))
        cols.append(encode(c) if encode and isinstance(f.dataType, T.StringType) else c)
    return df.select(F.concat_ws(sep, *cols).alias("value"))


def sink_delimited(df: DataFrame, path: str, sep: str = "|", encode: Callable[[Column], Column] | None = None) -> None:
    delimited(df, sep, encode).write.mode("errorifexists").text(path)


def sink_convert(df: DataFrame, path: str, schema: T.StructType, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write in another schema and format."""
    conform(df, schema).write.format(fmt).mode(mode).save(path)


def export_rows(df: DataFrame, fmt: str = "json", secret_key: str | None = None, secrets: str = "") -> DataFrame:
    """Query results as one JSON or XML text per row, secret attributes left out."""
    src = hide_attributes(df, secret_key, secrets) if secret_key else df
    rec = F.struct(*src.columns)
    return src.select((F.to_json(rec) if fmt == "json" else F.to_xml(rec, {"rowTag": "row"})).alias("value"))


def event_xml(df: DataFrame, kind: str, tags: dict[str, str]) -> DataFrame:
    """Rows as one-line ``<alarm>``/``<stat>`` elements, text escaped."""
    from ..functions.text import html_enc

    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    parts = [F.lit(f"<{kind}>")]
    for tag, name in tags.items():
        if name not in df.columns:
            continue
        c = F.coalesce(F.col(name).cast("string"), F.lit(""))
        parts += [F.lit(f"<{tag}>"), html_enc(c) if name in strings else c, F.lit(f"</{tag}>")]
    return df.select(F.concat(*parts, F.lit(f"</{kind}>")).alias("value"))
