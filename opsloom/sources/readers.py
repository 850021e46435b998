"""Readers for delimited, fixed, flat, pattern, JSON, XML, flow and route inputs.

Every text reader has a twin that parses a DataFrame of lines (``parse_*``), so
batch files, streams and columns share one definition.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.net import aspath_parse, ip6_parse, ip_parse, prefix6_parse, prefix_parse
from ..functions.text import html_dec, simple_dec, url_dec
from ..model import ALARM, STAT, struct

LINE = "value"
RAW = "__raw"
PARTS = "__parts"


def _decode(c: Column, how: str | None, sep: str) -> Column:
    if how is None:
        return c
    if how == "simple":
        return simple_dec(c, sep)
    if how == "url":
        return url_dec(c)
    if how == "html":
        return html_dec(c)
    if how == "std":
        for esc, ch in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            c = F.replace(c, F.lit(esc), F.lit(ch))
        return F.replace(c, F.lit("\\\\"), F.lit("\\"))
    raise ValueError(how)


def parse_delimited(
    lines: DataFrame, schema: T.StructType, sep: str = "|", decode: str | None = None, line: str = LINE, keep: Sequence[str] = ()
) -> DataFrame:
    """Fields of delimited lines, after the columns in ``keep``; a separator after a backslash that is not itself
    escaped (500 pairs of backslashes are told apart) does not separate.

    A blank separator means any run of blanks. Missing fields are NULL, extra ones
    are dropped, and text that is no number is NULL.
    """
    if sep in " \t" and sep != "\t":
        parts = F.split(F.trim(F.col(line)), "[ \t]+")
    else:
        # an even number of backslashes before a separator are escaped ones; the pattern begins with the separator,
        # so that nothing is looked back for elsewhere, and more than one place only behind a backslash
        rx = re.escape(sep)
        parts = F.split(F.col(line), rf"{rx}(?:(?<!\\{rx})|(?<=(?<!\\)(?:\\\\){{1,500}}{rx}))")
    rows, parts = _once(lines.select(*dict.fromkeys([*keep, line])), parts)
    fields = []
    for i, f in enumerate(schema.fields):
        raw = F.get(parts, F.lit(i))
        text = _decode(raw, decode, sep)
        if isinstance(f.dataType, T.StringType):
            fields.append(text.alias(f.name))
        else:
            fields.append(F.trim(text).try_cast(f.dataType).alias(f.name))
    return rows.select(*keep, *fields)


def _once(df: DataFrame, value: Column) -> tuple[DataFrame, Column]:
    """The rows with a value that is computed once per row, and that value.

    An alias would not do: a filter above would compute the value again, and once more wherever it is used.
    """
    return df.select("*", F.explode(F.array(value)).alias(PARTS)), F.col(PARTS)


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", decode: str | None = None, skip: int = 0
) -> DataFrame:
    """Delimited text files; ``skip`` leaves out the first lines of every file.

    Files stay splittable. To skip, the lines of every split are counted, so the place of a line
    in its file is known: one more pass over the text and one row per split.
    """
    lines = spark.read.text(path)
    return parse_delimited(skip_lines(lines, skip) if skip else lines, schema, sep, decode)


def skip_lines(lines: DataFrame, skip: int) -> DataFrame:
    """Lines of text files without the first ``skip`` of every file."""
    at = lines.select(
        LINE, F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__n")
    )
    splits = at.groupBy("__f", "__b").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__lines"))
    before = Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    place = splits.withColumn("__before", F.coalesce(F.sum("__lines").over(before), F.lit(0))).where(F.col("__before") < skip)
    # splits in which lines go: one per file, or more if the file begins with very long lines
    place = place.select("__f", "__b", "__first", "__before")
    kept = at.join(place, ["__f", "__b"], "left")
    return kept.where(F.coalesce(F.col("__before") + F.col("__n") - F.col("__first") >= skip, F.lit(True))).select(LINE)


def parse_fixed(lines: DataFrame, layout: Sequence[tuple[str, int, str]], line: str = LINE) -> DataFrame:
    """(name, width, type) fields at fixed positions; text keeps inner blanks."""
    out, at = [], 1
    for name, width, dtype in layout:
        raw = F.trim(F.substring(F.col(line), at, width))
        out.append((raw if dtype == "string" else raw.try_cast(dtype)).alias(name))
        at += width
    return lines.select(*out)


def read_fixed(spark: SparkSession, path: str, layout: Sequence[tuple[str, int, str]]) -> DataFrame:
    return parse_fixed(spark.read.text(path), layout)


@dataclass(frozen=True)
class FlatField:
    """A field of a flat record: how it is quoted and what ends it."""

    name: str
    dtype: str = "string"
    delimiter: str = " "
    begin: str = ""
    end: str = ""


ACCESS_LOG = (
    FlatField("addr"),
    FlatField("pad1"),
    FlatField("pad2"),
    FlatField("time", begin="[", end="]"),
    FlatField("request", begin='"', end='"'),
    FlatField("status", "int"),
    FlatField("size", "bigint"),
    FlatField("url", begin='"', end='"'),
    FlatField("browser", begin='"', end='"', delimiter=""),
)


def flat_regex(fields: Sequence[FlatField]) -> str:
    out = []
    for f in fields:
        if f.begin:
            body = f"{re.escape(f.begin)}([^{re.escape(f.end)}]*){re.escape(f.end)}"
        elif f.delimiter:
            body = f"([^{re.escape(f.delimiter)}]*)"
        else:
            body = "(.*)"
        out.append(body + (re.escape(f.delimiter) if f.delimiter else ""))
    return "^" + "".join(out) + "$"


def parse_flat(lines: DataFrame, fields: Sequence[FlatField], line: str = LINE) -> tuple[DataFrame, DataFrame]:
    """Text with per-field delimiters and quotes to rows, and the lines that do not fit."""
    rx = flat_regex(fields)
    return _fitting(lines, rx, [(f.name, f.dtype) for f in fields], line)


def _fitting(lines: DataFrame, rx: str, fields: Sequence[tuple[str, str]], line: str) -> tuple[DataFrame, DataFrame]:
    """The fields of the lines that match, and the other lines."""
    fits = F.coalesce(F.col(line).rlike(rx), F.lit(False))
    return _extract(lines.where(fits), rx, fields, line), lines.where(~fits).select(line)


def _extract(lines: DataFrame, rx: str, fields: Sequence[tuple[str, str]], line: str) -> DataFrame:
    cols = []
    for i, (n, t) in enumerate(fields):
        raw = F.regexp_extract(F.col(line), rx, i + 1)
        cols.append((raw if t == "string" else raw.try_cast(t)).alias(n))
    return lines.select(*cols)


def read_flat(spark: SparkSession, path: str, fields: Sequence[FlatField]) -> tuple[DataFrame, DataFrame]:
    return parse_flat(spark.read.text(path), fields)


_CONVERSIONS = {"s": ("string", "{n}"), "d": ("bigint", r"[-+]?\d+"), "u": ("bigint", r"\d+"),
                "f": ("double", r"[-+]?[\d.]+(?:[eE][-+]?\d+)?"), "x": ("string", "[0-9a-fA-F]+")}


def pattern_regex(pattern: str) -> tuple[str, list[tuple[str, str]]]:
    """``%(name)s:%(uid)d`` (a comment may follow ``name::``) to a regex and fields."""
    rx, fields, at = "^", [], 0
    for m in re.finditer(r"%\((\w+)(?:::[^)]*)?\)([sdufx])", pattern):
        rx += re.escape(pattern[at : m.start()])
        follow = pattern[m.end() : m.end() + 1]
        dtype, body = _CONVERSIONS[m[2]]
        rx += f"({body.replace('{n}', f'[^{re.escape(follow)}]*' if follow and follow != '%' else '.*')})"
        fields.append((m[1], dtype))
        at = m.end()
    return rx + re.escape(pattern[at:]) + "$", fields


def parse_pattern(lines: DataFrame, pattern: str, line: str = LINE) -> tuple[DataFrame, DataFrame]:
    """Scanf-like text to rows, and the lines that do not fit."""
    rx, fields = pattern_regex(pattern)
    return _fitting(lines, rx, fields, line)


def read_pattern(spark: SparkSession, path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    return parse_pattern(spark.read.text(path), pattern)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Nested records, one per line, with a declared schema."""
    return spark.read.schema(schema).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("rowTag", row_tag).xml(path)


FLOW_TEXT = struct(
    "src_addr string, dst_addr string, hop string, input int, output int, packets bigint, bytes bigint, "
    "first bigint, last bigint, src_port int, dst_port int, flags int, tcp_flags int, protocol int, tos int, "
    "src_as bigint, dst_as bigint, src_mask int, dst_mask int, flow_sequence bigint"
)


def parse_flow(lines: DataFrame, line: str = LINE) -> tuple[DataFrame, DataFrame]:
    """Pipe-delimited flow records, with addresses as numbers beside the text; and the lines without both addresses."""
    df = parse_delimited(lines.withColumn(RAW, F.col(line)), FLOW_TEXT, "|", line=line, keep=(RAW,))
    df = df.withColumns({f"{c}_num": ip_parse(F.col(c)) for c in ("src_addr", "dst_addr", "hop")})
    good = F.col("src_addr_num").isNotNull() & F.col("dst_addr_num").isNotNull()
    return df.where(good).drop(RAW), df.where(~good).select(F.col(RAW).alias(line))


def read_flow(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_flow(spark.read.text(path))


def parse_routes(lines: DataFrame, line: str = LINE) -> tuple[DataFrame, DataFrame]:
    """Routing table lines (prefix, next hop, AS path) of both families, and the lines that are no routes.

    ``family`` is 4 or 6; ``addr`` and ``hop`` are numbers for IPv4, ``addr6`` and ``hop6``
    16 bytes for IPv6, and NULL for the other family.
    """
    rx = r"^\s*[*>i ]*\s*([0-9A-Fa-f.:]+(?:/[0-9]+)?)\s+([0-9A-Fa-f.:]+)\s*(.*?)\s*([ie?])?\s*$"
    rows, parts = _once(lines.select(line), F.array(*[F.regexp_extract(line, rx, i) for i in range(1, 5)]))
    part = [F.get(parts, F.lit(i)) for i in range(4)]
    path = aspath_parse(part[2])
    out = rows.select(
        F.col(line).alias(RAW), prefix_parse(part[0]).alias("__p4"), prefix6_parse(part[0]).alias("__p6"),
        ip_parse(part[1]).alias("hop"), F.when(F.contains(part[1], F.lit(":")), ip6_parse(part[1])).alias("hop6"),
        path.alias("path"), F.try_element_at(path, F.lit(-1)).alias("origin_as"), part[3].alias("origin"),
    )
    good = F.col("__p4").isNotNull() | F.col("__p6").isNotNull()
    rows = out.where(good).select(
        F.when(F.col("__p4").isNotNull(), 4).otherwise(6).alias("family"), F.col("__p4.addr").alias("addr"), F.col("__p6.addr").alias("addr6"),
        F.coalesce("__p4.len", "__p6.len").alias("len"), "hop", "hop6", "path", "origin_as", "origin",
    )
    return rows, out.where(~good).select(F.col(RAW).alias(line))


def read_routes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_routes(spark.read.text(path))


# Element names of the one-line event format.
ALARM_TAGS = {
    "aid": "alarmid", "ccid": "ccid", "st": "state", "sm": "smode", "vars": "variables", "di": "dateissued",
    "hi": "hourissued", "tc": "timecleared", "ti": "timeissued", "tp": "type", "so": "sortorder", "pm": "pmode",
    "lv1": "level1", "id1": "id1", "lv2": "level2", "id2": "id2", "tm": "tmode", "sev": "severity",
    "txt": "text", "com": "comment", "origmsg": "origmsg",
}
STAT_TAGS = {
    "rt": "timeissued", "lv": "level", "id": "id", "key": "key", "u": "unit", "num": "val", "lab": "label",
}


def parse_event_xml(lines: DataFrame, kind: str, line: str = LINE) -> tuple[DataFrame, DataFrame]:
    """One-line ``<alarm>``/``<stat>`` elements to rows, and the lines that do not parse.

    ``from_xml`` reads the element with a declared schema of text fields; codes
    are cast afterwards, so a bad number is NULL and the row is malformed.
    """
    tags, target = (ALARM_TAGS, ALARM) if kind == "alarm" else (STAT_TAGS, STAT)
    types = {f.name: f.dataType for f in target.fields}
    xml = T.StructType([T.StructField(t, T.StringType()) for t in tags])
    xml.add("_corrupt_record", T.StringType())
    parsed = lines.withColumn(
        "__x", F.from_xml(F.col(line), xml, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    )
    whole = F.trim(F.col(line)).rlike(f"^<{kind}>.*</{kind}>$") & F.col("__x._corrupt_record").isNull()
    need = "ti" if kind == "alarm" else "rt"
    good = F.coalesce(whole & F.col(f"__x.{need}").try_cast("bigint").isNotNull(), F.lit(False))
    cols = []
    for t, n in tags.items():
        raw = F.col(f"__x.{t}")
        cols.append((F.coalesce(raw, F.lit("")) if isinstance(types[n], T.StringType) else raw.try_cast(types[n])).alias(n))
    return parsed.where(good).select(*cols), parsed.where(~good).select(F.col(line))


def read_event_xml(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    return parse_event_xml(spark.read.text(path), kind)


def read_many(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Concatenate many files of one schema (globs allowed); the order is unspecified."""
    r = spark.read.format(fmt)
    if schema:
        r = r.schema(schema)
    return r.load(list(paths))


def union_all(inputs: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by field name."""
    out = inputs[0]
    for d in inputs[1:]:
        out = out.unionByName(d)
    return out


def ds_info(df: DataFrame) -> DataFrame:
    """Rows per file and in total (file ``total``). File-based inputs only."""
    return (
        df.groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .rollup("file")
        .agg(F.sum("rows").alias("rows"))
        .withColumn("file", F.coalesce("file", F.lit("total")))
    )


def ds_schema(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes
