"""Queries for sorts, limits, numbering and order reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import sorts
from ..operators.rows import callout
from ..sources.readers import union_all as concat
from .core import query, table



@query("sort_keys", """SELECT l_returnflag, l_quantity, l_orderkey, l_linenumber FROM lineitem
  ORDER BY l_returnflag, l_quantity DESC, l_orderkey, l_linenumber""")  # fmt: skip
def sort_keys(spark, sf):
    return sorts.sort_keys(
        table(spark, sf, "lineitem"),
        [("l_returnflag", False), ("l_quantity", True), ("l_orderkey", False), ("l_linenumber", False)],
    ).select("l_returnflag", "l_quantity", "l_orderkey", "l_linenumber")


@query("sort_unique", """SELECT l_suppkey, l_returnflag, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem
  GROUP BY l_suppkey, l_returnflag ORDER BY l_suppkey DESC, l_returnflag""")  # fmt: skip
def sort_unique(spark, sf):
    return sorts.sort_keys(
        table(spark, sf, "lineitem"), [("l_suppkey", True), ("l_returnflag", False)], unique=True,
        first_by=["l_orderkey", "l_linenumber"],
    ).select("l_suppkey", "l_returnflag", "l_orderkey")


@query("sort_merge", """SELECT o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_totalprice DESC""")
def sort_merge(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    parts = [o.where(F.col("o_orderstatus") == s).select("o_orderdate", "o_totalprice") for s in "FOP"]
    return sorts.sort_merge(parts, [("o_orderdate", False), ("o_totalprice", True)])


@query("sort_modifiers", r"""SELECT p_partkey, CAST(coalesce(TRY_CAST(nullif(regexp_extract(p_brand, '#([0-9]+)', 1), '') AS INTEGER), 0) AS BIGINT) AS num,
  upper(regexp_replace(p_name, '[^A-Za-z0-9 \t]', '', 'g')) AS dict, upper(substring(p_type, 2, 3)) AS part,
  CAST(coalesce(TRY_CAST(nullif(regexp_extract(CAST(p_retailprice AS VARCHAR), '^([0-9]+\.?[0-9]*)', 1), '') AS DOUBLE), 0) AS DOUBLE) AS gen FROM part""")  # fmt: skip
def sort_modifiers(spark, sf):
    p = table(spark, sf, "part")
    k = sorts.sort_key
    cols = {
        "num": k(F.substring_index("p_brand", "#", -1), numeric=True).cast("bigint"),
        "dict": k(F.col("p_name"), dictionary=True, fold=True),
        "part": k(F.col("p_type"), fold=True, span=(2, 4)),
        "gen": k(F.col("p_retailprice").cast("string"), general=True),
    }
    return p.select("p_partkey", *[c.alias(n) for n, c in cols.items()]).orderBy("num", "dict", "p_partkey")


@query("sort_check", """SELECT bool_and(coalesce(prev <= o_totalprice, true)) AS ordered, count(*) FILTER (prev > o_totalprice) AS disorders FROM
  (SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)""")  # fmt: skip
def sort_check(spark, sf):
    return sorts.sort_check(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], "o_totalprice")


@query("shuffle", "SELECT o_orderkey, o_custkey FROM orders")
def shuffle(spark, sf):
    return sorts.shuffle(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), seed=7)


@query("head", """SELECT 'all' AS inp, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5)
  UNION ALL SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r <= 10""")  # fmt: skip
def head(spark, sf):
    o = table(spark, sf, "orders")
    a = sorts.head(o, 25, [F.col("o_totalprice").desc(), "o_orderkey"], skip=5).select(F.lit("all").alias("inp"), "o_orderkey")
    b = sorts.head(o, 10, ["o_totalprice", "o_orderkey"], by=["o_orderstatus"])
    return a.unionByName(b.select(F.col("o_orderstatus").alias("inp"), "o_orderkey"))


@query("tail", """SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 10""")
def tail(spark, sf):
    return sorts.tail(table(spark, sf, "orders"), 10, ["o_orderdate", "o_orderkey"], by=["o_orderstatus"]).select("o_orderstatus", "o_orderkey")


@query("reverse_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC")
def reverse_rows(spark, sf):
    return sorts.reverse_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("reverse_chars", "SELECT p_partkey, reverse(p_name) AS p_name FROM part")
def reverse_chars(spark, sf):
    return sorts.reverse_chars(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name")


@query("line_number", """SELECT c_custkey, lpad(CAST(10 + 5 * (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) AS VARCHAR), 8, ' ') AS label FROM customer""")
def line_number(spark, sf):
    c = table(spark, sf, "customer")
    return sorts.line_number(c, ["c_acctbal", "c_custkey"], start=10, increment=5, width=8).select("c_custkey", "label")


@query("running_extrema", """SELECT event_id, event_type, value, CASE WHEN lo IS NULL THEN 'first' WHEN value < lo THEN 'min' ELSE 'max' END AS kind FROM (
  SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE lo IS NULL OR value < lo OR value > hi""")  # fmt: skip
def running_extrema(spark, sf):
    return sorts.running_extrema(table(spark, sf, "events"), ["ts", "event_id"], "value", ["event_type"]).select(
        "event_id", "event_type", "value", "kind"
    )


@query("running_extrema_absolute", """SELECT event_type, 'min' AS kind, arg_min(event_id, (value, ts, event_id)) AS event_id FROM events GROUP BY ALL
  UNION ALL SELECT event_type, 'max', arg_min(event_id, (-value, ts, event_id)) FROM events GROUP BY ALL""")  # fmt: skip
def running_extrema_absolute(spark, sf):
    return sorts.running_extrema(table(spark, sf, "events"), ["ts", "event_id"], "value", ["event_type"], absolute=True).select(
        "event_type", "kind", "event_id"
    )


@query("union_all", "SELECT s_suppkey AS k, s_name AS n FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def union_all(spark, sf):
    return concat([table(spark, sf, "supplier").selectExpr("s_suppkey k", "s_name n"), table(spark, sf, "customer").selectExpr("c_name n", "c_custkey k")])


_COMM = """a AS (SELECT l_partkey AS v, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL),
  b AS (SELECT l_partkey AS v, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL),
  j AS (SELECT coalesce(a.v, b.v) AS value, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b USING (v))"""


@query("comm", f"WITH {_COMM} SELECT value, greatest(na - nb, 0) AS only_a, greatest(nb - na, 0) AS only_b, least(na, nb) AS both FROM j")
def comm(spark, sf):
    li = table(spark, sf, "lineitem")
    return sorts.comm(li.where("l_linenumber % 2 = 1"), li.where("l_linenumber % 2 = 0"), "l_partkey")


@query("comm_rows", """SELECT 'a' AS side, l_partkey FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber % 2 = 1 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_linenumber % 2 = 0)
  UNION ALL SELECT 'both', l_partkey FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber % 2 = 1 INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_linenumber % 2 = 0)""")  # fmt: skip
def comm_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    a, b = (li.where(F.col("l_linenumber") % 2 == f) for f in (1, 0))
    parts = [sorts.comm_rows(a, b, "l_partkey", c).select(F.lit(n).alias("side"), "l_partkey") for c, n in (("only_a", "a"), ("both", "both"))]
    return parts[0].unionByName(parts[1])


@query("sort_callout", """SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 UNION ALL SELECT p_partkey, 'extra ' || p_name, p_size FROM part WHERE p_size >= 45""")
def sort_callout(spark, sf):
    def adjust(pdf):
        big = pdf[pdf["p_size"] >= 45].assign(p_name=lambda d: "extra " + d["p_name"])
        return pd.concat([pdf[pdf["p_size"] >= 10], big])

    out = callout(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), adjust)
    return sorts.sort_keys(out, [("p_size", True), ("p_partkey", False)])
