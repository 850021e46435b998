"""Queries for counting, summing, statistics, keyed frames and usage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggs, callbacks, frames
from . import views as V
from .core import query, table

# --- record aggregations -----------------------------------------------------------------


@query("count_by_key", "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY ALL")
def count_by_key(spark, sf):
    return aggs.count_by_key(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("sum_by_key", """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS l_extendedprice,
  arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS l_orderkey FROM lineitem GROUP BY ALL""")  # fmt: skip
def sum_by_key(spark, sf):
    out = aggs.sum_by_key(
        table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice",
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], ["l_orderkey"],
    )
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@query("key_frame_sum", """SELECT key, frame, round(sum(val), 2) AS val FROM (
  SELECT l_returnflag AS key, month(l_shipdate) - 1 AS frame, l_quantity AS val FROM lineitem UNION ALL
  SELECT l_linestatus || '.tax', month(l_shipdate) - 1, l_tax FROM lineitem) GROUP BY ALL""")  # fmt: skip
def key_frame_sum(spark, sf):
    out = aggs.key_frame_sum(
        table(spark, sf, "lineitem"),
        [("l_returnflag", "month(l_shipdate) - 1", "l_quantity"), ("l_linestatus || '.tax'", "month(l_shipdate) - 1", "l_tax")],
    )
    return out.select("key", F.col("frame").cast("bigint").alias("frame"), F.round("val", 2).alias("val"))


@query("split_key_frame_sum", """SELECT l_linestatus, l_returnflag AS key, month(l_shipdate) - 1 AS frame, round(sum(l_quantity), 2) AS val FROM lineitem GROUP BY ALL""")
def split_key_frame_sum(spark, sf):
    out = aggs.key_frame_sum(
        table(spark, sf, "lineitem"), [("l_returnflag", "month(l_shipdate) - 1", "l_quantity")], split=["l_linestatus"]
    )
    return out.select("l_linestatus", "key", F.col("frame").cast("bigint").alias("frame"), F.round("val", 2).alias("val"))


@query("key_frame_callback", """WITH c AS (SELECT DISTINCT l_linestatus, l_returnflag AS key, month(l_shipdate) - 1 AS frame, l_extendedprice AS val FROM lineitem UNION
  SELECT DISTINCT l_linestatus, 'tax', month(l_shipdate) - 1, l_tax FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus, key, frame ORDER BY val DESC) AS n FROM c WHERE val IS NOT NULL)
  SELECT l_linestatus, key, frame, CAST(max(CASE WHEN n = 1 THEN val END) AS DOUBLE) AS top, CAST(max(CASE WHEN n = 2 THEN val END) AS DOUBLE) AS val
  FROM r GROUP BY ALL""")  # fmt: skip
def key_frame_callback(spark, sf):
    """A user's aggregate over keyed frames: the two largest distinct values of a cell."""
    cells = [("l_returnflag", "month(l_shipdate) - 1", "l_extendedprice"), ("'tax'", "month(l_shipdate) - 1", "l_tax")]
    out = callbacks.key_frame_aggregate(table(spark, sf, "lineitem"), cells, callbacks.second_largest(), split=["l_linestatus"])
    return out.withColumn("frame", F.col("frame").cast("bigint"))


@query("stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS field, count({c}) AS count, round(sum({c}), 2) AS sum, round(avg({c}), 6) AS average,
  round(stddev_samp({c}), 6) AS deviation, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")))
def stats(spark, sf):
    return _rounded(aggs.stats(table(spark, sf, "lineitem"), fields=["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]))


def _rounded(df):
    return df.withColumns({"sum": F.round("sum", 2), "average": F.round("average", 6), "deviation": F.round("deviation", 6)})


@query("stats_grouped_overflow", """WITH seen AS (SELECT user_id, min(event_id) AS f FROM events GROUP BY ALL),
  top AS (SELECT user_id FROM seen ORDER BY f LIMIT 10)
  SELECT coalesce(CAST(t.user_id AS VARCHAR), 'OVERFLOW') AS "group", 'value' AS field, count(value) AS count, round(sum(value), 2) AS sum,
  round(avg(value), 6) AS average, round(coalesce(stddev_samp(value), 0), 6) AS deviation, min(value) AS min, max(value) AS max
  FROM events e LEFT JOIN top t ON e.user_id = t.user_id GROUP BY ALL""")  # fmt: skip
def stats_grouped_overflow(spark, sf):
    return _rounded(aggs.stats(table(spark, sf, "events"), ["user_id"], ["value"], max_groups=10, first_by=["event_id"]))


@query("stats_grouped_two", """WITH e AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'a,' || user_id % 2 END AS g1, CASE WHEN user_id % 5 = 0 THEN '' ELSE event_type || ',b' END AS g2 FROM events)
  SELECT coalesce(g1, '') || ',' || g2 AS "group", 'value' AS field, count(value) AS count, round(sum(value), 2) AS sum,
  round(avg(value), 6) AS average, round(coalesce(stddev_samp(value), 0), 6) AS deviation, min(value) AS min, max(value) AS max FROM e GROUP BY g1, g2""")  # fmt: skip
def stats_grouped_two(spark, sf):
    """Groups of two columns with commas, NULL and empty text in them."""
    e = table(spark, sf, "events").withColumns({
        "g1": F.expr("if(user_id % 3 = 0, null, concat('a,', user_id % 2))"), "g2": F.expr("if(user_id % 5 = 0, '', concat(event_type, ',b'))"),
    })
    return _rounded(aggs.stats(e, ["g1", "g2"], ["value"]))


@query("sort_count", "SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) >= 35")
def sort_count(spark, sf):
    return aggs.sort_count(table(spark, sf, "lineitem"), ["l_partkey"], 35)


@query("sort_summarise", """SELECT l_suppkey, max(l_quantity) AS l_quantity, min(l_tax) AS l_tax, round(avg(l_discount), 8) AS l_discount,
  round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS l_extendedprice, count(*) AS count FROM lineitem GROUP BY ALL""")  # fmt: skip
def sort_summarise(spark, sf):
    out = aggs.sort_summarise(
        table(spark, sf, "lineitem"), ["l_suppkey"],
        {"l_quantity": "max", "l_tax": "min", "l_discount": "avg", "l_extendedprice": "wcount"}, weight="l_quantity",
    )
    return out.withColumns({"l_discount": F.round("l_discount", 8), "l_extendedprice": F.round("l_extendedprice", 4)})


@query("distinct_first", """SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1""")  # fmt: skip
def distinct_first(spark, sf):
    out = aggs.distinct_first(
        table(spark, sf, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    )
    return out.select("l_orderkey", "l_partkey", "l_quantity")


@query("usage_by_day", """SELECT CAST(ts AS DATE) AS day, event_type AS tool, count(DISTINCT user_id) AS users, count(*) AS total,
  count(*) FILTER (value > 100) AS filtered FROM events GROUP BY ALL""")  # fmt: skip
def usage_by_day(spark, sf):
    return aggs.usage_by_day(table(spark, sf, "events"), "ts", "event_type", "user_id", "value > 100")


# --- keyed frames ----------------------------------------------------------------------------

KF_SRC = """d AS (SELECT CAST(l_suppkey AS VARCHAR) AS key, CAST(month(l_shipdate) - 1 AS INTEGER) AS frame, l_quantity AS val,
  year(l_shipdate) AS y FROM lineitem),
 a AS (SELECT key, frame, sum(val) AS val FROM d WHERE y % 3 = 0 GROUP BY ALL),
 b AS (SELECT key, frame, sum(val) AS val FROM d WHERE y % 3 = 1 GROUP BY ALL),
 c AS (SELECT key, frame, sum(val) AS val FROM d WHERE y % 3 = 2 GROUP BY ALL),
 w AS (SELECT key, frame, sum(val) AS val FROM d GROUP BY ALL),
 cells AS (SELECT key, frame, sum(val) FILTER (i = 0) AS v0, sum(val) FILTER (i = 1) AS v1, sum(val) FILTER (i = 2) AS v2 FROM
  (SELECT *, 0 AS i FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c) GROUP BY ALL)"""


def _year(spark, sf, cond):
    li = table(spark, sf, "lineitem").where(cond)
    return frames.load(li, "l_suppkey", ["l_quantity"], "month(l_shipdate) - 1")


def _abc(spark, sf):
    """Three sets that together hold every line item."""
    return [_year(spark, sf, f"year(l_shipdate) % 3 = {i}") for i in range(3)]


def _whole(spark, sf):
    return _year(spark, sf, "true")


def _r(df, digits=4):
    return df.withColumn("val", F.round("val", digits))


@query("kf_load", """SELECT CAST(l_suppkey AS VARCHAR) AS key, CAST(f AS INTEGER) AS frame, round(sum(v), 4) AS val FROM
  (SELECT l_suppkey, unnest([0, 1, 2]) AS f, unnest([l_quantity, l_extendedprice, l_tax]) AS v FROM lineitem) GROUP BY ALL""")  # fmt: skip
def kf_load(spark, sf):
    return _r(frames.load(table(spark, sf, "lineitem"), "l_suppkey", ["l_quantity", "l_extendedprice", "l_tax"]))


@query("kf_load_avg", """SELECT CAST(l_suppkey AS VARCHAR) AS key, CAST(month(l_shipdate) - 1 AS INTEGER) AS frame,
  round(avg(l_quantity), 6) AS val FROM lineitem GROUP BY ALL""")  # fmt: skip
def kf_load_avg(spark, sf):
    return _r(frames.load(table(spark, sf, "lineitem"), "l_suppkey", ["l_quantity"], "month(l_shipdate) - 1", average=True), 6)


@query("kf_cat", f"""WITH {KF_SRC}, na AS (SELECT max(frame) + 1 AS n FROM a), nb AS (SELECT max(frame) + 1 AS n FROM b)
  SELECT key, frame, val FROM a UNION ALL SELECT key, CAST(frame + (SELECT n FROM na) AS INTEGER), val FROM b
  UNION ALL SELECT key, CAST(frame + (SELECT n FROM na) + (SELECT n FROM nb) AS INTEGER), val FROM c""")  # fmt: skip
def kf_cat(spark, sf):
    return frames.cat(_abc(spark, sf))


_V = "coalesce(v0, 0)", "coalesce(v1, 0)", "coalesce(v2, 0)"
_ALL = "v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL"
_COMBINE = {
    "add": " + ".join(_V),
    "sub": " - ".join(_V),
    "mul": f"CASE WHEN {_ALL} THEN v0 * v1 * v2 ELSE 0 END",
    "div": f"CASE WHEN {_ALL} THEN CASE WHEN v2 = 0 OR v1 = 0 THEN 0 ELSE v0 / v1 / v2 END ELSE 0 END",
    "min": f"least({', '.join(_V)})",
    "max": f"greatest({', '.join(_V)})",
    "wavg": f"({_V[0]} * 1 + {_V[1]} * 2 + {_V[2]} * 3) / 6",
}
for _op, _sql in _COMBINE.items():

    def _combine(spark, sf, op=_op):
        return _r(frames.combine(op, _abc(spark, sf), [1, 2, 3] if op == "wavg" else None), 6)

    query(f"kf_{_op}", f"WITH {KF_SRC} SELECT key, frame, round(CAST({_sql} AS DOUBLE), 6) AS val FROM cells")(_combine)


@query("kf_mean_sdev", f"""WITH {KF_SRC} SELECT key, frame, round(({' + '.join(_V)}) / 3, 6) AS mean,
  round(list_stddev_samp([{', '.join(_V)}]), 6) AS sdev FROM cells""")  # fmt: skip
def kf_mean_sdev(spark, sf):
    return frames.mean_sdev(_abc(spark, sf)).select("key", "frame", F.round("mean", 6).alias("mean"), F.round("sdev", 6).alias("sdev"))


for _how, _sql in (("add", "sum(val)"), ("min", "min(val)"), ("max", "max(val)")):
    _zero = "" if _how == "add" else f"CASE WHEN count(*) < {{n}} THEN {'least' if _how == 'min' else 'greatest'}({_sql}, 0) ELSE {_sql} END"

    def _frames(spark, sf, how=_how):
        return frames.sum_frames(_whole(spark, sf), how)

    def _items(spark, sf, how=_how):
        return frames.sum_items(_whole(spark, sf), how)

    query(
        f"kf_sum_frames_{_how}",
        f"WITH {KF_SRC} SELECT key, {_zero.format(n='(SELECT max(frame) + 1 FROM w)') or _sql} AS val FROM w GROUP BY key",
    )(_frames)
    query(
        f"kf_sum_items_{_how}",
        f"WITH {KF_SRC} SELECT frame, {_zero.format(n='(SELECT count(DISTINCT key) FROM w)') or _sql} AS val FROM w GROUP BY frame",
    )(_items)


@query("kf_reaggregate", f"""WITH {KF_SRC} SELECT CAST(s_nationkey AS VARCHAR) AS key, frame, sum(val) AS val FROM w
  JOIN supplier ON key = CAST(s_suppkey AS VARCHAR) WHERE s_acctbal > 0 GROUP BY ALL""")  # fmt: skip
def kf_reaggregate(spark, sf):
    m = table(spark, sf, "supplier").where("s_acctbal > 0").selectExpr("string(s_suppkey) key", "string(s_nationkey) newkey")
    return frames.reaggregate(_whole(spark, sf), m)


@query("kf_extract", f"WITH {KF_SRC} SELECT key, frame, val FROM w WHERE key IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey < 5)")
def kf_extract(spark, sf):
    return frames.extract(_whole(spark, sf), table(spark, sf, "supplier").where("s_nationkey < 5").selectExpr("string(s_suppkey) key"))


@query("kf_print_select", f"WITH {KF_SRC} SELECT key, frame, val FROM w WHERE key = '7' OR frame = 3")
def kf_print_select(spark, sf):
    a = _whole(spark, sf)
    return frames.print_select(a, key="7").unionByName(frames.print_select(a.where("key <> '7'"), frame=3))


@query("kf_topn", f"""WITH {KF_SRC} (SELECT 'max' AS kind, key, frame, val FROM w WHERE frame BETWEEN 2 AND 9 ORDER BY val DESC, frame, key LIMIT 20)
  UNION ALL (SELECT 'min', key, frame, val FROM w ORDER BY val, frame, key LIMIT 20)""")  # fmt: skip
def kf_topn(spark, sf):
    a = _whole(spark, sf)
    hi = frames.topn(a, 20, True, (2, 9)).withColumn("kind", F.lit("max"))
    return hi.unionByName(frames.topn(a, 20, False).withColumn("kind", F.lit("min")))


@query("word_count", r"""WITH x AS (SELECT lang, CAST(length(regexp_replace(text, '\n$', '')) - length(replace(regexp_replace(text, '\n$', ''), chr(10), '')) + 1 AS BIGINT) AS lines,
  CAST(len(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+')) AS BIGINT) AS words, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars,
  CAST(list_max(list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda s: length(s))) AS BIGINT) AS longest FROM documents)
  SELECT coalesce(lang, 'total') AS lang, sum(lines)::BIGINT AS lines, sum(words)::BIGINT AS words, sum(bytes)::BIGINT AS bytes,
  sum(chars)::BIGINT AS chars, max(longest) AS longest FROM x GROUP BY ROLLUP (lang)""")  # fmt: skip
def word_count(spark, sf):
    return aggs.word_count(table(spark, sf, "documents"), "text", "lang")


_LINES = "lines AS (SELECT trim(unnest(string_split(text, chr(10)))) AS line, turn FROM conversations)"


def _lines(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.explode(F.split("text", "\n")).alias("line"), "turn").withColumn("line", F.trim("line"))


_FIRST = r"regexp_extract(line, '^(\S*)', 1)"


@query("uniq_count", f"WITH {_LINES} SELECT count(*) AS count, line FROM lines GROUP BY line")
def uniq_count(spark, sf):
    return aggs.uniq(_lines(spark, sf), "line", "count")


@query("uniq_repeated", f"WITH {_LINES} SELECT min(line) AS line FROM lines GROUP BY lower(substring(line, 1, 4)) HAVING count(*) > 1")
def uniq_repeated(spark, sf):
    return aggs.uniq(_lines(spark, sf), "line", "repeated", width=4, ignore_case=True)


@query("uniq_all_repeated", """WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line, doc_id FROM documents)
  SELECT line, doc_id FROM lines WHERE line IN (SELECT line FROM lines GROUP BY line HAVING count(*) > 1)""")  # fmt: skip
def uniq_all_repeated(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"), "doc_id")
    return aggs.uniq(lines, "line", "all_repeated")


@query("uniq_unique", rf"""WITH {_LINES}, k AS (SELECT line, substring(regexp_replace(line, '^[\t\n\x0B\f\r ]*[^\t\n\x0B\f\r ]+', ''), 2) AS k FROM lines)
  SELECT min(line) AS line FROM k GROUP BY k HAVING count(*) = 1""")  # fmt: skip
def uniq_unique(spark, sf):
    return aggs.uniq(_lines(spark, sf), "line", "unique", skip_fields=1, skip_chars=1)
