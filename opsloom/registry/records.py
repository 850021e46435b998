"""Queries for sources, sinks, projections, predicates, composition and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes, net, text
from ..model import struct
from ..operators import aggs, intervals, joins, ordered, rows
from ..session import scratch_path
from ..sources import readers, writers
from . import views as V
from .core import query, table

ORDERS = struct("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


# --- sources ---------------------------------------------------------------------------


@query("src_delimited", ORDERS_SQL)
def src_delimited(spark, sf):
    path = scratch_path(spark, "delimited")
    writers.sink_delimited(table(spark, sf, "orders").select(*ORDERS.names), path, "|", text.simple_enc)
    return readers.read_delimited(spark, path, ORDERS, "|", "simple")


@query("src_delimited_decode", "SELECT page_id, url FROM pages")
def src_delimited_decode(spark, sf):
    path = scratch_path(spark, "decode")
    writers.sink_delimited(table(spark, sf, "pages").select("page_id", "url"), path, ";", text.url_enc)
    return readers.read_delimited(spark, path, T.StructType.fromDDL("page_id bigint, url string"), ";", "url")


@query("src_delimited_skip", ORDERS_SQL)
def src_delimited_skip(spark, sf):
    path = scratch_path(spark, "skip")
    writers.sink_table(table(spark, sf, "orders").select(*ORDERS.names), path)
    return readers.read_delimited(spark, path, ORDERS, "|", skip=1)


LAYOUT = (("o_orderkey", 12, "bigint"), ("o_orderstatus", 2, "string"), ("o_orderpriority", 16, "string"))


@query("src_fixed_width", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def src_fixed_width(spark, sf):
    path = scratch_path(spark, "fixed")
    writers.sink_formatted(table(spark, sf, "orders"), path, "%12d%-2s%-16s", [n for n, _, _ in LAYOUT])
    return readers.read_fixed(spark, path, LAYOUT)


@query("src_flat_schema", """SELECT 'h' || user_id AS addr, strftime(ts, '%d/%b/%Y:%H:%M:%S') AS time,
  'GET /' || event_type AS request, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CAST(floor(value * 100) AS BIGINT) AS size FROM events""")  # fmt: skip
def src_flat_schema(spark, sf):
    path = scratch_path(spark, "flat")
    e = table(spark, sf, "events")
    writers.sink_formatted(
        e, path, 'h%d - - [%s] "GET /%s" %d %d "-" "agent %s"',
        ["user_id", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), "event_type",
         "if(event_type = 'error', 500, 200)", "bigint(floor(value * 100))", "event_type"],
    )
    return readers.read_flat(spark, path, readers.ACCESS_LOG)[0].select("addr", "time", "request", "status", "size")


@query("src_pattern_text", "SELECT o_orderstatus AS status, o_orderkey AS \"key\", o_totalprice AS price, o_orderpriority AS prio FROM orders")
def src_pattern_text(spark, sf):
    lines = writers.formatted(
        table(spark, sf, "orders"), "%s::%d=%.2f %s", ["o_orderstatus", "o_orderkey", "o_totalprice", "o_orderpriority"]
    )
    return readers.parse_pattern(lines, "%(status)s::%(key::Order number.)d=%(price)f %(prio)s")[0]


@query("src_json", "SELECT event_id, user_id AS uid, event_type AS kind, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def src_json(spark, sf):
    path = scratch_path(spark, "json")
    props = T.StructType.fromDDL("k bigint")
    e = table(spark, sf, "events")
    rec = e.select("event_id", F.struct(F.col("user_id").alias("id"), "event_type").alias("user"), F.from_json("props", props).alias("props"))
    rec.write.json(path)
    schema = T.StructType.fromDDL("event_id bigint, user struct<id bigint, event_type string>, props struct<k bigint>")
    df = readers.read_json(spark, path, schema)
    return df.select("event_id", F.col("user.id").alias("uid"), F.col("user.event_type").alias("kind"), F.col("props.k").alias("k"))


@query("src_xml", "SELECT s_suppkey, s_name AS name, s_nationkey AS nation FROM supplier")
def src_xml(spark, sf):
    path = scratch_path(spark, "xml")
    s = table(spark, sf, "supplier")
    rec = s.select("s_suppkey", F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).alias("who"))
    writers.sink_xml(rec, path, "supplier", "suppliers")
    schema = T.StructType.fromDDL("s_suppkey bigint, who struct<name string, nation int>")
    return readers.read_xml(spark, path, "supplier", schema).select("s_suppkey", "who.name", "who.nation")


def _flow_lines(spark, sf):
    f = V.flow(spark, sf)
    return writers.delimited(
        f.select(
            net.ip_format(F.col("src")), net.ip_format(F.col("dst")), F.lit("10.0.0.1"), F.lit(1), F.lit(2), "packets",
            "bytes", "first", "first", "src_port", "dst_port", F.lit(0), "tcp_flags", "protocol", F.lit(0),
            F.expr("orderkey % 65000"), F.expr("linenumber"), F.lit(16), F.lit(16), "orderkey",
        ).toDF(*readers.FLOW_TEXT.names)
    )


@query("src_flow_text", f"""WITH {V.FLOW} SELECT src AS src_addr_num, dst AS dst_addr_num, src_port, dst_port,
  protocol, tcp_flags, packets, bytes, orderkey % 65000 AS src_as, 167772161 AS hop_num FROM flow""")  # fmt: skip
def src_flow_text(spark, sf):
    path = scratch_path(spark, "flow")
    _flow_lines(spark, sf).write.text(path)
    return readers.read_flow(spark, path)[0].select(
        "src_addr_num", "dst_addr_num", "src_port", "dst_port", "protocol", "tcp_flags", "packets", "bytes", "src_as",
        "hop_num",
    )


@query("src_route_table", f"""WITH {V.PFX_A} SELECT addr, len, CAST(3232235777 AS BIGINT) AS hop, 7018 AS first_as,
  CAST(1 + owner % 900 AS BIGINT) AS origin_as, 3 AS hops FROM pa""")  # fmt: skip
def src_route_table(spark, sf):
    p = V.prefix_table(spark, sf)
    lines = p.select(
        F.format_string("*> %s/%d 192.168.1.1 7018 %d %d i", net.ip_format(F.col("addr")), "len", F.expr("owner % 64"),
                        F.expr("1 + owner % 900")).alias("value")
    )
    r, _ = readers.parse_routes(lines)
    return r.select("addr", "len", "hop", F.col("path")[0].cast("int").alias("first_as"), "origin_as", F.size("path").alias("hops"))


@query("src_route_table_v6", f"""WITH {V.PFX_A} SELECT '20010db8' || printf('%08x', addr) || repeat('0', 16) AS addr, len + 32 AS len, '20010db8' || repeat('0', 23) || '1' AS hop,
  CAST(1 + owner % 900 AS BIGINT) AS origin_as, 3 AS hops FROM pa""")  # fmt: skip
def src_route_table_v6(spark, sf):
    p = V.prefix_table(spark, sf)
    lines = p.select(
        F.format_string("*> 2001:db8:%x:%x::/%d 2001:db8::1 7018 %d %d i", F.shiftright("addr", 16), F.col("addr").bitwiseAND(65535), F.col("len") + 32,
                        F.expr("owner % 64"), F.expr("1 + owner % 900")).alias("value")
    )
    r, _ = readers.parse_routes(lines)
    return r.where("family = 6").select(F.lower(F.hex("addr6")).alias("addr"), "len", F.lower(F.hex("hop6")).alias("hop"), "origin_as", F.size("path").alias("hops"))


@query("src_rejects", """SELECT 'flat' AS reader, (SELECT count(*) FROM events) AS rows, (SELECT count(*) FROM events WHERE user_id % 3 = 0) AS rejects
  UNION ALL SELECT 'pattern', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 1)
  UNION ALL SELECT 'flow', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_linenumber = 2)
  UNION ALL SELECT 'route', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0)""")
def src_rejects(spark, sf):
    """Rows and rejected lines of every line reader; rejects come from broken copies of some lines."""
    e, o = table(spark, sf, "events"), table(spark, sf, "orders")
    log = e.select(F.format_string('h%d - - [t] "GET /" 200 1 "-" "a"', "user_id").alias("value"))
    log = log.unionByName(e.where("user_id % 3 = 0").select(F.concat(F.lit("h [t"), "event_type").alias("value")))
    text = o.select(F.format_string("%s::%d=1.5 x", "o_orderstatus", "o_orderkey").alias("value"))
    text = text.unionByName(o.where("o_orderkey % 4 = 1").select(F.format_string("%s::%d", "o_orderstatus", "o_orderkey").alias("value")))
    flows = _flow_lines(spark, sf)
    flows = flows.unionByName(table(spark, sf, "lineitem").where("l_linenumber = 2").select(F.concat(F.lit("300.1.1.1|1.1.1.1|"), "l_orderkey").alias("value")))
    c = table(spark, sf, "customer")
    routes = c.select(F.format_string("*> 10.%d.0.0/16 10.0.0.1 7018 i", F.expr("c_custkey % 250")).alias("value"))
    routes = routes.unionByName(c.where("c_custkey % 5 = 0").select(F.format_string("*> 10.%d.0.0/64 10.0.0.1 7018 i", F.expr("c_custkey % 250")).alias("value")))
    parsed = {
        "flat": readers.parse_flat(log, readers.ACCESS_LOG), "pattern": readers.parse_pattern(text, "%(status)s::%(key)d=%(price)f %(prio)s"),
        "flow": readers.parse_flow(flows), "route": readers.parse_routes(routes),
    }
    out = None
    for name, (rows, rejects) in parsed.items():
        both = rows.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(rejects.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
        n = both.agg(F.sum("a").alias("rows"), F.sum("b").alias("rejects")).select(F.lit(name).alias("reader"), "rows", "rejects")
        out = n if out is None else out.unionByName(n)
    return out


@query("src_event_xml", f"""WITH {V.ALARMS} SELECT alarmid, ccid, state, smode, timecleared, timeissued, type,
  sortorder, level1, id1, level2, id2, tmode, severity, text FROM alarm""")  # fmt: skip
def src_event_xml(spark, sf):
    path = scratch_path(spark, "events")
    writers.event_xml(V.alarm(spark, sf), "alarm", readers.ALARM_TAGS).write.text(path)
    good, _ = readers.read_event_xml(spark, path, "alarm")
    return good.select("alarmid", "ccid", "state", "smode", "timecleared", "timeissued", "type", "sortorder", "level1",
                       "id1", "level2", "id2", "tmode", "severity", "text")


@query("src_event_xml_stat", f"WITH {V.STAT} SELECT timeissued, level, id, key, val FROM stat")
def src_event_xml_stat(spark, sf):
    path = scratch_path(spark, "stats")
    s = V.stat(spark, sf)
    good = writers.event_xml(s, "stat", readers.STAT_TAGS)
    broken = s.select(F.concat(F.lit("<stat><rt>x"), "key", F.lit("</rt></stat>")).alias("value"))
    good.unionByName(broken).write.text(path)
    ok, _ = readers.read_event_xml(spark, path, "stat")
    return ok.select("timeissued", "level", "id", "key", "val")


@query("src_multi_glob", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def src_multi_glob(spark, sf):
    path = scratch_path(spark, "many")
    table(spark, sf, "orders").selectExpr("o_orderkey k", "o_totalprice v").write.parquet(f"{path}/a")
    table(spark, sf, "customer").selectExpr("c_custkey k", "c_acctbal v").write.parquet(f"{path}/b")
    return readers.read_many(spark, [f"{path}/*"])


@query("ds_info", "SELECT 'orders.parquet' AS file, count(*) AS rows FROM orders UNION ALL SELECT 'total', count(*) FROM orders")
def ds_info(spark, sf):
    return readers.ds_info(spark.read.parquet(f"{sf}/orders.parquet"))


@query("infer_widths", " UNION ALL ".join(
    f"SELECT '{c}' AS field, round(avg(length({c})), 8) AS average, CAST(max(length({c})) AS INTEGER) AS maximum FROM documents"
    for c in ("text", "lang", "source")))
def infer_widths(spark, sf):
    w = aggs.infer_widths(table(spark, sf, "documents").select("text", "lang", "source"))
    return w.withColumn("average", F.round("average", 8))


# --- sinks -----------------------------------------------------------------------------


@query("sink_split_by_key", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL")
def sink_split_by_key(spark, sf):
    path = scratch_path(spark, "split")
    keys = ["o_orderstatus", "o_orderpriority"]
    writers.sink_split_by_key(table(spark, sf, "orders"), path, keys)
    return spark.read.parquet(path).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("sink_split_replace", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 250000 GROUP BY ALL")
def sink_split_replace(spark, sf):
    path = scratch_path(spark, "replace")
    o = table(spark, sf, "orders")
    writers.sink_split_by_key(o, path, ["o_orderstatus"])
    writers.sink_split_by_key(o.where("o_orderstatus = 'F' and o_totalprice > 250000"), path, ["o_orderstatus"], "overwrite")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("sink_group_by_expr", """SELECT CAST(floor(l_quantity / 10) AS INTEGER) - 1 AS grp, count(*) AS n FROM lineitem
  WHERE floor(l_quantity / 10) >= 1 GROUP BY ALL""")  # fmt: skip
def sink_group_by_expr(spark, sf):
    path = scratch_path(spark, "group")
    writers.sink_group_by_expr(table(spark, sf, "lineitem"), path, "floor(l_quantity / 10) - 1")
    return spark.read.parquet(path).groupBy("grp").agg(F.count("*").alias("n"))


@query("sink_tee", """SELECT 'rows' AS sink, count(*) AS n FROM orders UNION ALL
  SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'""")  # fmt: skip
def sink_tee(spark, sf):
    a, b = scratch_path(spark, "tee"), scratch_path(spark, "tee")
    writers.sink_tee(
        table(spark, sf, "orders"),
        [lambda d: d.write.parquet(a), lambda d: d.where("o_orderstatus = 'O'").write.parquet(b)],
    )
    n = [spark.read.parquet(p).agg(F.lit(s).alias("sink"), F.count("*").alias("n")) for s, p in (("rows", a), ("open", b))]
    return n[0].unionByName(n[1])


@query("sink_table_xml", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sink_table_xml(spark, sf):
    path = scratch_path(spark, "table")
    writers.sink_table(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.option("sep", "|").option("header", True).schema("c_custkey bigint, c_name string, c_mktsegment string").csv(path)


@query("sink_formatted", """SELECT printf('%08d|%-10s|%.2f', o_orderkey, o_orderstatus, o_totalprice) || '|' ||
  strftime(o_orderdate, '%Y/%m/%d') AS value FROM orders""")  # fmt: skip
def sink_formatted(spark, sf):
    path = scratch_path(spark, "format")
    writers.sink_formatted(
        table(spark, sf, "orders"), path, "%08d|%-10s|%.2f|%s",
        ["o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy/MM/dd")],
    )
    return spark.read.text(path)


@query("sink_convert", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice, CAST(NULL AS VARCHAR) AS note FROM orders")
def sink_convert(spark, sf):
    path = scratch_path(spark, "convert")
    target = T.StructType.fromDDL("o_orderkey string, o_totalprice bigint, note string")
    writers.sink_convert(table(spark, sf, "orders"), path, target, "orc")
    return spark.read.orc(path)


@query("sink_query_export", f"""WITH {V.NODES} SELECT json_extract_string(value, '$.id') AS id, json_extract_string(value, '$.key') AS key,
  json_extract_string(value, '$.val') AS val FROM (SELECT to_json({{'id': id, 'key': key, 'val': val}}) AS value
  FROM inv_node WHERE NOT regexp_full_match(key, 'scope_.*'))""")  # fmt: skip
def sink_query_export(spark, sf):
    out = writers.export_rows(V.inv_node(spark, sf), "json", "key", "scope_.*")
    return out.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("id", "key", "val")])


# --- projections and predicates ----------------------------------------------------------


@query("extract_fields", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def extract_fields(spark, sf):
    # the stored zone-less timestamp is passed through
    return rows.extract_fields(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_linenumber", "l_shipdate"])


@query("filter_expr", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem
  WHERE l_quantity > 45 AND l_returnflag = 'R'""")  # fmt: skip
def filter_expr(spark, sf):
    out = rows.filter_expr(
        table(spark, sf, "lineitem"), "l_quantity > 45 and l_returnflag = 'R'",
        {"net": "round(l_extendedprice * (1 - l_discount), 4)"},
    )
    return out.select("l_orderkey", "l_linenumber", "net")


@query("convert_schema", """SELECT CAST(l_orderkey AS VARCHAR) AS id, 'quantity' AS metric, l_quantity AS val FROM lineitem
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'discounted', l_extendedprice FROM lineitem WHERE l_discount > 0.05""")  # fmt: skip
def convert_schema(spark, sf):
    schema = T.StructType.fromDDL("id string, metric string, val double")
    return rows.convert_schema(
        table(spark, sf, "lineitem"),
        [
            (None, {"id": "l_orderkey", "metric": "'quantity'", "val": "l_quantity"}),
            ("l_discount > 0.05", {"id": "l_orderkey", "metric": "'discounted'", "val": "l_extendedprice"}),
        ],
        schema,
    )


@query("choose_by_index", """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i
  FROM orders) WHERE i IN (SELECT c_custkey * 3 FROM customer)""")  # fmt: skip
def choose_by_index(spark, sf):
    idx = table(spark, sf, "customer").selectExpr("c_custkey * 3 as idx")
    return rows.choose_by_index(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], idx).select("o_orderkey", "o_custkey")


@query("choose_by_file_index", """SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER () - 1 AS i FROM customer)
  WHERE i IN (SELECT s_suppkey * 2 FROM supplier)""")  # fmt: skip
def choose_by_file_index(spark, sf):
    idx = table(spark, sf, "supplier").selectExpr("'customer.parquet' as file", "s_suppkey * 2 as idx")
    c = spark.read.parquet(f"{sf}/customer.parquet").select("*", "_metadata")
    return rows.choose_by_file_index(c, idx).select("c_custkey", "c_name")


@query("select_cmp", f"""WITH {V.FLOW} SELECT count(*) AS n, sum(bytes)::BIGINT AS bytes FROM flow
  WHERE (dst_port = 443 OR dst_port = 80) AND bytes >= 1000 AND NOT (tcp_flags & 2) = 0""")  # fmt: skip
def select_cmp(spark, sf):
    f = V.flow(spark, sf)
    p = F.col("dst_port").isin(80, 443) & (F.col("bytes") >= 1000) & ~(F.col("tcp_flags").bitwiseAND(2) == 0)
    return f.where(p).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("select_regex", """SELECT count(*) FILTER (regexp_full_match(p_name, 'small.*')) AS hit,
  count(*) FILTER (NOT regexp_full_match(p_name, 'small.*')) AS miss, count(*) FILTER (regexp_full_match(lower(p_type), 'eco.*y')) AS folded FROM part""")  # fmt: skip
def select_regex(spark, sf):
    m = rows.matches(F.col("p_name"), "small.*")
    return table(spark, sf, "part").agg(
        F.count_if(m).alias("hit"), F.count_if(~m).alias("miss"), F.count_if(rows.matches(F.col("p_type"), "eco.*y", True)).alias("folded")
    )


@query("select_prefix", f"""WITH {V.FLOW} SELECT orderkey, linenumber, src FROM flow
  WHERE src BETWEEN 199 * 16777216::BIGINT + 37 * 65536 AND 199 * 16777216::BIGINT + 37 * 65536 + 65535
    OR src BETWEEN 16777216::BIGINT * 64 AND 16777216::BIGINT * 80 - 1""")  # fmt: skip
def select_prefix(spark, sf):
    a = F.col("src")
    return V.flow(spark, sf).where(net.in_prefix(a, "199.37/16") | net.in_prefix(a, "64/4")).select("orderkey", "linenumber", "src")


def _paths(spark, sf):
    """An AS path per line item: the supplier's, then the part's, then the order's system."""
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.array(F.expr("l_suppkey % 7"), F.expr("l_partkey % 5"), F.expr("l_partkey % 5"), F.expr("l_orderkey % 9")).alias("path"),
    )


PATHS = """paths AS (SELECT l_orderkey, l_linenumber, [l_suppkey % 7, l_partkey % 5, l_partkey % 5, l_orderkey % 9] AS path FROM lineitem)"""


@query("select_aspath", f"""WITH {PATHS}, t AS (SELECT *, ' ' || array_to_string(path, ' ') || ' ' AS s FROM paths)
  SELECT count(*) FILTER (path[1] = 3 AND path[4] = 8) AS ends, count(*) FILTER (path[1] = 2 AND path[2] = 4) AS repeated,
  count(*) FILTER (path[1] = 3 AND path[2] <> 4 AND path[3] <> 4 AND path[4] = 1) AS negated,
  count(*) FILTER (list_contains(path, 6)) AS anywhere FROM t""")  # fmt: skip
def select_aspath(spark, sf):
    m = lambda p: F.count_if(net.aspath_match(F.col("path"), p))
    return _paths(spark, sf).agg(
        m("^3 .* 8$").alias("ends"), m("^2 4{2} .$").alias("repeated"), m("^3 !4{2} 1$").alias("negated"), m("6").alias("anywhere")
    )


@query("select_mapped", f"""WITH {V.FLOW} SELECT CASE protocol WHEN 6 THEN 'tcp' ELSE 'udp' END AS proto, count(*) AS n FROM flow
  WHERE protocol = 17 OR (protocol = 6 AND (tcp_flags & 18) = 18) GROUP BY ALL""")  # fmt: skip
def select_mapped(spark, sf):
    f = V.flow(spark, sf).withColumn("proto", codes.code_name(F.col("protocol"), codes.PROTOCOLS))
    p = (F.col("proto") == "udp") | ((F.col("proto") == "tcp") & codes.has_flags(F.col("tcp_flags"), "syn|ack", codes.TCP_FLAGS))
    return f.where(p).groupBy("proto").agg(F.count("*").alias("n"))


@query("select_nested", """SELECT count(*) FILTER (CAST(props ->> '$.k' AS BIGINT) > 50) AS big,
  count(*) FILTER (coalesce(CAST(props ->> '$.missing' AS BIGINT), 0) = 0) AS absent FROM events""")  # fmt: skip
def select_nested(spark, sf):
    e = table(spark, sf, "events").select(F.from_json("props", "k bigint, missing bigint").alias("p"))
    return e.agg(F.count_if(rows.nested("p.k", 0) > 50).alias("big"), F.count_if(rows.nested("p.missing", 0) == 0).alias("absent"))


@query("compose_pipe", """SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 20 AND l_discount < 0.03 GROUP BY ALL""")
def compose_pipe(spark, sf):
    return rows.pipe(
        table(spark, sf, "lineitem"),
        lambda d: d.where("l_quantity > 20"),
        lambda d: d.where("l_discount < 0.03"),
        lambda d: aggs.count_by_key(d, ["l_returnflag"]).withColumnRenamed("count", "n"),
    )


@query("compose_branch", """SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'rest' END AS side, count(*) AS n FROM orders GROUP BY ALL""")
def compose_branch(spark, sf):
    def tag(name):
        return lambda d: d.agg(F.lit(name).alias("side"), F.count("*").alias("n"))

    a, b = rows.branch(table(spark, sf, "orders"), "o_orderstatus = 'F'", tag("done"), tag("rest"))
    return a.unionByName(b)


@query("compose_fanout", """SELECT 'priority' AS by, o_orderpriority AS val, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY ALL""")  # fmt: skip
def compose_fanout(spark, sf):
    def by(name, c):
        return lambda d: d.groupBy(F.lit(name).alias("by"), F.col(c).alias("val")).agg(F.count("*").alias("n"))

    a, b = rows.fanout(table(spark, sf, "orders"), by("priority", "o_orderpriority"), by("status", "o_orderstatus"))
    return a.unionByName(b)


@query("select_even_odd", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders)
  WHERE r % 2 = 1""")  # fmt: skip
def select_even_odd(spark, sf):
    return rows.even_odd(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], "odd").select("o_orderkey")


CONSTRAINTS = (
    rows.Constraint("l_quantity", min=5, max=45, default=25.0),
    rows.Constraint("l_returnflag", members=("A", "N")),
    rows.Constraint("l_linestatus", pattern="[OF]", default="O"),
    rows.Constraint("l_discount", expression="l_discount <= l_tax + 0.05"),
)
OK_QTY, OK_FLAG, OK_DISC = "l_quantity BETWEEN 5 AND 45", "l_returnflag IN ('A', 'N')", "l_discount <= l_tax + CAST(0.05 AS DOUBLE)"


@query("validate_discard", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {OK_QTY} AND {OK_FLAG} AND {OK_DISC}")
def validate_discard(spark, sf):
    return rows.validate_discard(table(spark, sf, "lineitem"), _constraints()).select("l_orderkey", "l_linenumber")


def _constraints():
    *rest, last = CONSTRAINTS
    return [*rest, rows.Constraint(last.name, expression="l_discount <= l_tax + 0.05D")]


@query("validate_repair", f"""SELECT l_orderkey, l_linenumber, CASE WHEN {OK_QTY} THEN l_quantity ELSE 25.0 END AS l_quantity
  FROM lineitem WHERE {OK_FLAG} AND {OK_DISC}""")  # fmt: skip
def validate_repair(spark, sf):
    return rows.validate_repair(table(spark, sf, "lineitem"), _constraints()).select("l_orderkey", "l_linenumber", "l_quantity")


@query("validate_summary", f"""SELECT field, value, count(*) AS count FROM (SELECT CASE WHEN NOT {OK_QTY} THEN 'l_quantity'
  WHEN NOT {OK_FLAG} THEN 'l_returnflag' ELSE 'l_discount' END AS field, CASE WHEN NOT {OK_QTY} THEN CAST(l_quantity AS VARCHAR)
  WHEN NOT {OK_FLAG} THEN l_returnflag ELSE CAST(l_discount AS VARCHAR) END AS value FROM lineitem
  WHERE NOT ({OK_QTY} AND {OK_FLAG} AND {OK_DISC})) GROUP BY ALL""")  # fmt: skip
def validate_summary(spark, sf):
    return rows.validate_summary(table(spark, sf, "lineitem"), _constraints())


@query("validate_totals", f"""SELECT field, count(*) AS invalid, CAST(CASE WHEN field = 'l_quantity' THEN 0 ELSE count(*) END AS BIGINT) AS discarded,
  CAST(CASE WHEN field = 'l_quantity' THEN count(*) ELSE 0 END AS BIGINT) AS repaired FROM (SELECT CASE WHEN NOT {OK_QTY} THEN 'l_quantity'
  WHEN NOT {OK_FLAG} THEN 'l_returnflag' ELSE 'l_discount' END AS field FROM lineitem WHERE NOT ({OK_QTY} AND {OK_FLAG} AND {OK_DISC})) GROUP BY field""")  # fmt: skip
def validate_totals(spark, sf):
    return rows.validate_totals(table(spark, sf, "lineitem"), _constraints(), "repair")


@query("regex_any_search", """SELECT doc_id FROM documents WHERE regexp_matches(text, 'license', 'i') OR regexp_matches(source, '^SRC1$', 'i')""")
def regex_any_search(spark, sf):
    d = table(spark, sf, "documents")
    return rows.search_any(d, [("text", "license"), ("source", "^SRC1$")], ignore_case=True).select("doc_id")


@query("key_search", """SELECT event_id FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier)
  AND epoch_us(ts) BETWEEN 1704672000000000 AND 1705276800000000""")  # fmt: skip
def key_search(spark, sf):
    keys = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))
    span = (F.timestamp_seconds(F.lit(1704672000)), F.timestamp_seconds(F.lit(1705276800)))
    return rows.search_keys(table(spark, sf, "events"), "user_id", keys, time_col="ts", time_range=span).select("event_id")


RANGES = ((1704067200, 1704153600), (1704100000, 1704200000), (1705000000, 1705100000))


@query("time_ranges_filter", f"""WITH {V.STAT} SELECT seq, timeissued FROM stat WHERE {' OR '.join(f'timeissued BETWEEN {a} AND {b}' for a, b in RANGES)}""")
def time_ranges_filter(spark, sf):
    return rows.in_time_ranges(V.stat(spark, sf), "timeissued", RANGES).select("seq", "timeissued")


@query("prefix_lookup", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small')")
def prefix_lookup(spark, sf):
    return rows.prefix_lookup(table(spark, sf, "part"), "p_name", "small").select("p_partkey", "p_name")


@query("count_selected", "SELECT count(*) FILTER (o_totalprice > 200000) AS matched, count(*) AS total FROM orders")
def count_selected(spark, sf):
    return rows.count_selected(table(spark, sf, "orders"), "o_totalprice > 200000")


# --- joins ---------------------------------------------------------------------------------


def _cust(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")


def _ord(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("k"), "o_orderkey")


@query("join_inner", "SELECT o_custkey * 2 AS k, o_orderkey, c_name FROM orders JOIN customer ON o_custkey * 2 = c_custkey")
def join_inner(spark, sf):
    return joins.join_tables(_ord(spark, sf), _cust(spark, sf), ["k"], fields=["k", "o_orderkey", "c_name"])


@query("join_inner_salted", "SELECT o_custkey * 2 AS k, o_orderkey, c_name FROM orders JOIN customer ON o_custkey * 2 = c_custkey")
def join_inner_salted(spark, sf):
    return joins.salted_join(_ord(spark, sf), _cust(spark, sf), ["k"]).select("k", "o_orderkey", "c_name")


for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):

    def _outer(spark, sf, how=_how):
        out = joins.join_tables(_ord(spark, sf), _cust(spark, sf), ["k"], how, fill="-")
        return out.na.fill({"o_orderkey": -1})

    query(
        f"join_{_how}_outer",
        f"""SELECT coalesce(o.k, c_custkey) AS k, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(c_name, '-') AS c_name
  FROM (SELECT o_custkey * 2 AS k, o_orderkey FROM orders) o {_sql} JOIN customer ON k = c_custkey""",
    )(_outer)


@query("join_anti", "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)")
def join_anti(spark, sf):
    return joins.join_tables(_cust(spark, sf), _ord(spark, sf), ["k"], "left_anti")


@query("lookup_semi", """SELECT CASE WHEN user_id IN (SELECT s_suppkey FROM supplier) THEN 'in' ELSE 'out' END AS side, count(*) AS n FROM events GROUP BY ALL""")
def lookup_semi(spark, sf):
    e, v = table(spark, sf, "events"), table(spark, sf, "supplier").select("s_suppkey")
    parts = [
        joins.lookup_semi(e, "user_id", v, reject).agg(F.lit(s).alias("side"), F.count("*").alias("n"))
        for s, reject in (("in", False), ("out", True))
    ]
    return parts[0].unionByName(parts[1])


@query("lookup_dict_unique", """WITH a AS (SELECT s_nationkey, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier),
  b AS (SELECT s_suppkey AS k, s_name FROM supplier)
  SELECT c_custkey, coalesce(b.s_name, a.s_name) AS s_name FROM customer LEFT JOIN b ON b.k = c_custkey
  LEFT JOIN a ON a.s_nationkey = c_nationkey AND a.r = 1""")  # fmt: skip
def lookup_dict_unique(spark, sf):
    s = table(spark, sf, "supplier")
    out = joins.lookup_dict(
        table(spark, sf, "customer"), s, [[("c_custkey", "s_suppkey")], [("c_nationkey", "s_nationkey")]], ["s_name"],
        first_by=["s_suppkey"],
    )
    return out.select("c_custkey", "s_name")


@query("lookup_dict_all", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def lookup_dict_all(spark, sf):
    return joins.lookup_dict(
        table(spark, sf, "customer"), table(spark, sf, "orders"), [[("c_custkey", "o_custkey")]], ["o_orderkey"]
    ).select("c_custkey", "o_orderkey")


@query("lookup_array", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_array(spark, sf):
    return joins.lookup_dict(
        table(spark, sf, "supplier"), table(spark, sf, "nation"), [[("s_nationkey", "n_nationkey")]], ["n_name"],
        first_by=["n_name"],
    ).select("s_suppkey", "n_name")


@query("lookup_sorted", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def lookup_sorted(spark, sf):
    o = table(spark, sf, "orders")
    return joins.lookup_dict(
        o, table(spark, sf, "lineitem"), [[("o_orderkey", "l_orderkey")]], ["l_linenumber", "l_quantity"], how="inner"
    ).select("o_orderkey", "l_linenumber", "l_quantity")


@query("choose_by_value_map", """SELECT 'fwd' AS dir, s_suppkey AS k, CAST(s_nationkey AS BIGINT) AS mapped FROM supplier WHERE s_suppkey IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'rev', n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey""")  # fmt: skip
def choose_by_value_map(spark, sf):
    pairs = table(spark, sf, "supplier").selectExpr("s_suppkey a", "bigint(s_nationkey) b")
    keys = table(spark, sf, "nation").selectExpr("bigint(n_nationkey) k")
    f, r = (joins.choose_by_value_map(keys, pairs, "k", d).withColumn("dir", F.lit(n)) for d, n in ((True, "fwd"), (False, "rev")))
    return f.unionByName(r)


@query("translate_id", f"""WITH {V.STAT} SELECT seq, CASE WHEN CAST(id AS BIGINT) IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
  THEN 'Supplier#' || lpad(id, 9, '0') ELSE id END AS id FROM stat""")  # fmt: skip
def translate_id(spark, sf):
    trans = table(spark, sf, "supplier").where("s_acctbal > 0").selectExpr("string(s_suppkey) inid", "s_name outid")
    return joins.translate_id(V.stat(spark, sf), ["id"], trans).select("seq", "id")


@query("merge_first_wins", """SELECT rn, coalesce(a.name, '') || chr(9) || coalesce(b.name, '') AS line FROM
  (SELECT row_number() OVER (ORDER BY c_name) AS rn, c_name AS name FROM customer) a FULL JOIN
  (SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS rn, p_name AS name FROM part) b USING (rn)""")  # fmt: skip
def merge_first_wins(spark, sf):
    return joins.paste(
        [table(spark, sf, "customer"), table(spark, sf, "part")], [["c_name"], ["p_name", "p_partkey"]], ["c_name", "p_name"]
    )


# Ranges of customers: many start at one point, some erase; and aligned blocks in each other.
_FLAT_SQL = """r AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 1000 ELSE c_custkey * 7919 % 400000 END AS lo, c_custkey * 104729 % 30011 AS len,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS value, c_custkey AS o FROM customer)"""
_NEST_SQL = """r AS (SELECT (c_custkey * 7919 % 500000) >> (4 + c_custkey % 12) << (4 + c_custkey % 12) AS lo, (1 << (4 + c_custkey % 12)) - 1 AS len, c_custkey AS value, c_custkey AS o FROM customer)"""


@query("interval_flat", f"""WITH {_FLAT_SQL}, p AS (SELECT lo AS p FROM r UNION SELECT lo + len + 1 FROM r), e AS (SELECT p AS lo, lead(p) OVER (ORDER BY p) - 1 AS hi FROM p),
  c AS (SELECT e.lo, e.hi, max(r.o) AS o FROM e JOIN r ON r.lo <= e.lo AND r.lo + r.len >= e.hi GROUP BY ALL), v AS (SELECT c.lo, c.hi, r.value FROM c JOIN r USING (o) WHERE r.value IS NOT NULL),
  n AS (SELECT *, CASE WHEN lag(hi) OVER w + 1 = lo AND lag(value) OVER w = value THEN 0 ELSE 1 END AS brk FROM v WINDOW w AS (ORDER BY lo)),
  g AS (SELECT *, sum(brk) OVER (ORDER BY lo) AS run FROM n) SELECT min(lo)::BIGINT AS lo, max(hi)::BIGINT AS hi, min(value) AS value FROM g GROUP BY run""")
def interval_flat(spark, sf):
    """Later ranges overwrite earlier ones; equal neighbours are one."""
    r = table(spark, sf, "customer").selectExpr(
        "if(c_custkey % 3 = 0, 1000, c_custkey * 7919 % 400000) as lo", "c_custkey * 104729 % 30011 as len", "if(c_custkey % 10 = 0, null, c_nationkey) as value", "c_custkey as o"
    )
    return intervals.flat_segments(r.withColumn("hi", F.expr("lo + len")), "lo", "hi", "value", "o", per_chunk=500)


@query("interval_nested", f"""WITH {_NEST_SQL}, m AS (SELECT o_orderkey, r.value, row_number() OVER (PARTITION BY o_orderkey ORDER BY len, o DESC) AS k FROM orders JOIN r ON o_totalprice::BIGINT BETWEEN lo AND lo + len)
  SELECT o_orderkey, value FROM m WHERE k = 1""")
def interval_nested(spark, sf):
    """The innermost range of every order's price."""
    k = "(4 + c_custkey % 12)"
    r = table(spark, sf, "customer").selectExpr(
        f"shiftleft(shiftright(c_custkey * 7919 % 500000, int{k}), int{k}) as lo", f"shiftleft(1L, int{k}) - 1 as len", "c_custkey as value", "c_custkey as o"
    )
    seg = intervals.nested_segments(r.withColumn("hi", F.expr("lo + len")), "lo", "hi", "value", "o", per_chunk=500)
    o = table(spark, sf, "orders").withColumn("p", F.expr("bigint(round(o_totalprice))"))
    return intervals.innermost_join(o, "p", seg).select("o_orderkey", "value")


@query("interval_join", """SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice::BIGINT BETWEEN s_suppkey * 4000 AND s_suppkey * 4000 + s_nationkey * 300""")
def interval_join(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "bigint(round(o_totalprice)) as p")
    r = table(spark, sf, "supplier").selectExpr("s_suppkey", "s_suppkey * 4000 as lo", "s_suppkey * 4000 + s_nationkey * 300 as hi")
    return joins.interval_join(o, "p", r, "lo", "hi").select("o_orderkey", "s_suppkey")


# --- rules ---------------------------------------------------------------------------------

RULES = (
    joins.AlarmRule("disk_used.sd1", r"disk_9 usage at 5.%", state=3, severity=2, tmode=2, comment="known disk"),
    joins.AlarmRule("disk.low", r"disk_([0-3]) usage at ([0-9])%", state=1, severity=4, names=("disk", "pct"), variables="src=rule"),
    joins.AlarmRule("disk.host", r"disk_.* usage at .*", obj="1[0-9]*", state=2, smode=1),
    joins.AlarmRule("disk.any", r".*usage.*", state=3),
    joins.AlarmRule("__ANY__", state=1, comment="fallback"),
)
RULE_SQL = f"""{V.ALARMS}, ruled AS (SELECT *, CASE WHEN alarmid = 'disk_used.sd1' THEN 0 WHEN alarmid <> '' THEN 4
  WHEN regexp_full_match(text, 'disk_9 usage at 5.%') THEN 0
  WHEN regexp_full_match(text, 'disk_([0-3]) usage at ([0-9])%') THEN 1
  WHEN regexp_full_match(id1, '1[0-9]*') AND regexp_full_match(text, 'disk_.* usage at .*') THEN 2
  WHEN regexp_full_match(text, '.*usage.*') THEN 3 END AS rule FROM alarm)"""


@query("rule_match_first", f"""WITH {RULE_SQL} SELECT seq, rule, CASE WHEN rule = 1 THEN 'disk=' || regexp_extract(text, 'disk_([0-3]) usage at ([0-9])%', 1)
  || chr(9) || chr(9) || 'pct=' || regexp_extract(text, 'disk_([0-3]) usage at ([0-9])%', 2) ELSE '' END AS captured FROM ruled""")  # fmt: skip
def rule_match_first(spark, sf):
    a = joins.rule_match_first(V.alarm(spark, sf), RULES)
    return joins.rule_captures(a, RULES).select("seq", "rule", "captured")


@query("rule_apply_overrides", f"""WITH {RULE_SQL} SELECT seq, CASE WHEN alarmid = '' THEN ['disk_used.sd1', 'disk.low', 'disk.host', 'disk.any'][rule + 1] ELSE alarmid END AS alarmid,
  [3, 1, 2, 3, 1][rule + 1] AS state, CASE WHEN rule = 0 THEN 2 ELSE tmode END AS tmode, CASE WHEN rule = 2 THEN 1 ELSE smode END AS smode,
  CASE rule WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE severity END AS severity, CASE rule WHEN 0 THEN 'known disk' WHEN 4 THEN 'fallback' ELSE '' END AS comment,
  variables || CASE WHEN rule = 1 THEN chr(9) || chr(9) || 'src=rule' ELSE '' END AS variables FROM ruled""")  # fmt: skip
def rule_apply_overrides(spark, sf):
    a = joins.rule_apply_overrides(joins.rule_match_first(V.alarm(spark, sf), RULES), RULES)
    return a.select("seq", "alarmid", "state", "tmode", "smode", "severity", "comment", "variables")


FILTERS = (
    joins.FilterRule(obj="[0-9]", account="ops", tmode=3, comment="maintenance", start=1704067200, end=1705000000),
    joins.FilterRule(text="disk_[5-9] .*", account="disk", severity=5, smode=1),
)


# A table of 300 rules, looked up by its index.
_MANY = tuple(
    joins.AlarmRule(
        "disk_used.sd1" if i == 7 else joins.ANY_RULE if i == 50 else f"rule{i}", f"disk_([0-{i % 10}]) usage at {i % 150}%",
        obj=None if i % 3 else f".*{i % 7}.*", state=i % 5, severity=i % 4, names=("disk",),
    )
    for i in range(300)
)


@query("rule_match_indexed", f"""WITH {V.ALARMS}, x AS (SELECT seq, id1, text, severity, CASE WHEN seq % 2 = 0 THEN '' ELSE alarmid END AS aid FROM alarm),
  r AS (SELECT i::INTEGER AS i, CASE WHEN i = 7 THEN 'disk_used.sd1' WHEN i = 50 THEN '__ANY__' ELSE 'rule' || i END AS id, 'disk_([0-' || i % 10 || ']) usage at ' || i % 150 || '%' AS p, CASE WHEN i % 3 = 0 THEN '.*' || i % 7 || '.*' END AS o FROM range(300) t(i)),
  d AS (SELECT DISTINCT text, id1 FROM x WHERE aid = ''), m AS (SELECT text, id1, min(i) AS i FROM d JOIN r ON regexp_full_match(text, p) AND (o IS NULL OR regexp_full_match(id1, o)) GROUP BY ALL),
  f AS (SELECT x.*, CASE WHEN aid = '' THEN m.i ELSE coalesce(k.i, 50) END AS rule FROM x LEFT JOIN m ON m.text = x.text AND m.id1 = x.id1 LEFT JOIN r k ON k.id = x.aid)
  SELECT seq, rule::INTEGER AS rule, CASE WHEN rule IS NULL THEN '' ELSE 'disk=' || regexp_extract(text, '^(?:disk_([0-' || rule % 10 || ']) usage at ' || rule % 150 || '%)$', 1) END AS captured,
    CASE WHEN rule % 4 > 0 THEN (rule % 4)::INTEGER ELSE severity END AS severity FROM f""")  # fmt: skip
def rule_match_indexed(spark, sf):
    """First match of every alarm in a large rule table, with captures and overrides."""
    a = V.alarm(spark, sf).withColumn("alarmid", F.expr("if(seq % 2 = 0, '', alarmid)"))
    a = joins.rule_captures(joins.rule_match_first(a, _MANY), _MANY)
    return joins.rule_apply_overrides(a, _MANY).select("seq", "rule", "captured", "severity")


@query("filter_rule_match", f"""WITH {V.ALARMS}, f AS (SELECT *, CASE WHEN timeissued BETWEEN 1704067200 AND 1705000000 AND regexp_full_match(id1, '[0-9]') THEN 0
  WHEN regexp_full_match(text, 'disk_[5-9] .*') THEN 1 END AS flt FROM alarm) SELECT seq, CASE WHEN flt = 0 THEN 3 ELSE tmode END AS tmode,
  CASE WHEN flt = 1 THEN 1 ELSE smode END AS smode, CASE WHEN flt = 1 THEN 5 ELSE severity END AS severity,
  CASE WHEN flt = 0 THEN 'maintenance' ELSE '' END AS comment, CASE flt WHEN 0 THEN 'ops' WHEN 1 THEN 'disk' END AS account FROM f""")  # fmt: skip
def filter_rule_match(spark, sf):
    return joins.filter_rule_match(V.alarm(spark, sf), FILTERS).select("seq", "tmode", "smode", "severity", "comment", "account")


@query("attr_conditions", f"""WITH {V.NODES} SELECT level, id FROM inv_node WHERE key = 'segment' AND regexp_matches(val, '^(BUILD|MACH)')
  INTERSECT SELECT level, id FROM inv_node WHERE key = 'name' AND regexp_matches(val, '[02468]$')""")  # fmt: skip
def attr_conditions(spark, sf):
    return joins.attr_conditions(V.inv_node(spark, sf), [("segment", "^(BUILD|MACH)"), ("name", "[02468]$")])


THRESHOLDS = (
    joins.ThresholdRule("cpu", "CLEAR:5:1:1;ACTUAL:i:90:n::1:2:3:1:300", "host-1.*", by_name=True, account="a"),
    joins.ThresholdRule("cpu", "ACTUAL:i:95:n::2:2:3:1:300", ".*", account="b"),
    joins.ThresholdRule("mem", "ACTUAL:i:80:n::2:2:3:1:300", "7", regex=False, account="b"),
    joins.ThresholdRule("mem", "ACTUAL:i:99:n::3:1:1:1:300", "[0-9]", account="c"),
)
ACCOUNTS = {"a": [("r", "[01]")], "b": [("r", "__ALL__"), ("n", "1?[0-9]")], "c": []}


@query("threshold_match", f"""WITH {V.NODES}, {V.CLOSURE}, a AS (SELECT level, id FROM assets WHERE level = 'o'),
  x AS (SELECT a.id, (SELECT min(id2) FROM closure c WHERE c.level1 = 'o' AND c.id1 = a.id AND c.level2 = 'c') AS cid,
   EXISTS (SELECT 1 FROM closure c WHERE c.level1 = 'o' AND c.id1 = a.id AND c.level2 = 'r' AND regexp_full_match(c.id2, '[01]')) AS ra,
   EXISTS (SELECT 1 FROM closure c WHERE c.level1 = 'o' AND c.id1 = a.id AND c.level2 = 'n' AND regexp_full_match(c.id2, '1?[0-9]')) AS nb FROM a),
  cpu AS (SELECT id, cid, 'cpu' AS stat, CASE WHEN starts_with(id, '1') AND ra THEN 'a' WHEN nb THEN 'b' END AS account FROM x),
  mem AS (SELECT id, cid, 'mem' AS stat, CASE WHEN id = '7' AND nb THEN 'b' WHEN length(id) = 1 THEN 'c' END AS account FROM x)
  SELECT 'o' AS level, * FROM (SELECT * FROM cpu UNION ALL SELECT * FROM mem) WHERE account IS NOT NULL AND cid IS NOT NULL""")  # fmt: skip
def threshold_match(spark, sf):
    nodes = V.inv_node(spark, sf)
    assets = nodes.where("level = 'o'").select("level", "id").distinct()
    out = joins.threshold_match(assets, V.closure(spark, sf), nodes, THRESHOLDS, ACCOUNTS)
    return out.select("level", "id", "cid", "stat", "account")


@query("profile_expand", f"""WITH {V.NODES}, a AS (SELECT DISTINCT level, id FROM inv_node)
  SELECT level, id, 'click' AS key, 'SIGMA:1' AS spec FROM a WHERE CAST(id AS BIGINT) % 3 = 0
  UNION ALL SELECT level, id, 'view.x', 'ACTUAL:%' FROM a
  UNION ALL SELECT level, id, 'purchase0', 'ACTUAL:' || val FROM inv_node WHERE key = 'si_sz_purchase0'""")  # fmt: skip
def profile_expand(spark, sf):
    nodes = V.inv_node(spark, sf)
    assets = nodes.select("level", "id").distinct()
    rules = assets.selectExpr("level", "id", "'click' as key", "'SIGMA:1' as spec", "if(bigint(id) % 3 = 0, 'keep', 'drop') as status")
    levels = assets.select("level").distinct()
    lv = levels.select("level", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("r_regionkey")).selectExpr(
        "level", "if(r_regionkey = 0, 'view.x', 'purchase') as key", "'ACTUAL:%' as spec"
    )
    return joins.profile_expand(assets, nodes, rules, lv)


@query("row_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem")
def row_numbers(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    li = table(spark, sf, "lineitem").select(*order)
    return ordered.number_rows(li, order).select("l_orderkey", "l_linenumber", "l_partkey", "rn")
