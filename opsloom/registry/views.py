"""The operations views of the input tables: stat points, alarms, inventory, flows.

Every view is stated twice, as a DataFrame and as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ALARM
from ..operators.graph import level_closure, map_closure
from ..operators.stats import CatalogueEntry, frame_assign
from ..session import scratch_path, stored
from .core import table

INTERVAL = 300

CATALOGUE = (
    CatalogueEntry("click", "Clicks (All)", "Clicks (%s)", "avg", 500.0, "", "sum"),
    CatalogueEntry("view", "Views (All)", "Views (%s)", "sum", None, "", "avg"),
    CatalogueEntry("purchase", "Purchases (All)", "Purchases (%s)", "max", None, "cap_purchase", "max"),
    CatalogueEntry("signup", "Signups (All)", "Signups (%s)", "min", 100.0, "", "min"),
    CatalogueEntry("error", "Errors (All)", "Errors (%s)", "avg", None, "", "avg"),
)
MODE_SQL = "CASE key WHEN 'view' THEN 'sum' WHEN 'purchase' THEN 'max' WHEN 'signup' THEN 'min' ELSE 'avg' END"
GROUP_SQL = "CASE key WHEN 'click' THEN 'sum' WHEN 'purchase' THEN 'max' WHEN 'signup' THEN 'min' ELSE 'avg' END"


def stat(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.lit("o").alias("level"), F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("key"),
        F.lit("").alias("unit"), F.unix_timestamp("ts").alias("timeissued"), F.col("value").alias("val"),
        F.lit("").alias("label"), F.col("event_id").alias("seq"),
    )


STAT = """stat AS (SELECT 'o' AS level, CAST(user_id AS VARCHAR) AS id, event_type AS key, '' AS unit,
  epoch_us(ts) // 1000000 AS timeissued, value AS val, '' AS label, event_id AS seq FROM events)"""


def framed(spark: SparkSession, sf: str) -> DataFrame:
    return frame_assign(stat(spark, sf), INTERVAL)


FRAMED = STAT + """,
shifted AS (SELECT *, timeissued + 150 AS t FROM stat),
framed AS (SELECT level, id, key, unit, val, label, seq, t - t % 300 AS timeissued,
  CAST((t % 86400) // 300 AS INTEGER) AS frame, strftime(make_timestamp(t * 1000000), '%Y.%m.%d') AS dateissued,
  strftime(make_timestamp(t * 1000000), '%H') AS hourissued FROM shifted)"""

# one value per (series, frame start)
POINTS = FRAMED + f""",
points AS (SELECT level, id, key, timeissued, frame, CASE WHEN mode = 'sum' THEN s WHEN mode = 'max' THEN hi
    WHEN mode = 'min' THEN lo ELSE a END AS val FROM (
  SELECT level, id, key, timeissued, frame, {MODE_SQL} AS mode, sum(val) AS s, max(val) AS hi, min(val) AS lo,
    avg(val) AS a FROM framed GROUP BY ALL))"""


def alarm(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type in ('error', 'signup')")
    s = lambda c: F.expr(c).cast("string")
    cols = {
        "scope": F.lit(""),
        "alarmid": F.expr("if(event_type = 'error' or event_id % 3 = 0, 'disk_used.sd' || (user_id % 3), '')"),
        "ccid": F.expr("if(event_id % 7 = 0, 'cc' || (user_id % 20), '')"),
        "state": F.expr("if(event_type = 'error', 3, 4)"),
        "smode": F.expr("int(1 + event_id % 3)"),
        "variables": F.expr("'k=' || get_json_object(props, '$.k') || '\t\tu=' || user_id"),
        "dateissued": F.date_format("ts", "yyyy.MM.dd"),
        "hourissued": F.date_format("ts", "HH"),
        "timecleared": F.expr("if(event_type = 'signup' and event_id % 3 = 1, unix_timestamp(ts) - 60, 0L)"),
        "timeissued": F.unix_timestamp("ts"),
        "type": F.expr("if(event_type = 'error', 1, 2)"),
        "sortorder": F.expr("if(event_id % 7 = 0 and event_id % 2 = 0, 2, 1)"),
        "pmode": F.lit(1),
        "level1": F.lit("o"),
        "id1": s("user_id"),
        "level2": F.expr("if(event_id % 4 = 0, 'o', '')"),
        "id2": F.expr("if(event_id % 4 = 0, string(user_id + 1), '')"),
        "tmode": F.expr("int(1 + event_id % 3)"),
        "severity": F.expr("int(1 + event_id % 5)"),
        "text": F.expr("'disk_' || (event_id % 10) || ' usage at ' || get_json_object(props, '$.k') || '%'"),
        "comment": F.lit(""),
        "origmsg": F.lit(""),
    }
    return e.select(F.col("event_id").alias("seq"), *[cols[f.name].alias(f.name) for f in ALARM.fields])


ALARMS = """alarm AS (SELECT event_id AS seq,
  CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN 'disk_used.sd' || (user_id % 3) ELSE '' END AS alarmid,
  CASE WHEN event_id % 7 = 0 THEN 'cc' || (user_id % 20) ELSE '' END AS ccid,
  CASE WHEN event_type = 'error' THEN 3 ELSE 4 END AS state, CAST(1 + event_id % 3 AS INTEGER) AS smode,
  'k=' || (props ->> '$.k') || chr(9) || chr(9) || 'u=' || user_id AS variables,
  CASE WHEN event_type = 'signup' AND event_id % 3 = 1 THEN epoch_us(ts) // 1000000 - 60 ELSE 0 END AS timecleared,
  epoch_us(ts) // 1000000 AS timeissued, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS type,
  CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN 2 ELSE 1 END AS sortorder, 'o' AS level1,
  CAST(user_id AS VARCHAR) AS id1, CASE WHEN event_id % 4 = 0 THEN 'o' ELSE '' END AS level2,
  CASE WHEN event_id % 4 = 0 THEN CAST(user_id + 1 AS VARCHAR) ELSE '' END AS id2,
  CAST(1 + event_id % 3 AS INTEGER) AS tmode, CAST(1 + event_id % 5 AS INTEGER) AS severity,
  'disk_' || (event_id % 10) || ' usage at ' || (props ->> '$.k') || '%' AS text, '' AS comment
  FROM events WHERE event_type IN ('error', 'signup'))"""

ECHO = ALARMS + """,
last_over AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ccid ORDER BY seq DESC) AS r FROM alarm
  WHERE ccid <> '' AND sortorder = 2) WHERE r = 1),
echo AS (SELECT a.ccid, min(a.seq) AS seq FROM alarm a JOIN last_over o ON a.ccid = o.ccid AND a.sortorder = 1
  AND a.timeissued = o.timeissued AND a.severity = o.severity AND a.state = o.state AND a.type = o.type
  AND a.text = o.text GROUP BY a.ccid),
deduped AS (SELECT * FROM alarm WHERE seq NOT IN (SELECT seq FROM echo))"""


# --- inventory --------------------------------------------------------------------------


_INVENTORY: dict[tuple, tuple] = {}


def _once(spark: SparkSession, sf: str, what: str, build) -> DataFrame:
    """Inventory tables are built once per application and read by its queries, as
    the daily inventory load of an operations centre would provide them."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _INVENTORY:
        df = build()
        path = scratch_path(spark, what)
        df.write.parquet(path)
        _INVENTORY[key] = path, df.schema
    path, schema = _INVENTORY[key]
    return spark.read.schema(schema).parquet(path)


def inv_node(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "inventory", lambda: _inv_node(spark, sf))


def _inv_node(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of customers, suppliers, nations, regions and monitored objects."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")

    def rows(df, level, key, **attrs):
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.expr(v).cast("string").alias("val")) for k, v in attrs.items()]))
        return df.select(F.lit(level).alias("level"), F.col(key).cast("string").alias("id"), pairs.alias("p")).select(
            "level", "id", "p.key", "p.val"
        )

    o = table(spark, sf, "events").select("user_id").distinct()
    parts = [
        rows(c, "c", "c_custkey", name="c_name", segment="c_mktsegment"),
        rows(s, "s", "s_suppkey", name="s_name", balance="string(cast(s_acctbal as decimal(12,2)))"),
        rows(n, "n", "n_nationkey", name="n_name"),
        rows(r, "r", "r_regionkey", name="r_name"),
        rows(o, "o", "user_id", name="'host-' || user_id", cap_purchase="string(100 + user_id % 7 * 50)",
             si_sz_purchase0="string(user_id % 5)", scope_servicelevel="'sl' || (user_id % 2)",
             scope_systype="'st' || (user_id % 3)"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES = """inv_node AS (
  SELECT 'c' AS level, CAST(c_custkey AS VARCHAR) AS id, 'name' AS key, c_name AS val FROM customer
  UNION ALL SELECT 'c', CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment FROM customer
  UNION ALL SELECT 's', CAST(s_suppkey AS VARCHAR), 'name', s_name FROM supplier
  UNION ALL SELECT 's', CAST(s_suppkey AS VARCHAR), 'balance', CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) FROM supplier
  UNION ALL SELECT 'n', CAST(n_nationkey AS VARCHAR), 'name', n_name FROM nation
  UNION ALL SELECT 'r', CAST(r_regionkey AS VARCHAR), 'name', r_name FROM region
  UNION ALL SELECT 'o', CAST(user_id AS VARCHAR), k, v FROM (SELECT user_id, unnest(['name', 'cap_purchase',
    'si_sz_purchase0', 'scope_servicelevel', 'scope_systype']) AS k, unnest(['host-' || user_id,
    CAST(100 + user_id % 7 * 50 AS VARCHAR), CAST(user_id % 5 AS VARCHAR), 'sl' || (user_id % 2),
    'st' || (user_id % 3)]) AS v FROM (SELECT DISTINCT user_id FROM events)))"""


def inv_map(spark: SparkSession, sf: str) -> DataFrame:
    def rows(df, l1, i1, l2, i2):
        return df.select(
            F.lit(l1).alias("level1"), F.col(i1).cast("string").alias("id1"), F.lit(l2).alias("level2"),
            F.col(i2).cast("string").alias("id2"), F.lit("").alias("key"), F.lit("").alias("val"),
        )

    o = table(spark, sf, "events").select("user_id", F.col("user_id").alias("cust")).distinct()
    parts = [
        rows(table(spark, sf, "customer"), "c", "c_custkey", "n", "c_nationkey"),
        rows(table(spark, sf, "supplier"), "s", "s_suppkey", "n", "s_nationkey"),
        rows(table(spark, sf, "nation"), "n", "n_nationkey", "r", "n_regionkey"),
        rows(o, "o", "user_id", "c", "cust"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


MAPS = """inv_map AS (
  SELECT 'c' AS level1, CAST(c_custkey AS VARCHAR) AS id1, 'n' AS level2, CAST(c_nationkey AS VARCHAR) AS id2 FROM customer
  UNION ALL SELECT 's', CAST(s_suppkey AS VARCHAR), 'n', CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'n', CAST(n_nationkey AS VARCHAR), 'r', CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT DISTINCT 'o', CAST(user_id AS VARCHAR), 'c', CAST(user_id AS VARCHAR) FROM events)"""

# ancestors over any number of hops, without and with the asset itself
CLOSURE = MAPS + """,
hop2 AS (SELECT a.level1, a.id1, b.level2, b.id2 FROM inv_map a JOIN inv_map b ON a.level2 = b.level1 AND a.id2 = b.id1),
hop3 AS (SELECT a.level1, a.id1, b.level2, b.id2 FROM hop2 a JOIN inv_map b ON a.level2 = b.level1 AND a.id2 = b.id1),
above AS (SELECT level1, id1, level2, id2 FROM inv_map UNION SELECT * FROM hop2 UNION SELECT * FROM hop3),
assets AS (SELECT DISTINCT level, id FROM inv_node),
closure AS (SELECT * FROM above UNION SELECT level, id, level, id FROM assets)"""


def closure(spark: SparkSession, sf: str) -> DataFrame:
    """Ancestors of every asset, with the asset itself."""
    return _once(spark, sf, "closure", lambda: build_closure(spark, sf, identity=True))


def build_closure(spark: SparkSession, sf: str, identity: bool) -> DataFrame:
    m = stored(inv_map(spark, sf), "maps")
    levels = level_closure(m.select(F.col("level1").alias("id1"), F.col("level2").alias("id2")))
    return map_closure(inv_node(spark, sf), m, levels, identity=identity)


# --- flows and prefixes ----------------------------------------------------------------


def flow(spark: SparkSession, sf: str) -> DataFrame:
    """One flow record per line item, with deterministic addresses."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.expr("(l_orderkey * 2654435761) % 4294967296").alias("src"),
        F.expr("(l_partkey * 2246822519) % 4294967296").alias("dst"),
        F.expr("int(1024 + l_suppkey % 50000)").alias("src_port"),
        F.expr("int(case l_linenumber % 3 when 0 then 80 when 1 then 443 else 53 end)").alias("dst_port"),
        F.expr("int(case l_linenumber % 3 when 2 then 17 else 6 end)").alias("protocol"),
        F.expr("int(l_orderkey % 64)").alias("tcp_flags"),
        F.expr("bigint(l_quantity)").alias("packets"),
        F.expr("bigint(l_extendedprice)").alias("bytes"),
        F.unix_timestamp("l_shipdate").alias("first"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
    )


FLOW = """flow AS (SELECT (l_orderkey * 2654435761) % 4294967296 AS src, (l_partkey * 2246822519) % 4294967296 AS dst,
  CAST(1024 + l_suppkey % 50000 AS INTEGER) AS src_port,
  CASE l_linenumber % 3 WHEN 0 THEN 80 WHEN 1 THEN 443 ELSE 53 END AS dst_port,
  CASE l_linenumber % 3 WHEN 2 THEN 17 ELSE 6 END AS protocol, CAST(l_orderkey % 64 AS INTEGER) AS tcp_flags,
  CAST(floor(l_quantity) AS BIGINT) AS packets, CAST(floor(l_extendedprice) AS BIGINT) AS bytes,
  epoch_us(l_shipdate) // 1000000 AS first, l_orderkey AS orderkey, l_linenumber AS linenumber FROM lineitem)"""


def prefix_table(spark: SparkSession, sf: str, which: str = "a") -> DataFrame:
    """Prefixes from customers (a) or suppliers and parts (b), lengths 8..24."""
    if which == "a":
        c = table(spark, sf, "customer")
        num, ln, val = "c_custkey * 2654435761", "8 + c_custkey % 17", "c_custkey"
    else:
        c = table(spark, sf, "part")
        num, ln, val = "p_partkey * 1103515245 + 12345", "8 + p_partkey % 13", "p_partkey"
    return c.select(
        F.expr(f"({num}) % 4294967296").alias("raw"), F.expr(f"int({ln})").alias("len"), F.expr(val).alias("owner")
    ).selectExpr("raw - raw % shiftleft(1L, 32 - len) as addr", "len", "owner")


PFX_A = """pa AS (SELECT raw - raw % (1::BIGINT << (32 - len)) AS addr, len, owner FROM (SELECT
  (c_custkey * 2654435761) % 4294967296 AS raw, CAST(8 + c_custkey % 17 AS INTEGER) AS len, c_custkey AS owner FROM customer))"""
PFX_B = """pb AS (SELECT raw - raw % (1::BIGINT << (32 - len)) AS addr, len, owner FROM (SELECT
  (p_partkey * 1103515245 + 12345) % 4294967296 AS raw, CAST(8 + p_partkey % 13 AS INTEGER) AS len, p_partkey AS owner FROM part))"""
RANGES = PFX_A + ",\n" + PFX_B + """,
ra AS (SELECT addr AS lo, addr + (1::BIGINT << (32 - len)) - 1 AS hi FROM pa),
rb AS (SELECT addr AS lo, addr + (1::BIGINT << (32 - len)) - 1 AS hi FROM pb),
edges AS (SELECT lo AS pos, 1 AS da, 0 AS db FROM ra UNION ALL SELECT hi + 1, -1, 0 FROM ra
  UNION ALL SELECT lo, 0, 1 FROM rb UNION ALL SELECT hi + 1, 0, -1 FROM rb),
depth AS (SELECT pos, sum(sum(da)) OVER (ORDER BY pos) AS ca, sum(sum(db)) OVER (ORDER BY pos) AS cb FROM edges GROUP BY pos)"""


def sweep_sql(inside: str) -> str:
    """Maximal ranges where a condition on the depths ca, cb holds."""
    return f"""SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM (
  SELECT pos AS lo, lead(pos) OVER (ORDER BY pos) - 1 AS hi, was FROM (
    SELECT pos, {inside} AS was, lag({inside}, 1, false) OVER (ORDER BY pos) AS prev FROM depth) WHERE was <> prev)
  WHERE was"""
