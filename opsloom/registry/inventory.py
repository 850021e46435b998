"""Queries for the inventory graph, service impact and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import stats
from ..plans import dashboard as D
from ..session import stored
from . import views as V
from .alarms import _TWICE, _with_echoes
from .core import ORACLES, query, table


@query("inv_dedupe", f"""WITH {V.NODES}, d AS (SELECT *, row_number() OVER (PARTITION BY level, id, key ORDER BY val) AS r FROM
  (SELECT * FROM inv_node UNION ALL SELECT level, id, key, 'zz' || val FROM inv_node)) SELECT level, id, key, val FROM d WHERE r = 1""")  # fmt: skip
def inv_dedupe(spark, sf):
    n = V.inv_node(spark, sf)
    return G.inv_dedupe(n.unionByName(n.withColumn("val", F.concat(F.lit("zz"), "val"))), ["level", "id", "key"], ["val"])


@query("inv_dedupe_endpoints", """SELECT CAST(l_suppkey AS VARCHAR) AS id1, CAST(l_partkey AS VARCHAR) AS id2, CAST(min(l_orderkey) AS VARCHAR) AS val FROM lineitem GROUP BY l_suppkey, l_partkey""")
def inv_dedupe_endpoints(spark, sf):
    e = _supply_edges(spark, sf)
    return G.inv_dedupe(e, ["level1", "id1", "level2", "id2"], ["n"]).select("id1", "id2", "val")


def _supply_edges(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "'s' as level1", "string(l_suppkey) as id1", "'p' as level2", "string(l_partkey) as id2", "'order' as key",
        "string(l_orderkey) as val", "l_orderkey as n",
    )


@query("map_reverse", f"WITH {V.MAPS} SELECT level2 AS level1, id2 AS id1, level1 AS level2, id1 AS id2 FROM inv_map")
def map_reverse(spark, sf):
    return G.map_reverse(V.inv_map(spark, sf)).select("level1", "id1", "level2", "id2")


@query("first_attr_row", f"""WITH {V.NODES} SELECT level, id, key, val FROM (SELECT *, row_number() OVER (PARTITION BY level, id
  ORDER BY CASE WHEN key = 'segment' THEN 0 ELSE 1 END, key, val) AS r FROM inv_node) WHERE r = 1""")  # fmt: skip
def first_attr_row(spark, sf):
    return G.first_attr_row(V.inv_node(spark, sf), "segment")


def _order_edges(spark, sf):
    """Customer - order - priority day: a component per customer until days join them."""
    o = table(spark, sf, "orders")
    return o.selectExpr("'c' as level1", "string(o_custkey) as id1", "'ord' as level2", "string(o_orderkey) as id2")


@query("connected_components", """WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS o FROM orders), n AS (SELECT c, count(*) + 1 AS ndn FROM e GROUP BY c)
  SELECT 'ord' AS ndlevel, o AS ndid, 'c' AS cclevel, e.c AS ccid, ndn FROM e JOIN n ON e.c = n.c UNION ALL SELECT 'c', c, 'c', c, ndn FROM n""")  # fmt: skip
def connected_components(spark, sf):
    return G.connected_components(_order_edges(spark, sf))


@query("connected_components_one", """WITH s AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS i FROM lineitem), p AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS i FROM lineitem),
  n AS (SELECT 's' AS ndlevel, i AS ndid FROM s UNION ALL SELECT 'p', i FROM p) SELECT ndlevel, ndid, 'p' AS cclevel, (SELECT min(i) FROM p) AS ccid, (SELECT count(*) FROM n) AS ndn FROM n""")  # fmt: skip
def connected_components_one(spark, sf):
    return G.connected_components(_supply_edges(spark, sf))


@query("level_closure", f"""WITH RECURSIVE {V.MAPS}, d AS (SELECT DISTINCT level1 AS a, level2 AS b FROM inv_map),
  w(a, b, n) AS (SELECT a, b, 1 FROM d UNION ALL SELECT w.a, d.b, n + 1 FROM w JOIN d ON w.b = d.a WHERE n < 10)
  SELECT a AS id1, b AS id2, CAST(min(n) AS BIGINT) AS hops FROM w GROUP BY a, b""")  # fmt: skip
def level_closure(spark, sf):
    m = V.inv_map(spark, sf)
    lc = G.level_closure(m.select(F.col("level1").alias("id1"), F.col("level2").alias("id2")))
    return lc.groupBy("id1", "id2").agg(F.count("*").alias("hops"))


@query("map_closure", f"WITH {V.NODES}, {V.CLOSURE} SELECT level1, id1, level2, id2 FROM above")
def map_closure(spark, sf):
    return V.build_closure(spark, sf, identity=False)


@query("map_check", f"""WITH {V.NODES}, {V.MAPS}, a AS (SELECT DISTINCT level, id FROM inv_node), m AS (SELECT * FROM inv_map WHERE NOT (level1 = 'c' AND CAST(id1 AS BIGINT) % 5 = 0)
    UNION ALL SELECT level1, id1, level2, 'x' || id2 FROM inv_map WHERE level1 = 's' AND CAST(id1 AS BIGINT) % 3 = 0),
  need AS (SELECT level AS level1, id AS id1, CASE level WHEN 'c' THEN 'n' WHEN 's' THEN 'n' ELSE 'r' END AS level2 FROM a WHERE level IN ('c', 's', 'n')),
  k AS (SELECT need.level1, need.id1, need.level2, count(m.id2) AS n FROM need LEFT JOIN m USING (level1, id1, level2) GROUP BY ALL)
  SELECT *, CASE WHEN n = 0 THEN 'none' ELSE 'multiple' END AS problem FROM k WHERE n <> 1""")  # fmt: skip
def map_check(spark, sf):
    m = V.inv_map(spark, sf)
    holes = m.where("not (level1 = 'c' and bigint(id1) % 5 = 0)")
    twice = m.where("level1 = 's' and bigint(id1) % 3 = 0").withColumn("id2", F.concat(F.lit("x"), "id2"))
    return G.map_check(V.inv_node(spark, sf), holes.unionByName(twice), [("c", "n"), ("s", "n"), ("n", "r")])


COND = (G.NodeCondition("r", "[0-2]"), G.NodeCondition("n", "nation_1.*", by_name=True))
SELECTED = f"""{V.NODES}, {V.CLOSURE},
ok1 AS (SELECT DISTINCT level1, id1 FROM closure WHERE level2 = 'r' AND regexp_full_match(id2, '[0-2]')),
ok2 AS (SELECT DISTINCT c.level1, c.id1 FROM closure c JOIN inv_node n ON n.level = c.level2 AND n.id = c.id2 AND n.key = 'name' WHERE c.level2 = 'n' AND regexp_full_match(lower(n.val), 'nation_1.*')),
sel AS (SELECT * FROM ok1 INTERSECT SELECT * FROM ok2)"""


def _selected(spark, sf, out="n", attr=()):
    n = V.inv_node(spark, sf)
    # the inventory step of a query: its result is read by the steps after it
    return stored(G.select_nodes(n, V.closure(spark, sf), n, COND, out, attr), "selected")


@query("inv_select_nodes", f"""WITH {SELECTED}, seg AS (SELECT level AS level1, id AS id1 FROM inv_node WHERE key = 'segment' AND val IN ('BUILDING', 'MACHINERY'))
  SELECT c.level2 AS ilevel, c.id2 AS iid, c.level1 AS level, c.id1 AS id FROM closure c JOIN sel USING (level1, id1) JOIN seg USING (level1, id1) WHERE c.level2 = 'n'""")  # fmt: skip
def inv_select_nodes(spark, sf):
    return _selected(spark, sf, attr=[("segment", "BUILDING|MACHINERY")])


@query("inv_select_nodes_exact", f"""WITH {V.NODES} SELECT DISTINCT level AS ilevel, id AS iid, level, id FROM inv_node
  WHERE (level = 'r' AND regexp_full_match(id, '[0-2]')) OR (level = 'n' AND key = 'name' AND regexp_full_match(lower(val), 'nation_1.*'))""")  # fmt: skip
def inv_select_nodes_exact(spark, sf):
    n = V.inv_node(spark, sf)
    return G.select_nodes(n, V.closure(spark, sf), n, COND, "n", mode="exact")


def _trade_edges(spark, sf):
    """Customer - supplier edges through line items."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return (
        o.join(li, o["o_orderkey"] == li["l_orderkey"])
        .selectExpr("'c' as level1", "string(o_custkey) as id1", "'s' as level2", "string(l_suppkey) as id2", "'flag' as key", "l_returnflag as val")
        .distinct()
    )


TRADE = """trade AS (SELECT DISTINCT 'c' AS level1, CAST(o_custkey AS VARCHAR) AS id1, 's' AS level2, CAST(l_suppkey AS VARCHAR) AS id2, l_returnflag AS val
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


@query("inv_select_edges", f"""WITH {SELECTED}, {TRADE}, res AS (SELECT DISTINCT c.id2 FROM closure c JOIN sel USING (level1, id1) WHERE c.level2 = 'n'),
  e AS (SELECT DISTINCT level1, id1, level2, id2 FROM trade WHERE val = 'R'),
  j AS (SELECT e.*, p1.id2 AS u1, p2.id2 AS u2, r1.id2 IS NOT NULL AS in1, r2.id2 IS NOT NULL AS in2, s1.id2 AS v1, s2.id2 AS v2 FROM e
    JOIN closure p1 ON p1.level1 = e.level1 AND p1.id1 = e.id1 AND p1.level2 = 'n' JOIN closure p2 ON p2.level1 = e.level2 AND p2.id1 = e.id2 AND p2.level2 = 'n'
    JOIN closure s1 ON s1.level1 = e.level1 AND s1.id1 = e.id1 AND s1.level2 = 'r' JOIN closure s2 ON s2.level1 = e.level2 AND s2.id1 = e.id2 AND s2.level2 = 'r'
    LEFT JOIN res r1 ON r1.id2 = p1.id2 LEFT JOIN res r2 ON r2.id2 = p2.id2)
  SELECT level1, id1, level2, id2, CASE WHEN in1 THEN 'n' ELSE 'r' END AS ilevel1, CASE WHEN in1 THEN u1 ELSE v1 END AS iid1, CASE WHEN in2 THEN 'n' ELSE 'r' END AS ilevel2,
  CASE WHEN in2 THEN u2 ELSE v2 END AS iid2, CASE WHEN in1 THEN 1 ELSE 2 END AS iclass1, CASE WHEN in2 THEN 1 ELSE 2 END AS iclass2 FROM j WHERE in1 OR in2""")  # fmt: skip
def inv_select_edges(spark, sf):
    return G.select_edges(
        _trade_edges(spark, sf), V.closure(spark, sf), _selected(spark, sf), "n", "r", V.inv_node(spark, sf), [("flag", "R")]
    )


@query("propagate_filter", f"WITH {SELECTED}, {V.ALARMS} SELECT seq FROM alarm WHERE (level1, id1) IN (SELECT (level1, id1) FROM ok1)")
def propagate_filter(spark, sf):
    return G.propagate_filter(V.alarm(spark, sf), V.closure(spark, sf), COND[:1]).select("seq")


@query("topological_sort", f"""WITH {V.MAPS}, n AS (SELECT id1 AS i, level1 AS l FROM inv_map UNION SELECT id2, level2 FROM inv_map),
  h AS (SELECT l, i, CASE l WHEN 'o' THEN 0 WHEN 's' THEN 0 WHEN 'c' THEN CASE WHEN i IN (SELECT id2 FROM inv_map WHERE level1 = 'o') THEN 1 ELSE 0 END END AS k FROM n),
  nn AS (SELECT m.id2 AS i, max(h.k) + 1 AS k FROM inv_map m JOIN h ON h.l = m.level1 AND h.i = m.id1 WHERE m.level2 = 'n' GROUP BY m.id2),
  rr AS (SELECT m.id2 AS i, max(coalesce(nn.k, 0)) + 1 AS k FROM inv_map m LEFT JOIN nn ON nn.i = m.id1 WHERE m.level1 = 'n' GROUP BY m.id2),
  f AS (SELECT l || ':' || h.i AS node, coalesce(h.k, CASE l WHEN 'n' THEN coalesce(nn.k, 0) END, rr.k) AS layer FROM h LEFT JOIN nn ON l = 'n' AND nn.i = h.i LEFT JOIN rr ON l = 'r' AND rr.i = h.i)
  SELECT node, CAST(layer AS INTEGER) AS layer, row_number() OVER (ORDER BY layer, node) AS position FROM f""")  # fmt: skip
def topological_sort(spark, sf):
    m = V.inv_map(spark, sf)
    pairs = m.select(F.concat_ws(":", "level1", "id1").alias("before"), F.concat_ws(":", "level2", "id2").alias("after"))
    return G.topological_sort(pairs)


def _service(spark, sf):
    """Orders carry a service per customer: open orders produce, others consume."""
    o = table(spark, sf, "orders")
    roles = o.selectExpr(
        "'ord' as level", "string(o_orderkey) as id", "concat('gce_service', 0) as key",
        "concat(if(o_orderstatus = 'O', 'prod:', 'cons:'), 'svc', o_custkey % 3) as val",
    )
    events = o.where("o_totalprice > 400000").selectExpr("'ord' as level", "string(o_orderkey) as id")
    return _order_edges(spark, sf), G.service_roles(roles), events


_SVC = """o AS (SELECT *, o_totalprice > 400000 AS down, o_orderstatus = 'O' AS prod FROM orders),
  c AS (SELECT o_custkey, count(*) FILTER (prod) AS producers, count(*) FILTER (NOT prod) AS consumers, count(*) FILTER (NOT prod AND NOT down) AS alive,
    count(*) FILTER (prod AND NOT down) AS pup FROM o GROUP BY ALL HAVING count(*) FILTER (prod) > 0 AND count(*) FILTER (NOT prod) > 0),
  i AS (SELECT *, CASE WHEN alive = 0 THEN producers ELSE producers - pup END AS lost_all, CASE WHEN alive > 0 AND alive < consumers THEN pup ELSE 0 END AS lost_some FROM c)"""


@query("service_impact", f"""WITH {_SVC}, x AS (SELECT *, 100.0::DOUBLE * (producers - lost_all) / producers AS remaining FROM i WHERE lost_all > 0 OR lost_some > 0)
  SELECT 'c' AS cclevel, CAST(o_custkey AS VARCHAR) AS ccid, 'svc' || o_custkey % 3 AS service, producers, lost_all, lost_some, round(remaining, 6) AS remaining,
  CASE WHEN remaining <= 0 THEN 1 WHEN remaining <= 25 THEN 2 WHEN remaining <= 50 THEN 3 ELSE 4 END AS severity FROM x""")  # fmt: skip
def service_impact(spark, sf):
    edges, roles, events = _service(spark, sf)
    return G.service_impact(edges, roles, events).withColumn("remaining", F.round("remaining", 6))


# --- dashboard queries -----------------------------------------------------------------------

_ANC = "JOIN closure u ON u.level1 = s.level AND u.id1 = s.id AND u.level2 = 'n'"


@query("query_stats", f"""WITH {SELECTED}, {V.FRAMED}, res AS (SELECT DISTINCT c.id2 FROM closure c JOIN sel USING (level1, id1) WHERE c.level2 = 'n'),
  q AS (SELECT s.*, u.id2 AS iid, {V.GROUP_SQL} AS mode FROM framed s {_ANC} WHERE (s.level, s.id) IN (SELECT (level1, id1) FROM sel) AND u.id2 IN (SELECT id2 FROM res)
    AND regexp_full_match(key, 'click|purchase|view') AND frame BETWEEN 24 AND 240 AND (s.timeissued BETWEEN 1704067200 AND 1704800000 OR s.timeissued BETWEEN 1705000000 AND 1706000000))
  SELECT 'curr' AS series, 'n' AS level, iid AS id, key, frame, min(timeissued) AS timeissued, round(CASE mode WHEN 'sum' THEN sum(val) WHEN 'max' THEN max(val) ELSE avg(val) END, 6) AS val
  FROM q GROUP BY iid, key, frame, mode""")  # fmt: skip
def query_stats(spark, sf):
    out = D.query_stats(
        V.framed(spark, sf), V.closure(spark, sf), "n", selected=_selected(spark, sf), params=[("key", "click|purchase|view")],
        levels="o", frames=(24, 240), times=[(1704067200, 1704800000), (1705000000, 1706000000)], group=V.CATALOGUE,
    )
    return out.withColumn("val", F.round("val", 6))


@query("query_stats_asset_keys", f"""WITH {V.NODES}, {V.CLOSURE}, {V.FRAMED}, {V.ALARMS}, k AS (SELECT DISTINCT id1, CASE CAST(id1 AS BIGINT) % 2 WHEN 0 THEN 'click' ELSE 'view' END AS key FROM alarm WHERE severity = 1)
  SELECT s.seq, u.id2 AS iid FROM framed s JOIN closure u ON u.level1 = s.level AND u.id1 = s.id AND u.level2 = 'r' JOIN k ON k.id1 = s.id AND k.key = s.key""")  # fmt: skip
def query_stats_asset_keys(spark, sf):
    keys = V.alarm(spark, sf).where("severity = 1").selectExpr("level1 as level", "id1 as id", "if(bigint(id1) % 2 = 0, 'click', 'view') as key")
    return D.query_stats(V.framed(spark, sf), V.closure(spark, sf), "r", asset_keys=keys).select("seq", "iid")


_LATER = "timeissued BETWEEN 1704900000 AND 1706000000"


@query("query_stats_profile", f"""WITH {V.NODES}, {V.CLOSURE}, {V.FRAMED}, q AS (SELECT level, id, key, CAST(frame // 72 AS INTEGER) AS frame, val, timeissued FROM framed),
  m AS (SELECT level, id, key, frame, avg(val) AS a, coalesce(stddev_samp(val), 0) AS d FROM q GROUP BY ALL), c AS (SELECT * FROM q WHERE {_LATER}),
  ft AS (SELECT frame, min(timeissued) AS t FROM c GROUP BY frame), mt AS (SELECT m.*, coalesce(t, (SELECT min(timeissued) FROM c)) AS t FROM m LEFT JOIN ft USING (frame)),
  s AS (SELECT level, id, key, frame, val, '' AS label, timeissued FROM c UNION ALL SELECT level, id, key, frame, a, '___mean___', t FROM mt UNION ALL SELECT level, id, key, frame, d, '___sdev___', t FROM mt)
  SELECT s.id, s.key, s.frame, s.label, s.timeissued, round(s.val, 6) AS val, u.id2 AS iid FROM s {_ANC}""")  # fmt: skip
def query_stats_profile(spark, sf):
    s = V.framed(spark, sf).withColumn("frame", F.expr("int(frame div 72)"))
    prof = s.groupBy(*stats.SERIES, "frame").agg(F.avg("val").alias("m"), F.coalesce(F.stddev_samp("val"), F.lit(0.0)).alias("d"))
    long = prof.selectExpr("level", "id", "key", "frame", "stack(2, '___mean___', m, '___sdev___', d) as (label, val)")
    out = D.query_stats_profile(s, long, times=[(1704900000, 1706000000)], closure=V.closure(spark, sf), out_level="n")
    return out.select("id", "key", "frame", "label", "timeissued", F.round("val", 6).alias("val"), "iid")


_AQ = "(severity = 1 OR severity = 2) AND tmode IN (1, 2) AND regexp_full_match(text, 'disk_[0-4].*') AND timeissued BETWEEN 1704067200 AND 1706000000"


def _alarm_params():
    return {"params": [("severity", "critical|MAJOR"), ("ticket", "keep|defer"), ("text", "disk_[0-4].*")], "times": [(1704067200, 1706000000)]}


# echoes are looked for among the alarms that fit
_FIT_ECHO = V.ECHO.replace(
    V.ALARMS, V.ALARMS.replace("alarm AS (", "alarm0 AS (", 1) + f",\nalarm AS (SELECT * FROM alarm0 WHERE {_AQ} AND level1 = 'o')"
)


@query("query_alarms", f"""WITH {SELECTED}, {_FIT_ECHO}, res AS (SELECT DISTINCT c.id2 FROM closure c JOIN sel USING (level1, id1) WHERE c.level2 = 'n'),
  a AS (SELECT * FROM alarm WHERE (seq IS NULL OR seq NOT IN (SELECT seq FROM echo)) AND (level1, id1) IN (SELECT (level1, id1) FROM sel)),
  p AS (SELECT level1, id1, level2, id2 FROM closure WHERE level2 IN ('n', 'r')),
  j AS (SELECT a.seq, a.id2, u1.id2 AS p1, u2.id2 AS p2, v1.id2 AS s1, v2.id2 AS s2, u1.id2 IN (SELECT id2 FROM res) AS in1, u2.id2 IN (SELECT id2 FROM res) AS in2 FROM a
    JOIN p u1 ON u1.level1 = a.level1 AND u1.id1 = a.id1 AND u1.level2 = 'n' LEFT JOIN p v1 ON v1.level1 = a.level1 AND v1.id1 = a.id1 AND v1.level2 = 'r'
    LEFT JOIN p u2 ON u2.level1 = a.level2 AND u2.id1 = a.id2 AND u2.level2 = 'n' LEFT JOIN p v2 ON v2.level1 = a.level2 AND v2.id1 = a.id2 AND v2.level2 = 'r')
  SELECT DISTINCT seq, CASE WHEN in1 THEN 'n' ELSE 'r' END AS ilevel1, CASE WHEN in1 THEN p1 ELSE s1 END AS iid1, CASE WHEN in1 THEN 1 ELSE 2 END AS iclass1,
  CASE WHEN id2 = '' THEN NULL WHEN in2 THEN p2 ELSE s2 END AS iid2, CASE WHEN id2 = '' THEN 0 WHEN in2 THEN 1 ELSE 2 END AS iclass2 FROM j WHERE id2 = '' OR (p2 IS NOT NULL AND (in1 OR in2))""")  # fmt: skip
def query_alarms(spark, sf):
    """Alarms of the selected assets that fit, without the echoes of correlated ones."""
    out = D.query_alarms(
        V.alarm(spark, sf), V.closure(spark, sf), "n", secondary_level="r", selected=_selected(spark, sf), levels="o",
        order="seq", **_alarm_params(),
    )
    return out.select("seq", "ilevel1", "iid1", "iclass1", "iid2", "iclass2")


@query("query_alarms_by_asset", f"""WITH {V.NODES}, {V.CLOSURE}, {V.ALARMS} SELECT a.seq, u.id2 AS iid1, w.id2 AS iid2 FROM alarm a JOIN closure u ON u.level1 = a.level1 AND u.id1 = a.id1 AND u.level2 = 'n'
  LEFT JOIN closure w ON w.level1 = a.level2 AND w.id1 = a.id2 AND w.level2 = 'n' WHERE {_AQ} AND (a.id2 = '' OR w.id2 IS NOT NULL)
  AND a.id1 IN (SELECT id FROM inv_node WHERE level = 'o' AND key = 'scope_systype' AND val = 'st1')""")  # fmt: skip
def query_alarms_by_asset(spark, sf):
    assets = V.inv_node(spark, sf).where("key = 'scope_systype' and val = 'st1'")
    out = D.query_alarms_by_asset(assets, V.alarm(spark, sf), V.closure(spark, sf), "n", **_alarm_params())
    return out.select("seq", "iid1", "iid2")


@query("query_alarms_ccid", f"""WITH {V.NODES}, {V.CLOSURE}, {V.ECHO} SELECT a.seq, u.id2 AS iid1 FROM deduped a JOIN closure u ON u.level1 = a.level1 AND u.id1 = a.id1 AND u.level2 = 'n'
  LEFT JOIN closure w ON w.level1 = a.level2 AND w.id1 = a.id2 AND w.level2 = 'n' WHERE a.id2 = '' OR w.id2 IS NOT NULL""")  # fmt: skip
def query_alarms_ccid(spark, sf):
    """Alarms of the ccids cc1, cc10 to cc19, whole names, without the echoes of correlated ones."""
    a = _with_echoes(spark, sf)
    return D.query_alarms(a, V.closure(spark, sf), "n", params=[("ccid", "cc1[0-9]?")], order="seq").select("seq", "iid1")


ORACLES["query_alarms_ccid"] = ORACLES["query_alarms_ccid"].replace(
    V.ALARMS, V.ALARMS.replace("alarm AS (", "alarm0 AS (", 1) + ",\n" + _TWICE.replace("alarm AS (", "alarm1 AS (", 1)
    + ",\nalarm AS (SELECT * FROM alarm1 WHERE regexp_full_match(ccid, 'cc1[0-9]?'))"
)


@query("query_unknown_alarms", f"WITH {V.ALARMS} SELECT seq, 'UNKNOWN' AS iid FROM alarm WHERE id1 NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) AND CAST(id1 AS BIGINT) % 4 <> 0")
def query_unknown_alarms(spark, sf):
    """A quarter of the objects are service updates here."""
    a = V.alarm(spark, sf).withColumn("id1", F.expr("if(bigint(id1) % 4 = 0, '__ce_svc_upd__', id1)"))
    inv = table(spark, sf, "supplier").selectExpr("'o' as level", "string(s_suppkey) as id")
    return D.query_unknown_alarms(a, inv).select("seq", "iid")


@query("query_unknown", f"WITH {V.STAT} SELECT seq, 'UNKNOWN' AS iid FROM stat WHERE CAST(id AS BIGINT) NOT IN (SELECT s_suppkey FROM supplier)")
def query_unknown(spark, sf):
    inv = table(spark, sf, "supplier").selectExpr("'o' as level", "string(s_suppkey) as id")
    return D.query_unknown(V.stat(spark, sf), inv).select("seq", "iid")


@query("query_inventory", f"""WITH {SELECTED}, {TRADE}, r AS (SELECT c.id2 AS iid, c.level1 AS level, c.id1 AS id FROM closure c JOIN sel USING (level1, id1) WHERE c.level2 = 'n'),
  e AS (SELECT level1, id1, count(*) AS n FROM (SELECT DISTINCT level1, id1, level2, id2 FROM trade) GROUP BY ALL UNION ALL
    SELECT level2, id2, count(*) FROM (SELECT DISTINCT level1, id1, level2, id2 FROM trade) GROUP BY ALL)
  SELECT iid, r.level, r.id, max(val) FILTER (key = 'name') AS name, max(val) FILTER (key = 'segment') AS segment, coalesce(any_value(e.n), 0) AS edges FROM r
  LEFT JOIN inv_node n ON n.level = r.level AND n.id = r.id LEFT JOIN e ON e.level1 = r.level AND e.id1 = r.id GROUP BY iid, r.level, r.id""")  # fmt: skip
def query_inventory(spark, sf):
    edges = _trade_edges(spark, sf).select("level1", "id1", "level2", "id2").distinct()
    out = D.query_inventory(_selected(spark, sf), edges, V.inv_node(spark, sf), ["name", "segment", "balance"], hide=["balance"])
    return out.drop("ilevel")


@query("alarm_table", f"""WITH {V.ALARMS}, g AS (SELECT id1, alarmid, count(*) AS groupcount, arg_max((seq, severity, timeissued), (timeissued, seq)) AS x FROM alarm GROUP BY ALL)
  SELECT id1, alarmid, groupcount, x[1] AS seq, x[2] AS severity, x[3] AS timeissued FROM (SELECT id1, alarmid, groupcount, [x[1], x[2], x[3]] AS x FROM g)""")  # fmt: skip
def alarm_table(spark, sf):
    out = D.alarm_table(V.alarm(spark, sf), ["id1", "alarmid"], "seq")
    return out.select("id1", "alarmid", "groupcount", "seq", F.col("severity").cast("bigint").alias("severity"), "timeissued")


@query("stat_table", f"""WITH {V.FRAMED} SELECT level, id, key, {", ".join(f"round(avg(val) FILTER (frame // 72 = {i}), 6) AS f{i}" for i in range(4))} FROM framed GROUP BY ALL""")
def stat_table(spark, sf):
    s = V.framed(spark, sf).withColumn("frame", F.expr("int(frame div 72)"))
    out = D.stat_table(s, range(4))
    return out.select("level", "id", "key", *[F.round(f"f{i}", 6).alias(f"f{i}") for i in range(4)])


MAIL = (
    {"account": "ops", "address": "ops@example.com", "severity": "critical|major"},
    {"account": "disk", "address": "disk@example.com", "text": "disk_[0-2] .*", "ticket": "keep"},
)


@query("rule_email_match", f"""WITH {V.ALARMS}, s AS (SELECT DISTINCT id1, CASE WHEN CAST(id1 AS BIGINT) % 2 = 0 THEN 'ops' ELSE 'disk' END AS account FROM alarm)
  SELECT seq, account, account || '@example.com' AS address FROM alarm JOIN s USING (id1) WHERE (account = 'ops' AND severity <= 2) OR (account = 'disk' AND regexp_full_match(text, 'disk_[0-2] .*') AND tmode = 1)""")  # fmt: skip
def rule_email_match(spark, sf):
    a = V.alarm(spark, sf)
    see = a.selectExpr("if(bigint(id1) % 2 = 0, 'ops', 'disk') as account", "level1 as level", "id1 as id")
    return D.rule_email_match(a, MAIL, see).select("seq", "account", "address")
