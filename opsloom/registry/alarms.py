"""Queries for alarm events, volumes and batch correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alarms as A
from . import views as V
from .core import query


@query("ticket_echo_dedupe", f"WITH {V.ECHO} SELECT seq, CASE WHEN ccid <> '' AND sortorder = 2 THEN 1 ELSE sortorder END AS sortorder FROM deduped")
def ticket_echo_dedupe(spark, sf):
    return A.ticket_echo_dedupe(_with_echoes(spark, sf), "seq").select("seq", "sortorder")


_TWICE = """alarm AS (SELECT * FROM alarm0 UNION ALL SELECT * REPLACE (seq + 100000000 AS seq, 1 AS sortorder) FROM alarm0 WHERE sortorder = 2
  UNION ALL SELECT * REPLACE (seq + 200000000 AS seq, 1 AS sortorder) FROM alarm0 WHERE sortorder = 2)"""


def _with_echoes(spark, sf):
    """Every override record is followed by two normal copies of itself."""
    a = V.alarm(spark, sf)
    o = a.where("sortorder = 2").withColumn("sortorder", F.lit(1))
    return a.unionByName(o.withColumn("seq", F.expr("seq + 100000000"))).unionByName(o.withColumn("seq", F.expr("seq + 200000000")))


from .core import ORACLES  # noqa: E402

ORACLES["ticket_echo_dedupe"] = ORACLES["ticket_echo_dedupe"].replace(
    V.ALARMS, V.ALARMS.replace("alarm AS (", "alarm0 AS (", 1) + ",\n" + _TWICE
)

CLEARS = V.ALARMS + """,
clears AS (SELECT *, CASE WHEN ccid <> '' THEN 'c' WHEN alarmid <> '' THEN 'i' WHEN timecleared > 0 THEN 'a' ELSE 'o' END AS kind,
  CASE WHEN ccid <> '' THEN ccid ELSE id1 END AS a, CASE WHEN ccid <> '' THEN '' WHEN alarmid <> '' THEN alarmid WHEN timecleared > 0
  THEN CAST(timecleared AS VARCHAR) ELSE '' END AS b, CASE WHEN timecleared > 0 THEN timecleared ELSE timeissued END AS tc FROM alarm WHERE type = 2),
ck AS (SELECT kind, a, b, max(timeissued) AS at, arg_max(tc, (timeissued, tc)) AS tc FROM clears GROUP BY ALL),
up AS (SELECT x.*, coalesce(CASE WHEN c.at >= x.timeissued THEN c.tc END, CASE WHEN i.at >= x.timeissued THEN i.tc END,
  CASE WHEN t.at >= x.timeissued THEN t.tc END, CASE WHEN o.at >= x.timeissued THEN o.tc END) AS cleared_at
  FROM alarm x LEFT JOIN ck c ON c.kind = 'c' AND c.a = x.ccid LEFT JOIN ck i ON i.kind = 'i' AND i.a = x.id1 AND i.b = x.alarmid
  LEFT JOIN ck t ON t.kind = 'a' AND t.a = x.id1 AND t.b = CAST(x.timeissued AS VARCHAR) LEFT JOIN ck o ON o.kind = 'o' AND o.a = x.id1 WHERE x.type = 1)"""


@query("st_clear", f"WITH {CLEARS} SELECT seq, cleared_at FROM up")
def st_clear(spark, sf):
    a = V.alarm(spark, sf)
    return A.match_clears(a.where("type = 1"), a.where("type = 2")).select("seq", "cleared_at")


@query("open_alarms", f"""WITH {CLEARS}, {V.ECHO[len(V.ALARMS) + 2:]} SELECT seq, id1, timeissued FROM up WHERE cleared_at IS NULL
  AND timeissued >= (SELECT max(timeissued) FROM alarm) - 864000 AND seq IN (SELECT seq FROM deduped)""")  # fmt: skip
def open_alarms(spark, sf):
    return A.open_alarms(V.alarm(spark, sf), 864000, "seq").select("seq", "id1", "timeissued")


for _per, _step in (("frame", 1), ("hour", 12), ("day", 288)):

    def _volume(spark, sf, per=_per):
        a = V.alarm(spark, sf).withColumn("iclass1", F.expr("if(id2 = '', 1, 2)"))
        return A.alarm_volume(a, 300, per).select("level", "id", "frame", "val", "timeissued", "key")

    query(
        "alarm_volume" if _per == "frame" else f"alarm_volume_{_per}",
        f"""WITH {V.ALARMS}, x AS (SELECT *, timeissued + 150 AS t FROM alarm WHERE id2 = ''), b AS (SELECT min(t - t % 300) AS b FROM x)
  SELECT level1 AS level, id1 AS id, CAST((t - b) // {300 * _step} AS INTEGER) AS frame, CAST(count(*) AS DOUBLE) AS val, min(t - t % 300) AS timeissued,
  'alarm_volume._total' AS key FROM x, b GROUP BY ALL""",
    )(_volume)


@query("alarm_counts_by_severity", f"""WITH {V.ALARMS}, x AS (SELECT id1, tmode, CASE WHEN type = 2 THEN 5 ELSE severity END AS s FROM alarm)
  SELECT id1, tmode, {", ".join(f"count(*) FILTER (s = {i}) AS sev{i}" for i in range(1, 6))} FROM x GROUP BY ALL""")  # fmt: skip
def alarm_counts_by_severity(spark, sf):
    return A.counts_by_severity(V.alarm(spark, sf), ["id1"])


@query("alarm_grid", f"""WITH {V.ALARMS} SELECT r AS row, {", ".join(f'nullif(count(*) FILTER (c = {i}), 0) AS "{i}_n", min(severity) FILTER (c = {i}) AS "{i}_worst"' for i in range(5))}
  FROM (SELECT *, CAST(id1 AS BIGINT) % 10 AS r, CAST(id1 AS BIGINT) % 5 AS c FROM alarm) GROUP BY r""")  # fmt: skip
def alarm_grid(spark, sf):
    a = V.alarm(spark, sf).selectExpr("bigint(id1) % 10 as row", "bigint(id1) % 5 as col", "severity")
    return A.alarm_grid(a, "row", "col", list(range(5)))


@query("alarmed_stat_keys", f"WITH {V.ALARMS} SELECT DISTINCT level1 AS level, id1 AS id, alarmid AS key FROM alarm WHERE contains(alarmid, '_') AND contains(alarmid, '.')")
def alarmed_stat_keys(spark, sf):
    return A.alarmed_stat_keys(V.alarm(spark, sf))


@query("essential_stats", f"""WITH {V.NODES}, o AS (SELECT DISTINCT id FROM inv_node WHERE level = 'o') SELECT 'o' AS level, id, n, stat FROM (
  SELECT id, 0 AS n, 'cpu' AS stat FROM o WHERE CAST(id AS BIGINT) % 4 < 2 UNION ALL SELECT id, 1, 'mem' FROM o WHERE CAST(id AS BIGINT) % 4 = 1
  UNION ALL SELECT id, -1, 'key' || CAST(id AS BIGINT) % 2 || CAST(id AS BIGINT) % 3 || '.*' FROM o WHERE CAST(id AS BIGINT) % 4 >= 2)""")  # fmt: skip
def essential_stats(spark, sf):
    nodes = V.inv_node(spark, sf)
    assets = nodes.where("level = 'o'").select("level", "id").distinct()
    extra = assets.select(
        "level", "id",
        F.explode(F.expr("case bigint(id) % 4 when 0 then map('essentialstat0', 'cpu', 'essentialstat2', 'gone') when 1 then "
                         "map('essentialstat0', 'cpu', 'essentialstat1', 'mem') when 2 then map('essentialstat1', 'gone') else map('none', '') end")).alias("key", "val"),
    )
    sl = nodes.where("key = 'scope_servicelevel'").selectExpr("level", "id", "val as servicelevel")
    st = nodes.where("key = 'scope_systype'").selectExpr("level", "id", "val as systype")
    defaults = sl.join(st, ["level", "id"]).selectExpr(
        "servicelevel", "systype", "'key' || substr(servicelevel, 3) || substr(systype, 3) as key", "true as regex"
    ).distinct()
    return A.essential_stats(assets, nodes.unionByName(extra), defaults)


# --- batch correlation -------------------------------------------------------------------

_GAP = 86400


def sessions_sql(keys: str, gap: int, src: str = "alarm") -> str:
    return f"""s0 AS (SELECT *, lag(timeissued) OVER (PARTITION BY {keys} ORDER BY timeissued, seq) AS p FROM {src}),
 s1 AS (SELECT *, sum(CASE WHEN p IS NULL OR timeissued - p > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY timeissued, seq) AS session FROM s0),
 s2 AS (SELECT *, row_number() OVER (PARTITION BY {keys}, session ORDER BY timeissued, seq) AS nth FROM s1)"""


@query("sessions", f"WITH {V.ALARMS}, {sessions_sql('id1', _GAP)} SELECT seq, CAST(session AS BIGINT) AS session, nth FROM s2")
def sessions(spark, sf):
    return A.sessions(V.alarm(spark, sf), ["id1"], _GAP, "seq").select("seq", "session", "nth")


def _repeat_sql(gap: int, k: int, delay: int, refresh: int) -> str:
    return f"""WITH {V.ALARMS}, e AS (SELECT * FROM alarm WHERE type = 1), clk AS (SELECT max(timeissued) AS c FROM e), {sessions_sql('id1', gap, 'e')},
  g AS (SELECT id1, session, count(*) AS n, min(timeissued) AS first, max(timeissued) AS last, min(timeissued) FILTER (nth = {k}) AS nt FROM s2 GROUP BY ALL),
  t AS (SELECT *, least(nt, CASE WHEN first + {delay} < c THEN first + {delay} END) AS ticket, c FROM g, clk)
  SELECT id1, CAST(session AS BIGINT) AS session, n, first, last, ticket, CAST(coalesce(greatest(floor((least(last + {gap}, c) - ticket) / {refresh}), 0), 0) AS BIGINT) AS refreshes FROM t"""


@query("st_corr_repeat", _repeat_sql(_GAP, 2, 30000, 7200))
def st_corr_repeat(spark, sf):
    return A.repeat_groups(V.alarm(spark, sf).where("type = 1"), ["id1"], _GAP, 2, 30000, 7200)


@query("st_corr_balance", f"""WITH {V.ALARMS}, {sessions_sql('id1', _GAP)}, c AS (SELECT *, CASE WHEN state = 3 THEN 1 ELSE -1 END AS st,
  sum(CASE WHEN state = 3 THEN 1 ELSE -1 END) OVER (PARTITION BY id1, session ORDER BY timeissued, seq) AS counter FROM s2),
  d AS (SELECT *, max(nth) OVER (PARTITION BY id1, session) AS top, CASE WHEN nth > 1 THEN p END AS before FROM c), clk AS (SELECT max(timeissued) AS c FROM alarm)
  SELECT id1, CAST(session AS BIGINT) AS session, count(*) AS n, CAST(max(counter) AS BIGINT) AS peak, least(min(timeissued) FILTER (counter >= 3),
   min(before + 20000) FILTER (timeissued - before > 20000 AND counter - st >= 2), min(timeissued + 20000) FILTER (nth = top AND counter >= 2 AND timeissued + 20000 < c)) AS ticket,
  min(timeissued) AS first, max(timeissued) AS last FROM d, clk GROUP BY id1, session""")  # fmt: skip
def st_corr_balance(spark, sf):
    return A.balance_groups(V.alarm(spark, sf), ["id1"], _GAP, 3, defer_count=2, defer_time=20000)


@query("st_updown_timeout", f"""WITH {V.ALARMS}, u AS (SELECT a.seq, a.timeissued, (SELECT min(b.timeissued) FROM alarm b WHERE b.state = 4 AND b.id1 = a.id1
  AND (b.timeissued > a.timeissued OR (b.timeissued = a.timeissued AND b.seq > a.seq))) AS nx FROM alarm a WHERE a.state = 3)
  SELECT seq, timeissued + 86400 AS ticket FROM u WHERE (nx IS NULL OR nx > timeissued + 86400) AND timeissued + 86400 < (SELECT max(timeissued) FROM alarm)""")  # fmt: skip
def st_updown_timeout(spark, sf):
    return A.updown_timeout(V.alarm(spark, sf), ["id1"]).select("seq", "ticket")


@query("st_ticket_pick", f"""WITH {V.ALARMS} SELECT id1, seq, severity, timeissued FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY severity, timeissued DESC, seq) AS r FROM alarm) WHERE r = 1""")
def st_ticket_pick(spark, sf):
    return A.ticket_pick(V.alarm(spark, sf), ["id1"], "seq").select("id1", "seq", "severity", "timeissued")


@query("st_defer_flag", f"""WITH {V.ALARMS}, {sessions_sql('id1', _GAP)}, m AS (SELECT seq FROM s2 WHERE nth > 1)
  SELECT seq, CASE WHEN tmode = 1 AND seq IN (SELECT seq FROM m) THEN 2 ELSE tmode END AS tmode FROM alarm""")  # fmt: skip
def st_defer_flag(spark, sf):
    a = V.alarm(spark, sf)
    members = A.sessions(a, ["id1"], _GAP, "seq").where("nth > 1").select("seq")
    return A.defer_flag(a, members, "seq").select("seq", "tmode")


@query("st_save_filter", f"WITH {V.ALARMS} SELECT seq FROM alarm WHERE smode = 1")
def st_save_filter(spark, sf):
    return A.save_filter(V.alarm(spark, sf)).select("seq")


