"""Queries for metric series: frames, roll-ups, profiles, deviation alarms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import profile_alarms, stats
from ..plans import dashboard
from . import views as V
from .core import query


@query("frame_assign", f"WITH {V.FRAMED} SELECT seq, timeissued, frame, dateissued, hourissued FROM framed")
def frame_assign(spark, sf):
    return V.framed(spark, sf).select("seq", "timeissued", "frame", "dateissued", "hourissued")


@query("frame_assign_clamped", f"""WITH {V.STAT}, c AS (SELECT seq, least(greatest(timeissued, 1704500000), 1706000000) + 150 + 3600 AS t FROM stat)
  SELECT seq, t - t % 300 - 3600 AS timeissued, CAST((t % 86400) // 300 AS INTEGER) AS frame FROM c""")  # fmt: skip
def frame_assign_clamped(spark, sf):
    out = stats.frame_assign(V.stat(spark, sf), V.INTERVAL, zone_offset=3600, limits=(1704500000, 1706000000))
    return out.select("seq", "timeissued", "frame")


@query("st_clamp_late", f"WITH {V.STAT} SELECT seq, least(greatest(timeissued, 1706000000 - 1000000), 1706000000 + 86400) AS timeissued FROM stat")
def st_clamp_late(spark, sf):
    return stats.clamp_time(V.stat(spark, sf), 1706000000, 1000000, 86400).select("seq", "timeissued")


@query("label_assign", f"""WITH {V.STAT} SELECT seq, CASE seq % 4 WHEN 0 THEN name || 's (All)' WHEN 1 THEN name || 's (sd' || (seq % 3) || ')'
  WHEN 2 THEN name || 's (x' || id || ')' ELSE 'none.' || key END AS label FROM (SELECT *, upper(key[1]) || key[2:] AS name FROM stat)""")  # fmt: skip
def label_assign(spark, sf):
    s = V.stat(spark, sf)
    s = s.withColumns(
        {
            "label": F.expr("if(seq % 4 = 2, '+x' || id, '')"),
            "key": F.expr("case seq % 4 when 1 then key || '.sd' || (seq % 3) when 3 then 'none.' || key when 0 then if(seq % 8 = 0, key, key || '._total') else key end"),
        }
    )
    return stats.label_assign(s, V.CATALOGUE).select("seq", "label")


@query("latest_distinct_metrics", f"WITH {V.STAT} SELECT level, id, key, unit, '' AS label, max(timeissued) AS timeissued FROM stat GROUP BY ALL")
def latest_distinct_metrics(spark, sf):
    s = V.stat(spark, sf)
    return stats.latest_distinct_metrics(s.where("timeissued < 1705000000"), s)


@query("hour_merge", f"""WITH {V.FRAMED}, r AS (SELECT *, row_number() OVER (PARTITION BY level, id, key, dateissued, frame
  ORDER BY CASE WHEN seq % 2 = 1 THEN 1 ELSE 0 END DESC, timeissued DESC, val DESC) AS r FROM framed) SELECT id, key, dateissued, frame, val FROM r WHERE r = 1""")  # fmt: skip
def hour_merge(spark, sf):
    f = V.framed(spark, sf)
    cols = ["level", "id", "key", "unit", "dateissued", "hourissued", "frame", "timeissued", "val"]
    out = stats.hour_merge(f.where("seq % 2 = 0").select(*cols), f.where("seq % 2 = 1").select(*cols), unique=True)
    return out.select("id", "key", "dateissued", "frame", "val")


@query("late_reroute", f"""WITH {V.STAT} SELECT event_date, route, count(*) AS n FROM (SELECT CAST(make_timestamp(timeissued * 1000000) AS DATE) AS event_date, * FROM stat)
  CROSS JOIN LATERAL (SELECT CASE WHEN event_date = DATE '2024-01-25' THEN 'current' WHEN event_date >= DATE '2024-01-20' THEN 'forward'
  WHEN DATE '2024-01-25' - event_date <= 15 THEN 'reopen' ELSE 'reject' END AS route) GROUP BY ALL""")  # fmt: skip
def late_reroute(spark, sf):
    out = stats.late_reroute(V.stat(spark, sf), dt.date(2024, 1, 25), 15, dt.date(2024, 1, 20))
    return out.groupBy("event_date", "route").agg(F.count("*").alias("n"))


def _rollup_sql(frame: str, period: str) -> str:
    return f"""WITH {V.FRAMED}, x AS (SELECT *, make_timestamp(timeissued * 1000000) AS ts, {V.MODE_SQL} AS mode FROM framed),
  g AS (SELECT strftime(ts, '{period}') AS period, level, id, key, CAST({frame} AS INTEGER) AS f, mode, min(timeissued) AS timeissued,
    sum(val) AS s, min(val) AS lo, max(val) AS hi, avg(val) AS a FROM x GROUP BY ALL)
  SELECT period, level, id, key, f AS frame, timeissued, round(CASE mode WHEN 'sum' THEN s WHEN 'min' THEN lo WHEN 'max' THEN hi ELSE a END, 6) AS val FROM g"""


def _rollup(spark, sf, to):
    out = stats.rollup(V.framed(spark, sf), V.CATALOGUE, to)
    return out.select("period", "level", "id", "key", "frame", "timeissued", F.round("val", 6).alias("val"))


@query("stat_rollup_hour", _rollup_sql("24 * (day(ts) - 1) + hour(ts)", "%Y.%m"))
def stat_rollup_hour(spark, sf):
    return _rollup(spark, sf, "hour")


@query("stat_rollup_day", _rollup_sql("dayofyear(ts)", "%Y"))
def stat_rollup_day(spark, sf):
    return _rollup(spark, sf, "day")


@query("stat_rollup_label", f"""WITH {V.FRAMED}, x AS (SELECT *, 'l' || seq AS lab, make_timestamp(timeissued * 1000000) AS ts, {V.MODE_SQL} AS mode FROM framed)
  SELECT level, id, key, CAST(dayofyear(ts) AS INTEGER) AS frame, CASE mode WHEN 'min' THEN arg_min(lab, (val, lab))
  WHEN 'max' THEN arg_min(lab, (-val, lab)) ELSE arg_min(lab, (timeissued, lab)) END AS label FROM x GROUP BY level, id, key, dayofyear(ts), mode""")  # fmt: skip
def stat_rollup_label(spark, sf):
    f = V.framed(spark, sf).withColumn("label", F.expr("'l' || seq"))
    return stats.rollup(f, V.CATALOGUE, "day").select("level", "id", "key", "frame", "label")


PROFILE = f"""{V.FRAMED},
v AS (SELECT level, id, key, CAST(frame // 72 AS INTEGER) AS frame, list_sort(list(val)) AS vs FROM framed GROUP BY ALL),
p0 AS (SELECT *, len(vs) AS n, list_avg(vs) AS m, coalesce(list_stddev_samp(vs), 0) AS s,
  list_avg(vs[:-2]) AS mh, list_stddev_samp(vs[:-2]) AS sh, list_avg(vs[2:]) AS ml, list_stddev_samp(vs[2:]) AS sl FROM v),
profile AS (SELECT level, id, key, frame, CASE WHEN n > 2 AND s > 0 AND abs(vs[-1] - mh) > 6 * sh THEN mh
  WHEN n > 2 AND s > 0 AND abs(vs[1] - ml) > 6 * sl THEN ml ELSE m END AS mean, CASE WHEN n > 2 AND s > 0 AND abs(vs[-1] - mh) > 6 * sh THEN sh
  WHEN n > 2 AND s > 0 AND abs(vs[1] - ml) > 6 * sl THEN sl ELSE s END AS sdev FROM p0)"""


def _quarter(spark, sf):
    """Points with the day cut into four profile frames."""
    return V.framed(spark, sf).withColumn("frame", F.expr("int(frame div 72)"))


def _profile(spark, sf):
    return stats.stat_profile(_quarter(spark, sf), wide=True)


@query("stat_profile", f"""WITH {PROFILE} SELECT level, id, key, frame, unnest(['___mean___', '___sdev___']) AS label,
  unnest([round(mean, 9), round(sdev, 4)]) AS val FROM profile""")  # fmt: skip
def stat_profile(spark, sf):
    exact = F.when(F.col("label") == "___mean___", F.round("val", 9)).otherwise(F.round("val", 4))
    return stats.stat_profile(_quarter(spark, sf)).withColumn("val", exact)


@query("profile_sample_days", f"""WITH {V.FRAMED}, d AS (SELECT DISTINCT CAST(make_timestamp(timeissued * 1000000) AS DATE) AS d FROM framed),
  w AS (SELECT d FROM d WHERE d IN (DATE '2024-01-24', DATE '2024-01-17', DATE '2024-01-10', DATE '2024-01-03')),
  l AS (SELECT d FROM d WHERE d BETWEEN DATE '2024-01-27' AND DATE '2024-01-30'),
  use AS (SELECT d FROM w WHERE (SELECT count(*) FROM w) >= 2 UNION ALL SELECT d FROM l WHERE (SELECT count(*) FROM w) < 2)
  SELECT key, count(*) AS n FROM framed WHERE CAST(make_timestamp(timeissued * 1000000) AS DATE) IN (SELECT d FROM use) GROUP BY ALL""")  # fmt: skip
def profile_sample_days(spark, sf):
    f = V.framed(spark, sf).withColumn("d", F.to_date(F.timestamp_seconds("timeissued")))
    days = stats.profile_sample_days(dt.date(2024, 1, 31), f.select("d"))
    return f.join(days, "d", "left_semi").groupBy("key").agg(F.count("*").alias("n"))


SCORED = PROFILE + """,
scored AS (SELECT f.level, f.id, f.key, f.seq, f.timeissued, f.val, p.frame, p.mean, p.sdev, abs(CASE WHEN abs(sdev) > 1e-6 THEN (val - mean) / sdev
  WHEN abs(mean) > 1e-6 THEN 100.0 * (val - mean) / mean ELSE (0.001 + val) / 0.001 END) AS sigma, abs(val - mean) AS actual
  FROM framed f JOIN profile p ON f.level = p.level AND f.id = p.id AND f.key = p.key AND f.frame // 72 = p.frame)"""


@query("sigma_score", f"WITH {SCORED} SELECT seq, frame, round(sigma, 4) AS sigma, round(actual, 9) AS actual FROM scored")
def sigma_score(spark, sf):
    out = stats.sigma_score(_quarter(spark, sf), _profile(spark, sf))
    return out.select("seq", "frame", F.round("sigma", 4).alias("sigma"), F.round("actual", 9).alias("actual"))


SPEC = "VR:i:5:n:;SIGMA:i:1.5:n::1:1:2:1:21600;ACTUAL:e:30.1234567:i:90.7654321:2:2:3:2:86400;SIGMA:i:0.8:e:1.5:3:2:3:1:0;CLEAR:5:2:3"
RULE = stats.parse_rule(SPEC)

# one sample per (series, frame start), scored against the profile of its quarter day
SAMPLED = V.POINTS.replace("stat AS (", "stat AS (", 1) + """,
prof_src AS (SELECT level, id, key, frame // 72 AS q, avg(val) AS mean, coalesce(stddev_samp(val), 0) AS sdev FROM points GROUP BY ALL),
sc AS (SELECT p.level, p.id, p.key, p.timeissued, p.val, abs(CASE WHEN abs(sdev) > 1e-6 THEN (p.val - mean) / sdev
  WHEN abs(mean) > 1e-6 THEN 100.0 * (p.val - mean) / mean ELSE (0.001 + p.val) / 0.001 END) AS sigma, abs(p.val - mean) AS actual
  FROM points p JOIN prof_src s ON p.level = s.level AND p.id = s.id AND p.key = s.key AND p.frame // 72 = s.q),
matched AS (SELECT *, CASE WHEN val < 5 THEN -1 WHEN sigma >= 1.5 THEN 1 WHEN actual > 30.1234567 AND actual <= 90.7654321 THEN 2
  WHEN sigma >= 0.8 AND sigma < 1.5 THEN 3 ELSE -1 END AS sev, CASE WHEN val < 5 THEN -1 WHEN sigma >= 1.5 THEN 0
  WHEN actual > 30.1234567 AND actual <= 90.7654321 THEN 1 WHEN sigma >= 0.8 AND sigma < 1.5 THEN 2 ELSE -1 END AS range FROM sc)"""


def _matched(spark, sf):
    points = stats.sample_points(V.framed(spark, sf), V.CATALOGUE).withColumn("frame", F.expr("int(frame div 72)"))
    scored = stats.sigma_score(points, quarter_profile(points))
    return stats.range_rule_match(scored, RULE)


def quarter_profile(points):
    """Mean and deviation per series and quarter; a single point deviates by nothing."""
    sdev = F.coalesce(F.stddev_samp("val"), F.lit(0.0)).alias("sdev")
    return points.groupBy(*stats.SERIES, "frame").agg(F.avg("val").alias("mean"), sdev)


@query("range_rule_match", f"WITH {SAMPLED} SELECT level, id, key, timeissued, sev, range FROM matched")
def range_rule_match(spark, sf):
    return _matched(spark, sf).select("level", "id", "key", "timeissued", "sev", "range")


def _window(n: int) -> str:
    return f"OVER (PARTITION BY level, id, key ORDER BY timeissued ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("m_of_n_alarm", f"""WITH {SAMPLED} SELECT level, id, key, timeissued, {", ".join(
    f"sum(CAST({'sev = -1' if r.kind == 'CLEAR' else f'sev <> -1 AND sev <= {r.sev}'} AS INTEGER)) {_window(r.n)} >= {r.m} AS r{i}"
    for i, r in enumerate(RULE.ranges))} FROM matched""")  # fmt: skip
def m_of_n_alarm(spark, sf):
    return stats.m_of_n_alarm(_matched(spark, sf), RULE).select(
        "level", "id", "key", "timeissued", *[f"r{i}" for i in range(len(RULE.ranges))]
    )


def _steps_sql() -> str:
    """The m-of-n scan as a fold over each series' samples, once per range."""
    empty = "{'t': 0::BIGINT, 'sev': 0, 'win': []::BOOLEAN[], 'hits': []::BIGINT[]}"
    parts = []
    for i, r in enumerate(RULE.ranges):
        good = "x.sev = -1" if r.kind == "CLEAR" else f"(x.sev <> -1 AND x.sev <= {r.sev})"
        win = f"list_append(a.win, {good})[-{r.n}:]"
        hit = f"len(list_filter({win}, lambda b: b)) >= {r.m}"
        step = (
            f"{{'t': x.t, 'sev': x.sev, 'win': CASE WHEN {hit} THEN []::BOOLEAN[] ELSE {win} END, "
            f"'hits': CASE WHEN {hit} THEN list_append(a.hits, x.t) ELSE a.hits END}}"
        )
        parts.append(
            f"SELECT level, id, key, {i} AS range, {r.sev} AS severity, '{'clear' if r.kind == 'CLEAR' else 'alarm'}' AS kind, "
            f"unnest(list_reduce(list_prepend({empty}, xs), lambda a, x: {step}).hits) AS timeissued FROM l"
        )
    return f"""WITH {SAMPLED},
  l AS (SELECT level, id, key, list({{'t': timeissued, 'sev': sev, 'win': []::BOOLEAN[], 'hits': []::BIGINT[]}} ORDER BY timeissued) AS xs FROM matched GROUP BY ALL),
  c AS ({" UNION ALL ".join(parts)}),
  g AS (SELECT *, sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER w AS seg, lag(kind) OVER w AS prev FROM c WINDOW w AS (PARTITION BY level, id, key ORDER BY timeissued, range)),
  d AS (SELECT *, min(severity) FILTER (kind = 'alarm') OVER (PARTITION BY level, id, key, seg ORDER BY timeissued, range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM g)
  SELECT level, id, key, timeissued, kind, severity, range FROM d
  WHERE (kind = 'clear' AND (prev IS NULL OR prev <> 'clear')) OR (kind = 'alarm' AND (best IS NULL OR severity < best))"""


@query("alarm_state_changes", _steps_sql())
def alarm_state_changes(spark, sf):
    out = profile_alarms.alarm_state_changes(_matched(spark, sf), RULE).where("kind <> 'repeat'")
    return out.select("level", "id", "key", "timeissued", "kind", "severity", "range")


@query("state_prune", f"""WITH {SAMPLED}, r AS (SELECT level, id, key, timeissued, sev, row_number() OVER (PARTITION BY level, id, key ORDER BY timeissued DESC) AS r FROM matched)
  SELECT level, id, key, timeissued, sev FROM r WHERE r <= {RULE.horizon}""")  # fmt: skip
def state_prune(spark, sf):
    return stats.state_prune(_matched(spark, sf), RULE).select("level", "id", "key", "timeissued", "sev")


# With m = n = 1 every match stands alone, so SQL can state the changes: a clear
# after anything but a clear, an alarm below the lowest number since the last clear.
SIMPLE = stats.parse_rule("SIGMA:i:1.5:n::1:1:1:1:21600;SIGMA:i:0.8:e:1.5:3:1:1:2:86400;CLEAR:5:1:1")
CHANGES = SAMPLED + """,
  s AS (SELECT level, id, key, timeissued, sigma, CASE WHEN sigma >= 1.5 THEN 1 WHEN sigma >= 0.8 THEN 3 ELSE -1 END AS sev FROM sc),
  c AS (SELECT *, sum(CASE WHEN sev = -1 THEN 1 ELSE 0 END) OVER w AS seg, lag(sev) OVER w AS prev FROM s WINDOW w AS (PARTITION BY level, id, key ORDER BY timeissued)),
  d AS (SELECT *, min(sev) FILTER (sev <> -1) OVER (PARTITION BY level, id, key, seg ORDER BY timeissued ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c),
  changes AS (SELECT level, id, key, timeissued, sigma, CASE WHEN sev = -1 THEN 'clear' ELSE 'alarm' END AS kind, CASE WHEN sev = -1 THEN 5 ELSE sev END AS severity FROM d
  WHERE (sev = -1 AND (prev IS NULL OR prev <> -1)) OR (sev <> -1 AND (best IS NULL OR sev < best)))"""


def _changes(spark, sf):
    m = _matched(spark, sf).drop("sev", "range", "score")
    return profile_alarms.alarm_state_changes(stats.range_rule_match(m, SIMPLE), SIMPLE)


@query("alarm_state_changes_simple", f"WITH {CHANGES} SELECT level, id, key, timeissued, kind, severity FROM changes")
def alarm_state_changes_simple(spark, sf):
    return _changes(spark, sf).where("kind <> 'repeat'").select("level", "id", "key", "timeissued", "kind", "severity")


@query("alarm_repeat", f"""WITH {CHANGES}, g AS (SELECT *, lead(timeissued) OVER (PARTITION BY level, id, key ORDER BY timeissued) AS nx, CASE severity WHEN 1 THEN 21600 ELSE 43200 END AS gap FROM changes),
  n AS (SELECT *, (coalesce(nx - 1, 1706745600) - timeissued) // gap AS n FROM g WHERE kind = 'alarm')
  SELECT level, id, key, severity, timeissued + gap * k AS timeissued FROM (SELECT *, unnest(range(1, CAST(n + 1 AS BIGINT))) AS k FROM n WHERE n > 0)""")  # fmt: skip
def alarm_repeat(spark, sf):
    out = profile_alarms.alarm_repeat(_changes(spark, sf), SIMPLE, 1706745600)
    return out.select("level", "id", "key", "severity", "timeissued")


@query("profile_alarm_events", f"""WITH {CHANGES} SELECT key AS alarmid, level AS level1, id AS id1, timeissued, CASE kind WHEN 'clear' THEN 2 ELSE 1 END AS type, CASE kind WHEN 'clear' THEN 4 ELSE 3 END AS state, severity,
  CASE kind WHEN 'clear' THEN 'Profile Alarm Cleared (' || key || ')' ELSE 'Profile Alarm (' || key || '=' || printf('%.2f', sigma) || ' sigma ' ||
  CASE severity WHEN 1 THEN '>= 1.50' ELSE 'in range [0.80,1.50)' END || ') for 1/1 cycles' END AS text FROM changes""")  # fmt: skip
def profile_alarm_events(spark, sf):
    return profile_alarms.change_alarms(_changes(spark, sf).where("kind <> 'repeat'"), SIMPLE)


@query("group_by_mode", f"""WITH {V.FRAMED}, x AS (SELECT *, {V.GROUP_SQL} AS mode, CAST(CAST(id AS BIGINT) % 10 AS VARCHAR) AS iid FROM framed)
  SELECT 'curr' AS series, 'g' AS level, iid AS id, key, frame, min(timeissued) AS timeissued, round(CASE mode WHEN 'sum' THEN sum(val) WHEN 'min' THEN min(val)
  WHEN 'max' THEN max(val) ELSE avg(val) END, 6) AS val FROM x GROUP BY iid, key, frame, mode""")  # fmt: skip
def group_by_mode(spark, sf):
    s = V.framed(spark, sf).withColumns({"ilevel": F.lit("g"), "iid": F.expr("string(bigint(id) % 10)")})
    return stats.group_by_mode(s, V.CATALOGUE).withColumn("val", F.round("val", 6))


@query("trend_projection", f"""WITH {V.POINTS}, h AS (SELECT level, id, key, CAST((timeissued - 1704067200) // 3600 AS INTEGER) AS frame, min(timeissued) AS timeissued, sum(val) AS val FROM points GROUP BY ALL),
  f AS (SELECT level, id, key, regr_slope(val, frame) AS b, regr_intercept(val, frame) AS a, arg_min(timeissued, frame) AS t0, min(frame) AS f0,
    arg_max(timeissued, frame) AS t1, max(frame) AS f1 FROM h GROUP BY ALL HAVING count(*) > 1 AND stddev_samp(frame) > 1e-6 AND (count(*) - 1) * stddev_samp(frame) * stddev_samp(val) > 1e-6)
  SELECT level, id, key, pos, frame, timeissued, round(a + b * frame, 6) AS val, '___proj___' AS label FROM (SELECT level, id, key, a, b, unnest([0, 1, 2]) AS pos,
  unnest([f0, f1, 1000]) AS frame, unnest([t0, t1, 1707667200]) AS timeissued FROM f)
  UNION ALL SELECT level, id, key, NULL, frame, timeissued, round(val, 6), NULL FROM h""")  # fmt: skip
def trend_projection(spark, sf):
    p = stats.sample_points(V.framed(spark, sf), V.CATALOGUE)
    hour = p.withColumn("frame", F.expr("int((timeissued - 1704067200) div 3600)"))
    h = hour.groupBy(*stats.SERIES, "frame").agg(F.min("timeissued").alias("timeissued"), F.sum("val").alias("val"))
    return dashboard.query_projection(h.withColumn("series", F.lit("curr")), 1000, 1707667200).withColumn("val", F.round("val", 6))


@query("fn_capacity_percent", f"""WITH {V.STAT} SELECT seq, round(CASE key WHEN 'click' THEN 100 * val / 500 WHEN 'signup' THEN val
  WHEN 'purchase' THEN 100 * val / (100 + CAST(id AS BIGINT) % 7 * 50) END, 6) AS percent FROM stat""")  # fmt: skip
def fn_capacity_percent(spark, sf):
    out = stats.capacity_percent(V.stat(spark, sf), V.CATALOGUE, V.inv_node(spark, sf))
    return out.select("seq", F.round("percent", 6).alias("percent"))
