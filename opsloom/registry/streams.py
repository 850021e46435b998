"""Queries that run Structured Streaming jobs over files of the input tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alarms as A
from ..operators import graph as G
from ..operators import stats
from ..session import scratch_path
from ..streaming import hours, jobs
from ..streaming.correlate import GEN1, GEN2, IOT, CorrelationRule
from ..streaming.groups import group_id
from . import views as V
from .alarms import _GAP, sessions_sql
from .core import query, table
from .inventory import _order_edges
from .series import CHANGES, SIMPLE, quarter_profile

HALF = 1705400000


def _in_two(df, time, run):
    """Write rows before and after HALF as two deliveries; ``run`` catches up after each."""
    path = scratch_path(df.sparkSession, "arrive")
    for part in (df.where(F.col(time) < HALF), df.where(F.col(time) >= HALF)):
        part.write.mode("append").parquet(path)
        run(path)


@query("stream_tail", f"WITH {V.STAT} SELECT seq, id, key, val FROM stat")
def stream_tail(spark, sf):
    s = V.stat(spark, sf).select("seq", "id", "key", "val", "timeissued")
    out, cp = scratch_path(spark, "tail"), scratch_path(spark, "tail-cp")

    def run(path):
        jobs.catch_up(jobs.stream_tail(spark, path, s.schema, max_files=2), out, cp)

    _in_two(s, "timeissued", run)
    return spark.read.parquet(out).drop("timeissued")


@query("st_event_time", f"""WITH {V.STAT}, g AS (SELECT timeissued - timeissued % 21600 AS start, count(*) AS n FROM stat GROUP BY ALL)
  SELECT start, n FROM g WHERE start + 21600 <= (SELECT max(timeissued) FROM stat) - 3600""")  # fmt: skip
def st_event_time(spark, sf):
    s = V.stat(spark, sf)
    out, cp = scratch_path(spark, "clock"), scratch_path(spark, "clock-cp")

    def run(path):
        t = jobs.event_time(jobs.stream_tail(spark, path, s.schema), "1 hour")
        g = t.groupBy(F.window("ts", "6 hours")).agg(F.count("*").alias("n"))
        jobs.catch_up(g.select(F.unix_timestamp("window.start").alias("start"), "n"), out, cp)

    _in_two(s, "timeissued", run)
    return spark.read.parquet(out)


@query("st_tumbling_stats", f"""WITH {V.STAT}, h AS (SELECT timeissued - timeissued % 3600 AS t, level, id, key, {V.MODE_SQL} AS mode, sum(val) AS s, min(val) AS lo, max(val) AS hi, avg(val) AS a, count(*) AS n FROM stat GROUP BY ALL)
  SELECT t AS timeissued, level, id, key, round(CASE mode WHEN 'sum' THEN s WHEN 'min' THEN lo WHEN 'max' THEN hi ELSE a END, 6) AS val, n FROM h WHERE t + 3600 <= (SELECT max(timeissued) FROM stat) - 600""")  # fmt: skip
def st_tumbling_stats(spark, sf):
    s = V.stat(spark, sf)
    out, cp = scratch_path(spark, "tumble"), scratch_path(spark, "tumble-cp")

    def run(path):
        jobs.catch_up(jobs.tumbling_stats(jobs.stream_tail(spark, path, s.schema), V.CATALOGUE), out, cp)

    _in_two(s, "timeissued", run)
    return spark.read.parquet(out).withColumn("val", F.round("val", 6))


@query("st_late_split", f"""WITH {V.STAT} SELECT CASE WHEN timeissued >= 1704500000 THEN 'on time' ELSE 'late' END AS side, count(*) AS n FROM stat GROUP BY ALL""")
def st_late_split(spark, sf):
    s = V.stat(spark, sf)
    out, cp = scratch_path(spark, "late"), scratch_path(spark, "late-cp")

    def save(side, epoch):
        return lambda d: jobs.write_epoch(f"{out}/side={side}")(d, epoch)

    def run(path):
        src = jobs.stream_tail(spark, path, s.schema)
        jobs.catch_up_batches(src, lambda b, e: jobs.split_late(b, 1704500000, save("on time", e), save("late", e)), cp)

    _in_two(s, "timeissued", run)
    return spark.read.parquet(out).groupBy("side").agg(F.count("*").alias("n"))


@query("st_profile_alarm", f"WITH {CHANGES} SELECT level, id, key, timeissued, kind FROM changes")
def st_profile_alarm(spark, sf):
    points = stats.sample_points(V.framed(spark, sf), V.CATALOGUE).withColumn("frame", F.expr("int(frame div 72)"))
    store = scratch_path(spark, "profile")
    quarter_profile(points).write.parquet(store)
    out, cp = scratch_path(spark, "pce"), scratch_path(spark, "pce-cp")

    def run(path):
        live = jobs.stream_tail(spark, path, points.schema)
        scored = stats.sigma_score(live, spark.read.parquet(store))
        jobs.catch_up(jobs.profile_alarms(stats.range_rule_match(scored, SIMPLE), SIMPLE), out, cp)

    _in_two(points, "timeissued", run)
    return spark.read.parquet(out).where("kind <> 'repeat'").select("level", "id", "key", "timeissued", "kind")


# Three deliveries of points, a fifth of them late; days of the last three days are open, 25 days is too old.
_DAYS = (dt.date(2024, 1, 11), dt.date(2024, 1, 21), dt.date(2024, 1, 31))
_ARRIVES = "CASE WHEN seq % 5 = 0 OR timeissued >= 1705795200 THEN 2 WHEN timeissued >= 1704931200 THEN 1 ELSE 0 END"
_ROUTED = f"""arrived AS (SELECT *, CAST(make_timestamp(timeissued * 1000000) AS DATE) AS event_date, CAST(timeissued % 86400 // 3600 AS INTEGER) AS event_hour, {_ARRIVES} AS epoch FROM framed),
  routed AS (SELECT *, DATE '2024-01-11' + CAST(10 * epoch AS INTEGER) AS today FROM arrived),
  taken AS (SELECT *, event_date < today - 3 AS reopened FROM routed WHERE event_date >= today - 3 OR today - event_date <= 25)"""


def _hours(spark, sf):
    """The store after three deliveries; the second batch is run twice."""
    f = V.framed(spark, sf).select("seq", "level", "id", "key", "unit", "frame", "timeissued", "val")
    store, arrive, cp = (scratch_path(spark, n) for n in ("hours", "points", "hours-cp"))
    step = hours.ingest(store, lambda epoch: _DAYS[epoch], open_days=3, max_age_days=25)

    def run(batch, epoch):
        step(batch, epoch)
        if epoch == 1:
            step(batch, epoch)

    for k in range(3):
        f.where(F.expr(_ARRIVES.replace("CASE", "case")) == k).write.mode("append").parquet(arrive)
        jobs.catch_up_batches(jobs.stream_tail(spark, arrive, f.schema), run, cp)
    return store


@query("hour_merge_job", f"""WITH {V.FRAMED}, {_ROUTED}, r AS (SELECT *, row_number() OVER (PARTITION BY level, id, key, unit, event_date, event_hour, frame ORDER BY epoch DESC, timeissued DESC, val DESC) AS r FROM taken)
  SELECT event_date, event_hour, id, key, frame, timeissued, val FROM r WHERE r = 1""")
def hour_merge_job(spark, sf):
    """Points of all days after late days were reopened and merged."""
    store = _hours(spark, sf)
    return spark.read.parquet(f"{store}/hours").select("event_date", "event_hour", "id", "key", "frame", "timeissued", "val")


@query("late_dates", f"WITH {V.FRAMED}, {_ROUTED} SELECT event_date, max(reopened) AS reopened FROM taken GROUP BY event_date")
def late_dates(spark, sf):
    """The dates that three deliveries touched, and which of them were closed before."""
    return hours.touched_dates(spark, _hours(spark, sf))


GEN = CorrelationRule("GEN", "type = 1", ("id1",), window=_GAP, immediate=2, first_delay=30000, refresh=36000)


def _tickets_sql(clock: str) -> str:
    return f"""WITH {V.ALARMS}, e AS (SELECT * FROM alarm WHERE type = 1), clk AS (SELECT {clock} AS c FROM alarm), {sessions_sql('id1', _GAP, 'e')},
  g AS (SELECT id1, session, min(timeissued) AS first, max(timeissued) AS last, min(timeissued) FILTER (nth = 2) AS nt FROM s2 GROUP BY ALL),
  t AS (SELECT *, least(nt, CASE WHEN first + 30000 < c THEN first + 30000 END) AS ticket, c FROM g, clk)
  SELECT id1, CASE WHEN k = 0 THEN 'first' ELSE 'refresh' END AS event, ticket + 36000 * k AS tick FROM (SELECT *, unnest(range(0, CAST(1 + greatest(floor((least(last + {_GAP}, c) - ticket) / 36000), 0) AS BIGINT))) AS k FROM t WHERE ticket IS NOT NULL)"""


def _correlated(spark, sf, beat=None):
    a = V.alarm(spark, sf).select("seq", "type", "id1", "severity", "state", "timeissued")
    out, cp = scratch_path(spark, "corr"), scratch_path(spark, "corr-cp")

    def run(path):
        jobs.catch_up(jobs.correlate(jobs.stream_tail(spark, path, a.schema), [GEN]), out, cp)

    rows = a
    if beat:
        # a heartbeat record matches no rule but moves the clock
        late = a.agg(F.max("timeissued").alias("t")).select(
            F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("type"), F.lit("").alias("id1"), F.lit(0).alias("severity"),
            F.lit(0).alias("state"), (F.col("t") + beat).alias("timeissued"),
        )
        rows = a.unionByName(late)
    _in_two(rows, "timeissued", run)
    df = spark.read.parquet(out)
    return df.select(F.get_json_object("group", "$.id1").alias("id1"), "event", F.col("at").alias("tick"))


@query("st_correlate", _tickets_sql("max(timeissued)"))
def st_correlate(spark, sf):
    return _correlated(spark, sf)


@query("st_heartbeat", _tickets_sql("max(timeissued) + 864000"))
def st_heartbeat(spark, sf):
    return _correlated(spark, sf, beat=864000)


# Clears between deliveries: each mode as a stream of alarms (type 1) and clears (type 2).


def _cleared_sql(cuts: str) -> str:
    """Groups of GEN, ended by ``cuts`` (id1, t) as well: the first clear at or after a group's last alarm."""
    return f"""WITH {V.ALARMS}, e AS (SELECT id1, alarmid, timeissued AS t, seq FROM alarm WHERE type = 1), cl AS (SELECT * FROM alarm WHERE type = 2),
  plain AS (SELECT id1, t, session FROM (SELECT *, sum(brk) OVER (PARTITION BY id1 ORDER BY t, seq) AS session FROM (SELECT *, CASE WHEN coalesce(t - lag(t) OVER (PARTITION BY id1 ORDER BY t, seq), 1e9) > {_GAP} THEN 1 ELSE 0 END AS brk FROM e))),
  cut AS ({cuts}), clk AS (SELECT greatest((SELECT max(t) FROM e), coalesce(max(t), 0)) AS c FROM cut),
  n AS (SELECT id1, t, seq, lag(t) OVER (PARTITION BY id1 ORDER BY t, seq) AS p FROM e),
  m AS (SELECT n.*, CASE WHEN p IS NULL OR t - p > {_GAP} OR EXISTS (SELECT 1 FROM cut WHERE cut.id1 = n.id1 AND cut.fits AND cut.t >= p AND cut.t < n.t) THEN 1 ELSE 0 END AS brk FROM n),
  s AS (SELECT *, sum(brk) OVER (PARTITION BY id1 ORDER BY t, seq) AS session FROM m),
  r AS (SELECT *, row_number() OVER (PARTITION BY id1, session ORDER BY t, seq) AS nth FROM s),
  g AS (SELECT id1, session, min(t) AS first, max(t) AS last, min(t) FILTER (nth = 2) AS nt FROM r GROUP BY ALL),
  h AS (SELECT g.*, lead(first) OVER (PARTITION BY id1 ORDER BY session) AS nx FROM g),
  x AS (SELECT h.id1, first, last, nt, min(cut.t) AS clear FROM h LEFT JOIN cut ON cut.id1 = h.id1 AND cut.fits AND cut.t >= last AND cut.t <= last + {_GAP} AND (nx IS NULL OR cut.t < nx) GROUP BY ALL),
  k AS (SELECT *, coalesce(clear, c) AS stop, least(nt, CASE WHEN first + 30000 < coalesce(clear, c) THEN first + 30000 END) AS ticket FROM x, clk)
  SELECT id1, CASE WHEN k = 0 THEN 'first' ELSE 'refresh' END AS event, ticket + 36000 * k AS tick FROM
    (SELECT *, unnest(range(0, CAST(1 + greatest(floor((least(last + {_GAP}, stop) - ticket) / 36000), 0) AS BIGINT))) AS k FROM k WHERE ticket IS NOT NULL)
  UNION ALL SELECT id1, 'clear', clear FROM x WHERE clear IS NOT NULL"""


def _cleared(spark, sf, clears, label):
    """Tickets and ends of GEN's groups over all alarms and these clears, in two deliveries."""
    cols = ["seq", "type", "id1", "alarmid", "ccid", "timecleared", "severity", "state", "timeissued"]
    a = V.alarm(spark, sf).where("type = 1").withColumns({"ccid": F.lit(""), "timecleared": F.lit(0).cast("bigint")}).select(*cols)
    rows = a.unionByName(clears.select(*[F.col(c).cast(a.schema[c].dataType).alias(c) for c in cols]))
    out, cp = scratch_path(spark, label), scratch_path(spark, f"{label}-cp")

    def run(path):
        jobs.catch_up(jobs.correlate(jobs.stream_tail(spark, path, a.schema), [GEN], clears="type = 2"), out, cp)

    _in_two(rows, "timeissued", run)
    return spark.read.parquet(out).select(F.get_json_object("group", "$.id1").alias("id1"), "event", F.col("at").alias("tick"))


def _asks(spark, sf, **given):
    """The clears of the alarm table, naming only what is given."""
    plain = {"alarmid": "''", "ccid": "''", "timecleared": "0"} | given
    return V.alarm(spark, sf).where("type = 2").withColumns({c: F.expr(e) for c, e in plain.items()})


@query("st_clear_object", _cleared_sql("SELECT id1, timeissued AS t, true AS fits FROM cl"))
def st_clear_object(spark, sf):
    """Clears by object end its groups in the stream."""
    return _cleared(spark, sf, _asks(spark, sf), "clear-o")


@query("st_clear_alarmid", _cleared_sql("SELECT id1, timeissued AS t, seq % 2 = 0 AS fits FROM cl"))
def st_clear_alarmid(spark, sf):
    """Clears by object and alarm id: every other one names an id that no alarm has."""
    return _cleared(spark, sf, _asks(spark, sf, alarmid="if(seq % 2 = 0, concat('disk_used.sd', bigint(id1) % 3), 'other')"), "clear-i")


@query("st_clear_time", _cleared_sql("SELECT c.id1, c.timeissued AS t, c.seq % 2 = 0 AS fits FROM cl c"))
def st_clear_time(spark, sf):
    """Clears by object and the time of its last alarm before; every other one names a second without alarms."""
    a = V.alarm(spark, sf)
    past = Window.partitionBy("id1").orderBy("timeissued", "type", "seq")
    known = a.withColumn("before", F.last(F.when(F.col("type") == 1, F.col("timeissued")), ignorenulls=True).over(past)).where("type = 2")
    asked = known.withColumns({"alarmid": F.lit(""), "ccid": F.lit(""), "timecleared": F.expr("if(seq % 2 = 0, coalesce(before, 1), 1)")})
    return _cleared(spark, sf, asked, "clear-a")


@query("st_clear_ccid", _cleared_sql(f"""SELECT id1, (min(t) + max(t)) // 2 AS t, true AS fits FROM plain GROUP BY id1, session HAVING count(*) >= 3"""))
def st_clear_ccid(spark, sf):
    """Clears by the name of a group: every group of three alarms or more, half way through."""
    whole = A.sessions(V.alarm(spark, sf).where("type = 1"), ["id1"], _GAP, "seq").groupBy("id1", "session")
    group = F.to_json(F.struct("id1"))
    ask = whole.agg(F.min("timeissued").alias("first"), F.max("timeissued").alias("last"), F.count("*").alias("n")).where("n >= 3").select(
        F.lit(-1).alias("seq"), F.lit(2).alias("type"), "id1", F.lit("").alias("alarmid"),
        F.concat_ws(":", F.lit(GEN.id), group_id(group), F.col("first").cast("string")).alias("ccid"),
        F.lit(0).alias("timecleared"), F.lit(1).alias("severity"), F.lit(4).alias("state"), F.expr("(first + last) div 2").alias("timeissued"),
    )
    return _cleared(spark, sf, ask, "clear-c")


@query("st_clear_all", _cleared_sql("SELECT DISTINCT e.id1, c.timeissued AS t, true AS fits FROM e, cl c WHERE c.seq % 50 = 0"))
def st_clear_all(spark, sf):
    """Clears of everything end all open groups."""
    return _cleared(spark, sf, _asks(spark, sf, id1="'__all_clear__'").where("seq % 50 = 0"), "clear-all")


_TAKES = (CorrelationRule("A", "type = 1 and severity < 3", ("id1",)), CorrelationRule("B", "alarmid <> '' and state in (3, 4)", ("id1",), closes_on_up=True))


@query("st_defer_stream", f"""WITH {V.ALARMS} SELECT seq, CASE WHEN tmode = 1 AND ((type = 1 AND severity < 3) OR (alarmid <> '' AND state = 3)) THEN 2 ELSE tmode END AS tmode FROM alarm""")
def st_defer_stream(spark, sf):
    """Alarms leave once, deferred if a group takes them."""
    a = V.alarm(spark, sf).select("seq", "type", "id1", "alarmid", "severity", "state", "tmode", "timeissued")
    out, cp = scratch_path(spark, "defer"), scratch_path(spark, "defer-cp")
    _in_two(a, "timeissued", lambda path: jobs.catch_up(jobs.defer_flags(jobs.stream_tail(spark, path, a.schema), _TAKES), out, cp))
    return spark.read.parquet(out).select("seq", "tmode")


# The three shipped rules as streams, over alarms with the attributes that they read.

_CORR = V.ALARMS + """,
x AS (SELECT seq, id1, timeissued, severity, CASE WHEN type = 1 THEN 'any.1' ELSE alarmid END AS aid1, 'k' || seq % 2 AS txt,
  CASE WHEN CAST(id1 AS BIGINT) % 4 = 0 THEN '' ELSE 'u' || CAST(id1 AS BIGINT) % 3 END AS uniq, state,
  43200 * (1 + CAST(id1 AS BIGINT) % 3) AS matchwindow, 2 + CAST(id1 AS BIGINT) % 2 AS imm, CAST(id1 AS BIGINT) % 3 AS dcount,
  10800 AS dtime, 21600 AS upd, CAST(id1 AS BIGINT) % 2 AS bal FROM alarm),
clk AS (SELECT max(timeissued) AS c FROM x)"""


def _attributed(spark, sf):
    i = "bigint(id1)"
    return V.alarm(spark, sf).selectExpr(
        "seq", "type", "id1", "timeissued", "severity", "state", "if(type = 1, 'any.1', alarmid) as any_id", "alarmid", "concat('k', seq % 2) as text",
        f"if({i} % 4 = 0, '', concat('u', {i} % 3)) as `unique`", f"43200 * (1 + {i} % 3) as matchwindow", f"2 + {i} % 2 as ticketimmediatecount",
        f"{i} % 3 as ticketdefercount", "10800 as ticketdefertime", "21600 as ticketupdatetime", f"{i} % 2 as balancemode",
    )


def _tickets(spark, sf, alarms, rule, label):
    out, cp = scratch_path(spark, label), scratch_path(spark, f"{label}-cp")

    def run(path):
        jobs.catch_up(jobs.correlate(jobs.stream_tail(spark, path, alarms.schema), [rule]), out, cp)

    _in_two(alarms, "timeissued", run)
    return spark.read.parquet(out)


def _seconds_sql(keys: str, where: str, step: str, window: str, extra: str) -> str:
    """Alarms of one second added up, cut into groups by the window."""
    return f"""{_CORR},
 sec AS (SELECT {keys}, timeissued AS t, sum({step})::BIGINT AS step, {extra} FROM x WHERE {where} GROUP BY ALL),
 s0 AS (SELECT *, lag(t) OVER (PARTITION BY {keys} ORDER BY t) AS p FROM sec),
 s1 AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > {window} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY t) AS session FROM s0),
 s2 AS (SELECT a.*, (SELECT sum(b.step) FROM s1 b WHERE {" AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))} AND b.session = a.session AND b.t <= a.t AND b.t >= a.t - a.{window}) AS counter FROM s1 a)"""


def _events_sql(keys: str, window: str, refresh: str) -> str:
    return f"""SELECT {keys}, CASE WHEN k = 0 THEN 'first' ELSE 'refresh' END AS event, ticket + {refresh} * k AS tick FROM
  (SELECT *, unnest(range(0, CAST(1 + greatest(floor((least(last + {window}, c) - ticket) / {refresh}), 0) AS BIGINT))) AS k FROM g, clk WHERE ticket IS NOT NULL)"""


@query("st_corr_gen1", f"""WITH {_seconds_sql('id1, txt', "aid1 = 'any.1'", "1", "w", "1800 AS w")},
  g AS (SELECT id1, txt, session, max(t) AS last, max(w) AS w, least(min(t) FILTER (counter >= 2), CASE WHEN min(t) + 300 < (SELECT c FROM clk) THEN min(t) + 300 END) AS ticket FROM s2 GROUP BY ALL)
  {_events_sql("id1, txt", "w", "7200")}""")  # fmt: skip
def st_corr_gen1(spark, sf):
    """Repeating alarms, by the shipped rule."""
    a = _attributed(spark, sf).drop("alarmid").withColumnRenamed("any_id", "alarmid")
    df = _tickets(spark, sf, a, GEN1, "gen1")
    return df.select(F.get_json_object("group", "$.id1").alias("id1"), F.get_json_object("group", "$.text").alias("txt"), "event", F.col("at").alias("tick"))


@query("st_corr_gen2", f"""WITH {_seconds_sql('id1, uniq', "uniq <> ''", "CASE WHEN bal = 0 OR state = 3 THEN 1 WHEN state = 4 THEN -1 ELSE 0 END", "w",
    "max(matchwindow) AS w, max(imm) AS imm, max(dcount) AS dcount, max(dtime) AS dtime, max(upd) AS upd")},
  n AS (SELECT *, lead(t) OVER (PARTITION BY id1, uniq, session ORDER BY t) AS nx, (SELECT c FROM clk) AS c,
    (SELECT sum(b.step) FROM s1 b WHERE b.id1 = a.id1 AND b.uniq = a.uniq AND b.session = a.session AND b.t <= a.t AND b.t >= a.t + a.dtime - a.w) AS quiet FROM s2 a),
  g AS (SELECT id1, uniq, session, max(t) AS last, max(w) AS w, max(upd) AS upd, least(min(t) FILTER (counter >= imm),
    min(t + dtime) FILTER (quiet >= dcount AND dtime <= w AND coalesce(nx, c) > t + dtime)) AS ticket FROM n GROUP BY ALL)
  {_events_sql("id1, uniq", "w", "upd")}""")  # fmt: skip
def st_corr_gen2(spark, sf):
    """Up/down balance by the shipped rule, with the settings that each alarm brings."""
    df = _tickets(spark, sf, _attributed(spark, sf).withColumn("alarmid", F.lit("a")), GEN2, "gen2")
    return df.select(F.get_json_object("group", "$.id1").alias("id1"), F.get_json_object("group", "$.unique").alias("uniq"), "event", F.col("at").alias("tick"))


@query("st_corr_iot", f"""WITH {_CORR}, sec AS (SELECT id1, timeissued AS t, max(state) AS state, max(43200) AS dtime, max(upd) AS upd FROM x WHERE state IN (3, 4) GROUP BY ALL),
  s0 AS (SELECT *, lag(t) OVER w AS p, lag(state) OVER w AS ps FROM sec WINDOW w AS (PARTITION BY id1 ORDER BY t)),
  s1 AS (SELECT *, sum(CASE WHEN p IS NULL OR ps = 4 OR t - p > 90000 THEN 1 ELSE 0 END) OVER (PARTITION BY id1 ORDER BY t) AS session FROM s0),
  n AS (SELECT *, lead(t) OVER (PARTITION BY id1, session ORDER BY t) AS nx, (SELECT c FROM clk) AS c FROM s1),
  g AS (SELECT id1, session, max(t) FILTER (state = 3) AS last, min(t) FILTER (state = 4) AS up, max(upd) AS upd, min(t + dtime) FILTER (state = 3 AND coalesce(nx, c) > t + dtime) AS ticket FROM n GROUP BY ALL)
  SELECT id1, CASE WHEN k = 0 THEN 'first' ELSE 'refresh' END AS event, ticket + upd * k AS tick FROM
  (SELECT *, unnest(range(0, CAST(1 + greatest(floor((least(last + 90000, c, coalesce(up, c)) - ticket) / upd), 0) AS BIGINT))) AS k FROM g, clk WHERE ticket IS NOT NULL)""")  # fmt: skip
def st_corr_iot(spark, sf):
    """Downs without an up in half a day, by the shipped rule."""
    a = _attributed(spark, sf).withColumns({"alarmid": F.lit("IoT.1"), "matchwindow": F.lit(90000), "ticketdefertime": F.lit(43200)})
    df = _tickets(spark, sf, a, IOT, "iot")
    return df.select(F.get_json_object("group", "$.id1").alias("id1"), "event", F.col("at").alias("tick"))


def _impact(down: str, name: str) -> str:
    return f"""{name} AS (SELECT *, CASE WHEN lost_all = 0 AND lost_some = 0 THEN 0 WHEN lost_all = producers THEN 1 WHEN 100.0 * (producers - lost_all) / producers <= 25 THEN 2
  WHEN 100.0 * (producers - lost_all) / producers <= 50 THEN 3 ELSE 4 END AS sev FROM (SELECT o_custkey, producers, CASE WHEN alive = 0 THEN producers ELSE producers - pup END AS lost_all,
  CASE WHEN alive > 0 AND alive < consumers THEN pup ELSE 0 END AS lost_some FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS producers, count(*) FILTER (o_orderstatus <> 'O') AS consumers,
  count(*) FILTER (o_orderstatus <> 'O' AND NOT ({down})) AS alive, count(*) FILTER (o_orderstatus = 'O' AND NOT ({down})) AS pup FROM orders GROUP BY ALL) WHERE producers > 0 AND consumers > 0))"""


# Orders above a price go down at their date; every third of them comes up again 30 days later.
_CUTS = (820454400, 883612800, 4000000000)
_UPS = "o_orderkey % 3 = 0"


def _down_at(cut: int) -> str:
    t = "epoch_us(o_orderdate) // 1000000"
    return f"o_totalprice > 400000 AND {t} < {cut} AND NOT ({_UPS} AND {t} + 2592000 < {cut})"


def _changes_sql() -> str:
    parts = [f"SELECT 'svc' || o_custkey % 3 AS service, CAST(o_custkey AS VARCHAR) AS ccid, 0 AS old, sev AS new FROM i0 WHERE sev <> 0"]
    for k in range(1, len(_CUTS)):
        parts.append(
            f"SELECT 'svc' || a.o_custkey % 3, CAST(a.o_custkey AS VARCHAR), a.sev, b.sev FROM i{k - 1} a JOIN i{k} b USING (o_custkey) WHERE a.sev <> b.sev"
        )
    return f"WITH {', '.join(_impact(_down_at(c), f'i{k}') for k, c in enumerate(_CUTS))} {' UNION ALL '.join(parts)}"


_KEEP = 400 * 86400 + 3600


def _aging_sql() -> str:
    """Severities with the events of each delivery, and without those that are too old by its newest time."""
    t = "epoch_us(o_orderdate) // 1000000"
    clocks = [f"(SELECT max(CASE WHEN {t} + 2592000 < {c} AND {_UPS} THEN {t} + 2592000 ELSE {t} END) FROM orders WHERE o_totalprice > 400000 AND {t} < {c})" for c in _CUTS]
    names, parts = [], []
    for k, cut in enumerate(_CUTS):
        old = f" AND {t} + {_KEEP} > {clocks[k - 1]}" if k else ""
        names += [_impact(_down_at(cut) + old, f"n{k}"), _impact(_down_at(cut) + f" AND {t} + {_KEEP} > {clocks[k]}", f"p{k}")]
        before = f"p{k - 1}" if k else "(SELECT o_custkey, 0 AS sev FROM n0)"
        for x, y, cause in ((before, f"n{k}", "event"), (f"n{k}", f"p{k}", "age")):
            parts.append(f"SELECT 'svc' || a.o_custkey % 3 AS service, CAST(a.o_custkey AS VARCHAR) AS ccid, a.sev AS old, b.sev AS new, '{cause}' AS cause FROM {x} a JOIN {y} b USING (o_custkey) WHERE a.sev <> b.sev")
    return f"WITH {', '.join(names)} {' UNION ALL '.join(parts)}"


@query("st_service_impact_aged", _aging_sql())
def st_service_impact_aged(spark, sf):
    """Open events leave when they are too old, in a batch without data: a third evaluation. Such a batch is run twice."""
    return _impacts(spark, sf, _KEEP, lambda epoch: epoch == 1).select("service", "ccid", "old", "new", "cause")


@query("st_service_impact", _changes_sql())
def st_service_impact(spark, sf):
    """Raises and clears in three deliveries; the second batch is run twice."""
    return _impacts(spark, sf, None, lambda epoch: epoch == 1).select("service", "ccid", "old", "new")


def _impacts(spark, sf, keep, again):
    """Changes over three deliveries of events; the batches that ``again`` names are run twice."""
    o = table(spark, sf, "orders")
    edges = _order_edges(spark, sf)
    roles = G.service_roles(
        o.selectExpr("'ord' as level", "string(o_orderkey) as id", "'gce_service0' as key",
                     "concat(if(o_orderstatus = 'O', 'prod:', 'cons:'), 'svc', o_custkey % 3) as val")
    )
    members = scratch_path(spark, "members")
    G.connected_components(edges).write.parquet(members)
    high = o.where("o_totalprice > 400000").select(
        F.lit("ord").alias("level"), F.col("o_orderkey").cast("string").alias("id"), F.lit(1).alias("type"),
        F.unix_timestamp("o_orderdate").alias("t"),
    )
    ups = high.where("bigint(id) % 3 = 0").withColumns({"type": F.lit(2), "t": F.col("t") + 2592000})
    events = high.unionByName(ups)
    arrive, opened = scratch_path(spark, "gce"), scratch_path(spark, "gce-open")
    out, cp = scratch_path(spark, "gce-out"), scratch_path(spark, "gce-cp")
    before = jobs.read_before(spark, opened, events.select("level", "id").schema)
    step = jobs.impact_batches(
        edges, roles, spark.read.parquet(members), before, jobs.write_epoch(out), jobs.write_epoch(opened), "at" if keep else "t"
    )

    def twice(batch, epoch):
        step(batch, epoch)
        if again(epoch):
            step(batch, epoch)

    done = 0
    for cut in _CUTS:
        events.where((F.col("t") >= done) & (F.col("t") < cut)).coalesce(4).write.mode("append").parquet(arrive)
        live = jobs.stream_tail(spark, arrive, events.schema)
        jobs.catch_up_batches(jobs.aging_events(live, keep, time="t") if keep else live, twice, cp)
        done = cut
    return spark.read.parquet(out)
