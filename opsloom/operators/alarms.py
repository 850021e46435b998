"""Alarm events: echo removal, open alarms, volumes, counts, correlation in batch.

A single object may raise a third of all alarms. Lookups are therefore made
against one aggregated row per key, and ordered work over an object's alarms
goes through ``ordered.in_order``, which cuts long runs into chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ALARM_MODE, ALARM_TYPE, SORT_ORDER
from ..session import stored
from .ordered import in_order, lag_of, row_count
from .rows import truth

# Object names with a meaning and attribute keys.
SERVICE_UPDATE = "__ce_svc_upd__"
ALL_CLEAR = "__all_clear__"
ESSENTIAL_STAT = "essentialstat"
SERVICE_LEVEL = "scope_servicelevel"
SYSTEM_TYPE = "scope_systype"

ECHO = ("timeissued", "severity", "state", "type", "text")


def ticket_echo_dedupe(df: DataFrame, order: str) -> DataFrame:
    """A correlated record replaces the first normal record that equals it.

    For every ccid the last ``override`` record (by ``order``, a unique column) is
    compared; the first normal record with the same ccid, time, severity, state,
    type and text is dropped. Override records come out as normal ones.
    """
    has = F.coalesce(F.col("ccid"), F.lit("")) != ""
    over = has & (F.col("sortorder") == SORT_ORDER["override"])
    last = df.where(over).groupBy("ccid").agg(F.max_by(F.struct(*ECHO), order).alias("__o"))
    last = last.select("ccid", *[F.col(f"__o.{c}").alias(c) for c in ECHO])
    plain = df.where(has & ~over)
    echoes = plain.join(last, ["ccid", *ECHO], "left_semi").groupBy("ccid").agg(F.min(order).alias(order))
    out = df.join(echoes.select(F.col(order).alias("__e")), df[order] == F.col("__e"), "left_anti")
    return out.withColumn(
        "sortorder", F.when(over, F.lit(SORT_ORDER["normal"])).otherwise(F.col("sortorder"))
    )


def clear_key() -> Column:
    """What a clear is looked up by, as (kind, a, b): kind c(cid), i(d), a(t time), o(bject), all; null if it names nothing."""
    cc, aid, obj = (F.coalesce(F.col(c), F.lit("")) for c in ("ccid", "alarmid", "id1"))
    tc = F.coalesce(F.col("timecleared"), F.lit(0))
    return (
        F.when(obj == SERVICE_UPDATE, None)
        .when(obj == ALL_CLEAR, F.struct(F.lit("all").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b")))
        .when(cc != "", F.struct(F.lit("c").alias("kind"), cc.alias("a"), F.lit("").alias("b")))
        .when((aid != "") & (obj != ""), F.struct(F.lit("i").alias("kind"), obj.alias("a"), aid.alias("b")))
        .when((tc > 0) & (obj != ""), F.struct(F.lit("a").alias("kind"), obj.alias("a"), tc.cast("string").alias("b")))
        .when(obj != "", F.struct(F.lit("o").alias("kind"), obj.alias("a"), F.lit("").alias("b")))
    )


def clear_keys(clears: DataFrame) -> DataFrame:
    """One row per key of ``clear_key``: the latest clear, and the time it gives."""
    tc = F.coalesce(F.col("timecleared"), F.lit(0))
    keyed = clears.withColumns({"__k": clear_key(), "__tc": F.when(tc > 0, tc).otherwise(F.col("timeissued"))})
    return (
        keyed.where("__k is not null")
        .groupBy(F.col("__k.kind").alias("kind"), F.col("__k.a").alias("a"), F.col("__k.b").alias("b"))
        .agg(F.max("timeissued").alias("at"), F.max_by("__tc", F.struct("timeissued", "__tc")).alias("cleared"))
    )


def match_clears(df: DataFrame, clears: DataFrame) -> DataFrame:
    """Adds ``cleared_at`` to alarms: the time of the clear that ends them.

    Precedence: a clear of everything, then ccid, object and alarm id, object and
    cleared time, object. A clear counts if it is not earlier than the alarm;
    of several the latest. One aggregated row per key is joined per kind.
    """
    # read five times below: reduced to one row per key once
    keys = stored(clear_keys(clears), "clears")
    out = df.withColumns({"__cc": F.coalesce("ccid", F.lit("")), "__aid": F.coalesce("alarmid", F.lit(""))})
    plans = {
        "c": (F.col("__cc"), F.lit("")),
        "i": (F.col("id1"), F.col("__aid")),
        "a": (F.col("id1"), F.col("timeissued").cast("string")),
        "o": (F.col("id1"), F.lit("")),
    }
    found: list[Column] = []
    for kind, (a, b) in plans.items():
        one = keys.where(F.col("kind") == kind).select(
            F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("at").alias(f"__at_{kind}"),
            F.col("cleared").alias(f"__cl_{kind}"),
        )
        out = out.join(one, (a == F.col("__a")) & (b == F.col("__b")), "left").drop("__a", "__b")
        found.append(F.when(F.col(f"__at_{kind}") >= F.col("timeissued"), F.col(f"__cl_{kind}")))
    everything = keys.where("kind = 'all'").agg(F.max("at")).scalar()
    out = out.withColumn(
        "cleared_at", F.coalesce(F.when(everything >= F.col("timeissued"), everything), *found)
    )
    return out.drop("__cc", "__aid", *[f"__{p}_{k}" for k in plans for p in ("at", "cl")])


def open_alarms(df: DataFrame, keep_seconds: int, order: str) -> DataFrame:
    """Alarms that are not cleared and not older than the keep window."""
    one = ticket_echo_dedupe(df, order)
    alarms = one.where((F.col("type") != ALARM_TYPE["clear"]) & (F.coalesce("timecleared", F.lit(0)) == 0))
    newest = df.agg(F.max("timeissued")).scalar()
    recent = alarms.where(F.col("timeissued") >= newest - keep_seconds)
    clears = df.where(F.col("type") == ALARM_TYPE["clear"])
    return match_clears(recent, clears).where("cleared_at is null").drop("cleared_at")


def alarm_volume(
    df: DataFrame, interval: int = 300, per: str = "frame", first_time: int | None = None,
    by: Sequence[str] = ("level1", "id1"),
) -> DataFrame:
    """Alarms counted per interval as a stat (``alarm_volume._total``).

    Frames count from the start of the first interval of the data, or from
    ``first_time``; ``per`` is frame, hour or day. Only primary assets count, where
    the rows have a class.
    """
    src = df.where("iclass1 = 1") if "iclass1" in df.columns else df
    t = F.col("timeissued") + interval // 2
    start = t - F.pmod(t, F.lit(interval))
    base = F.lit(first_time) if first_time is not None else src.agg(F.min(start)).scalar()
    step = {"frame": 1, "hour": 3600 // interval, "day": 86_400 // interval}[per]
    frame = F.floor((t - base) / (interval * step)).cast("int")
    return (
        src.groupBy(*[F.col(b).alias(b.rstrip("1")) for b in by], frame.alias("frame"))
        .agg(F.count(F.lit(1)).cast("double").alias("val"), F.min(start).alias("timeissued"))
        .withColumns({"key": F.lit("alarm_volume._total"), "label": F.lit("Alarm Volume")})
    )


def counts_by_severity(
    df: DataFrame, keys: Sequence[str], clear_severity: int = 5, severities: Sequence[int] = (1, 2, 3, 4, 5)
) -> DataFrame:
    """Counts by ticket mode and severity, per asset or edge; clears count as ``clear_severity``."""
    sev = F.when(F.col("type") == ALARM_TYPE["clear"], F.lit(clear_severity)).otherwise(F.col("severity"))
    named = df.withColumn("__sev", sev)
    return named.groupBy(*keys, "tmode").agg(
        *[F.count_if(F.col("__sev") == s).alias(f"sev{s}") for s in severities]
    )


def alarm_grid(df: DataFrame, row: str, column: str, columns: Sequence) -> DataFrame:
    """Alarm count and worst severity per (row, column) of a grid of assets."""
    return df.groupBy(row).pivot(column, list(columns)).agg(
        F.count(F.lit(1)).alias("n"), F.min("severity").alias("worst")
    )


def alarmed_stat_keys(df: DataFrame, level: str = "level1", id_: str = "id1") -> DataFrame:
    """Distinct alarm ids per asset that name a stat (``name_part.instance``)."""
    names_stat = F.contains("alarmid", F.lit("_")) & F.contains("alarmid", F.lit("."))
    return df.where(names_stat).select(F.col(level).alias("level"), F.col(id_).alias("id"), F.col("alarmid").alias("key")).distinct()


def essential_stats(assets: DataFrame, attrs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Essential stats per asset, one row each.

    An asset's own ``essentialstat<n>`` attributes, numbered without a gap from 0;
    without any, the defaults of its (service level, system type). ``defaults``:
    servicelevel, systype, key, regex (adds ``.*``).
    """
    num = F.regexp_extract("key", f"^{ESSENTIAL_STAT}([0-9]+)$", 1)
    own = attrs.where(num != "").select("level", "id", num.cast("int").alias("n"), F.col("val").alias("stat"))
    # the first number that is missing ends the list
    follow = own.select("level", "id", (F.col("n") + 1).alias("n")).unionByName(
        own.select("level", "id", F.lit(0).alias("n"))
    )
    upto = follow.distinct().join(own, ["level", "id", "n"], "left_anti").groupBy("level", "id").agg(F.min("n").alias("upto"))
    own = own.join(upto, ["level", "id"]).where("n < upto").select("level", "id", "n", "stat")
    base = assets.select("level", "id").distinct()
    rest = base.join(own, ["level", "id"], "left_anti")
    sl = attrs.where(F.col("key") == SERVICE_LEVEL).select("level", "id", F.col("val").alias("servicelevel"))
    st = attrs.where(F.col("key") == SYSTEM_TYPE).select("level", "id", F.col("val").alias("systype"))
    fallback = (
        rest.join(sl, ["level", "id"])
        .join(st, ["level", "id"])
        .join(defaults, ["servicelevel", "systype"])
        .select(
            "level", "id", F.lit(-1).alias("n"),
            F.concat("key", F.when(F.col("regex"), F.lit(".*")).otherwise(F.lit(""))).alias("stat"),
        )
    )
    return own.join(base, ["level", "id"], "left_semi").unionByName(fallback)


# --- batch correlation -----------------------------------------------------------------


def sessions(
    df: DataFrame, keys: Sequence[str], gap: int, order: str, time: str = "timeissued", step: Column | None = None
) -> DataFrame:
    """Cut the rows of a key into sessions: at most ``gap`` seconds between rows.

    Adds ``session`` (from 1), ``nth`` (row of the session, from 1), ``before`` (time of
    the row before it in the session) and, with ``step``, ``counter`` (running sum of
    the step within the session). Exact for any key size: two rounds of chunked
    scans.
    """
    one = F.lit(1).cast("long")
    s = (step if step is not None else one).cast("long")
    o = in_order(df.withColumn("__step", s), [time, order], keys).scans(
        {"__prev": lag_of(F.col(time)), "__rn": row_count(), "__sum": (F.col("__step"), "sum")}
    )
    new = F.col("__prev").isNull() | (F.col(time) - F.col("__prev.v") > gap)
    o = o.with_columns({"__new": new}).scans(
        {
            "session": (F.when(F.col("__new"), one).otherwise(F.lit(0)), "sum"),
            # totals before the session began
            "__base": (
                F.when(
                    F.col("__new"),
                    F.struct((F.col("__rn") - 1).alias("rn"), (F.col("__sum") - F.col("__step")).alias("sum")),
                ),
                "last",
            ),
        }
    )
    out = o.rows().withColumns(
        {"nth": F.col("__rn") - F.col("__base.rn"), "counter": F.col("__sum") - F.col("__base.sum")}
    )
    out = out.withColumn("before", F.when(~F.col("__new"), F.col("__prev.v")))
    return out.drop("__prev", "__rn", "__sum", "__new", "__base", "__step", *([] if step is not None else ["counter"]))


def repeat_groups(
    df: DataFrame, keys: Sequence[str] = ("id1", "text"), gap: int = 1800, min_count: int = 2,
    delay: int = 300, refresh: int = 7200, order: str = "seq", until: int | None = None,
) -> DataFrame:
    """Repeating alarms in one group per object and text.

    A group is a session with gap 30 minutes; it lives that long after its last
    alarm. Its first ticket is due at the ``min_count``-th alarm or ``delay`` seconds
    after its first, whichever is earlier, and is refreshed every ``refresh`` seconds.
    The clock is the newest alarm, or ``until``.
    """
    clock = F.lit(until) if until is not None else df.agg(F.max("timeissued")).scalar()
    s = sessions(df, keys, gap, order)
    g = s.groupBy(*keys, "session").agg(
        F.count(F.lit(1)).alias("n"), F.min("timeissued").alias("first"), F.max("timeissued").alias("last"),
        F.min(F.when(F.col("nth") == min_count, F.col("timeissued"))).alias("__nth"),
    )
    late = F.when(F.col("first") + delay < clock, F.col("first") + delay)
    g = g.withColumn("ticket", F.least(F.col("__nth"), late))
    more = F.floor((F.least(F.col("last") + gap, clock) - F.col("ticket")) / refresh)
    return g.select(
        *keys, "session", "n", "first", "last", "ticket",
        F.coalesce(F.greatest(more, F.lit(0)), F.lit(0)).cast("long").alias("refreshes"),
    )


def balance_groups(
    df: DataFrame, keys: Sequence[str] = ("id1", "unique", "alarmid"), window: int = 1800, immediate: int = 3,
    balance: bool = True, defer_count: int | None = None, defer_time: int = 0, order: str = "seq",
    until: int | None = None,
) -> DataFrame:
    """Up/down balance (or plain count) per match window, with its first ticket.

    The counter adds 1 for a down and takes 1 for an up (or counts every alarm).
    The ticket is due when it reaches ``immediate``, or when it is at least
    ``defer_count`` and nothing came for more than ``defer_time`` seconds.
    """
    step = F.when(F.col("state") == 3, 1).when(F.col("state") == 4, -1).otherwise(0) if balance else F.lit(1)
    s = sessions(df, keys, window, order, step=step).withColumn("__step", step)
    t, c = F.col("timeissued"), F.col("counter")
    due = [F.min(F.when(c >= immediate, t))]
    if defer_count is not None:
        clock = F.lit(until) if until is not None else df.agg(F.max("timeissued")).scalar()
        quiet = (t - F.col("before") > defer_time) & (c - F.col("__step") >= defer_count)
        due.append(F.min(F.when(quiet, F.col("before") + defer_time)))
        end = F.max(F.struct(t.alias("t"), F.col("nth"), c.alias("c")))
        over = (end["c"] >= defer_count) & (end["t"] + defer_time < F.max(clock)) & F.lit(defer_time <= window)
        due.append(F.when(over, end["t"] + defer_time))
    return s.groupBy(*keys, "session").agg(
        F.count(F.lit(1)).alias("n"), F.max("counter").alias("peak"),
        (F.least(*due) if len(due) > 1 else due[0]).alias("ticket"),
        F.min("timeissued").alias("first"), F.max("timeissued").alias("last"),
    )


def updown_timeout(
    df: DataFrame, keys: Sequence[str] = ("id1", "alarmid"), defer: int = 86_400, order: str = "seq",
    until: int | None = None,
) -> DataFrame:
    """Downs that no up of the same key follows within ``defer`` seconds.

    The next up is a scan from the other end, so no pairs are formed. A down whose
    time is not over at ``until`` (the newest row) is still pending.
    """
    back = in_order(
        df.withColumns({"__t": -F.col("timeissued"), "__o": -F.col(order)}), ["__t", "__o"], keys
    ).scan("next_up", F.when(F.col("state") == 4, F.col("timeissued")), "last", inclusive=False)
    clock = F.lit(until) if until is not None else df.agg(F.max("timeissued")).scalar()
    due = F.col("timeissued") + defer
    rows = back.rows().drop("__t", "__o").where(F.col("state") == 3)
    late = F.col("next_up").isNull() | (F.col("next_up") > due)
    return rows.where(truth(late) & (due < clock)).withColumn("ticket", due)


def ticket_pick(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Representative of a group: lowest severity number, latest, lowest id."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(F.col("severity"), -F.col("timeissued"), F.col(order))).alias("__r")
    return df.groupBy(*keys).agg(pick).select(*keys, "__r.*").select(*df.columns)


def defer_flag(df: DataFrame, members: DataFrame, order: str) -> DataFrame:
    """Alarms in a correlation group are deferred; others are ticketed at once."""
    m = members.select(F.col(order).alias("__m")).distinct().withColumn("__in", F.lit(True))
    out = df.join(m, df[order] == F.col("__m"), "left")
    return out.withColumn(
        "tmode",
        F.when(F.col("__in") & (F.col("tmode") == ALARM_MODE["keep"]), F.lit(ALARM_MODE["defer"])).otherwise(F.col("tmode")),
    ).drop("__m", "__in")


def save_filter(df: DataFrame) -> DataFrame:
    """Only alarms with save mode keep are stored."""
    return df.where(F.col("smode") == ALARM_MODE["keep"])
