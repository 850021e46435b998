"""The dashboard queries as lazy plans over stats, alarms and inventory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ALARM_MODE, MEAN_LABEL, SDEV_LABEL, SEVERITY
from ..operators.alarms import SERVICE_UPDATE, ticket_echo_dedupe
from ..operators.graph import UNKNOWN, rekey
from ..operators.rows import in_time_ranges, truth
from ..operators.stats import Catalogue, group_by_mode, trend_projection

PRIMARY, SECONDARY = 1, 2


def _many(df: DataFrame) -> DataFrame:
    """A side of a join with rows per asset: it is shuffled, as its file is far smaller than its rows and the planner would send them through the driver."""
    return df.hint("merge")


def _whole(c: Column, rx: str) -> Column:
    return c.rlike(f"^(?:{rx})$")


def _up(closure: DataFrame, level: str) -> DataFrame:
    return closure.where(F.col("level2") == level).select(
        F.col("level1").alias("level"), F.col("id1").alias("id"), F.col("id2").alias("up")
    )


def query_stats(
    stats: DataFrame, closure: DataFrame, out_level: str, *, selected: DataFrame | None = None,
    params: Sequence[tuple[str, str]] = (), levels: str | None = None, asset_keys: DataFrame | None = None,
    frames: tuple[int, int] | None = None, times: Sequence[tuple[int, int]] = (),
    group: Catalogue | None = None, grouped: bool = True,
) -> DataFrame:
    """Stats filtered by key/label patterns, inventory, frames and times, re-keyed
    to ``out_level``.

    ``selected`` is ``select_nodes`` output: an asset must be in it, and the entity it
    is re-keyed to as well. ``asset_keys``: (level, id, key) that are wanted. With
    ``group`` the result is grouped by the catalogue's modes.
    """
    p = F.lit(True)
    for field, rx in params:
        p = p & _whole(F.col(field), rx)
    if levels:
        p = p & _whole(F.col("level"), levels)
    if frames:
        p = p & F.col("frame").between(*frames)
    out = stats.where(p)
    if times:
        out = in_time_ranges(out, "timeissued", times)
    if asset_keys is not None:
        out = out.join(_many(asset_keys.select("level", "id", "key").distinct()), ["level", "id", "key"], "left_semi")
    if selected is not None:
        out = out.join(_many(selected.select("level", "id").distinct()), ["level", "id"], "left_semi")
    out = out.join(_many(_up(closure, out_level)), ["level", "id"])
    if selected is not None:
        ok = selected.where(F.col("ilevel") == out_level).select(F.col("iid").alias("up")).distinct()
        out = out.join(ok, "up", "left_semi")
    out = out.withColumns({"ilevel": F.lit(out_level), "iid": F.col("up"), "iclass": F.lit(PRIMARY)}).drop("up")
    return group_by_mode(out, group, grouped) if group is not None else out


def query_stats_profile(
    stats: DataFrame, profile: DataFrame, times: Sequence[tuple[int, int]] = (), **query
) -> DataFrame:
    """The same with the profile's mean and deviation series alongside.

    ``times`` choose points of the current series. A profile row has the time of its frame
    there, the earliest one; a frame without points that of the series' start.
    """
    cols = ["level", "id", "key", "frame", "timeissued", "val", "label"]
    curr = in_time_ranges(stats, "timeissued", times) if times else stats
    start = curr.agg(F.min("timeissued")).scalar()
    at = curr.groupBy(F.col("frame").alias("__f")).agg(F.min("timeissued").alias("__t"))
    prof = profile.where(F.col("label").isin(MEAN_LABEL, SDEV_LABEL)).join(at, F.col("frame") == F.col("__f"), "left")
    prof = prof.withColumn("timeissued", F.coalesce("__t", start))
    return query_stats(curr.select(*cols).unionByName(prof.select(*cols)), **query)


def query_projection(stats: DataFrame, target_frame: int, target_time: int) -> DataFrame:
    """Grouped current series, and their trend points after them (``pos`` NULL and 0, 1, 2)."""
    curr = stats.where("series = 'curr'")
    trend = trend_projection(curr, target_frame, target_time)
    same = [c for c in trend.columns if c in curr.columns]
    return curr.select(*same).unionByName(trend, allowMissingColumns=True)


def alarm_predicate(params: Sequence[tuple[str, str]]) -> Column:
    """ccid, severity (by name, any case), ticket mode (by name), text, comment: all must match as a whole."""
    sev = F.create_map(*[F.lit(x) for n, i in SEVERITY.items() for x in (i, n)])
    mode = F.create_map(*[F.lit(x) for n, i in ALARM_MODE.items() for x in (i, n)])
    subject = {
        "ccid": F.col("ccid"),
        "severity": F.try_element_at(sev, F.col("severity")),
        "ticket": F.try_element_at(mode, F.col("tmode")),
        "text": F.col("text"),
        "comment": F.col("comment"),
    }
    p = F.lit(True)
    for field, rx in params:
        p = p & _whole(subject[field], f"(?i:{rx})" if field == "severity" else rx)
    return truth(p)


def query_alarms(
    alarms: DataFrame, closure: DataFrame, out_level: str, *, secondary_level: str | None = None,
    selected: DataFrame | None = None, params: Sequence[tuple[str, str]] = (), levels: str | None = None,
    times: Sequence[tuple[int, int]] = (), order: str | None = None,
) -> DataFrame:
    """Alarms by time, ccid, severity, mode, text and comment, without echoes, re-keyed.

    An alarm of one asset becomes its primary-level entity (class 1), or its
    secondary-level one (class 2) if that is not selected. An alarm of an edge
    needs one selected endpoint.
    """
    secondary_level = secondary_level or out_level
    out = alarms.where(alarm_predicate(params))
    if times:
        out = in_time_ranges(out, "timeissued", times)
    if levels:
        out = out.where(_whole(F.col("level1"), levels))
    if order:
        out = ticket_echo_dedupe(out, order)
    both = F.coalesce("id2", F.lit("")) != ""
    if selected is None:
        keyed = closure.where(F.col("level2") == out_level).select(
            F.col("level1").alias("level"), F.col("id1").alias("id"), F.col("level2").alias("ilevel"),
            F.col("id2").alias("iid"), F.lit(PRIMARY).alias("iclass"),
        )
    else:
        actual = selected.select(F.col("level").alias("level1"), F.col("id").alias("id1")).distinct()
        out = out.join(_many(actual), ["level1", "id1"], "left_semi")
        keyed = rekey(closure, selected, out_level, secondary_level)
    one = keyed.withColumnsRenamed({c: f"{c}1" for c in keyed.columns})
    two = keyed.withColumnsRenamed({c: f"{c}2" for c in keyed.columns})
    out = out.join(_many(one), ["level1", "id1"]).join(_many(two), ["level2", "id2"], "left")
    shown = ~both | (F.col("iid2").isNotNull() & ((F.col("iclass1") == PRIMARY) | (F.col("iclass2") == PRIMARY)))
    keys = ["ilevel1", "iid1", "iclass1", "ilevel2", "iid2", "iclass2"]
    return out.where(shown).withColumn("iclass2", F.coalesce("iclass2", F.lit(0))).select(*alarms.columns, *keys)


def query_alarms_by_asset(assets: DataFrame, alarms: DataFrame, closure: DataFrame, out_level: str, **query) -> DataFrame:
    """Driven from a list of assets (level, id): their alarms, found before anything else."""
    wanted = assets.select(F.col("level").alias("level1"), F.col("id").alias("id1")).distinct()
    return query_alarms(alarms.join(_many(wanted), ["level1", "id1"], "left_semi"), closure, out_level, **query)


def query_unknown(df: DataFrame, inventory: DataFrame, level: str = "level", id_: str = "id") -> DataFrame:
    """Rows whose asset is not in the inventory, keyed to UNKNOWN."""
    inv = inventory.select(F.col("level").alias("__l"), F.col("id").alias("__i")).distinct()
    out = df.join(inv, (df[level] == F.col("__l")) & (df[id_] == F.col("__i")), "left_anti")
    return out.withColumn("iid", F.lit(UNKNOWN))


def query_unknown_alarms(alarms: DataFrame, inventory: DataFrame) -> DataFrame:
    """Alarms of assets that are not in the inventory; service updates are no asset's and left out."""
    own = alarms.where(F.coalesce("id1", F.lit("")) != SERVICE_UPDATE)
    return query_unknown(own, inventory, "level1", "id1")


def query_inventory(
    selected: DataFrame, edges: DataFrame | None, attrs: DataFrame, keys: Sequence[str], hide: Sequence[str] = ()
) -> DataFrame:
    """Selected assets with chosen attributes as columns, secret ones left out.

    With ``edges`` also the number of edges per asset.
    """
    shown = [k for k in keys if k not in hide]
    wide = attrs.where(F.col("key").isin(shown)).groupBy("level", "id").agg(
        *[F.min(F.when(F.col("key") == k, F.col("val"))).alias(k) for k in shown]
    )
    out = selected.join(wide, ["level", "id"], "left")
    if edges is not None:
        ends = edges.select(F.col("level1").alias("level"), F.col("id1").alias("id")).unionByName(
            edges.select(F.col("level2").alias("level"), F.col("id2").alias("id"))
        )
        n = ends.groupBy("level", "id").agg(F.count(F.lit(1)).alias("edges"))
        out = out.join(n, ["level", "id"], "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return out


def alarm_table(alarms: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """One row per group: its most recent alarm and how many there are."""
    rest = [c for c in alarms.columns if c not in group]
    g = alarms.groupBy(*group).agg(
        F.max_by(F.struct(*rest), F.struct("timeissued", order)).alias("__r"), F.count(F.lit(1)).alias("groupcount")
    )
    return g.select(*group, "__r.*", "groupcount").orderBy(F.col("severity"), F.col("timeissued").desc(), order)


def stat_table(stats: DataFrame, frames: Sequence[int], by: Sequence[str] = ("level", "id", "key")) -> DataFrame:
    """Metric x frame table per asset."""
    return (
        stats.groupBy(*by)
        .pivot("frame", list(frames))
        .agg(F.avg("val"))
        .withColumnsRenamed({str(f): f"f{f}" for f in frames})
        .orderBy(*by)
    )


def rule_email_match(
    alarms: DataFrame, rules: Sequence[Mapping[str, str]], account_assets: DataFrame
) -> DataFrame:
    """Notification rows: (alarm, account, address) for every rule that matches.

    A rule names an account, an address and optional patterns for text, alarm id,
    severity and ticket mode. ``account_assets``: (account, level, id) an account may
    see. Rules are configuration and become columns; nothing is sent.
    """
    hits = []
    for r in rules:
        p = F.lit(True)
        for field in ("text", "alarmid"):
            if r.get(field):
                p = p & _whole(F.col(field), r[field])
        p = p & alarm_predicate([(k, r[k]) for k in ("severity", "ticket") if r.get(k)])
        hits.append(
            F.when(truth(p), F.struct(F.lit(r["account"]).alias("account"), F.lit(r["address"]).alias("address")))
        )
    one = F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("__h")
    out = alarms.select("*", one).select(*alarms.columns, "__h.account", "__h.address")
    see = account_assets.select("account", F.col("level").alias("level1"), F.col("id").alias("id1")).distinct()
    return out.join(see, ["account", "level1", "id1"], "left_semi")


def hide_attributes(df: DataFrame, key: str, secrets: str) -> DataFrame:
    """Leave out rows of secret attributes (a pattern on the key)."""
    return df.where(~truth(_whole(F.col(key), secrets)))
