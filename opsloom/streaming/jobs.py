"""Structured Streaming forms of ingest, roll-up, profile alarms and correlation."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.alarms import clear_key
from ..operators.graph import ImpactGraph, graph_impacts, impact_changes, impact_graph
from ..operators.profile_alarms import CHANGE_COLUMNS, CHANGES, SeriesState, prune, step_series, worse
from ..model import ALARM_MODE
from ..operators.stats import SERIES, Catalogue, ProfileRule, mode_of
from ..session import scratch, stored
from .correlate import UP, CorrelationRule
from .groups import APART, KEYED, MESSAGE, SHARDS, Names, clear_rows, combine, group_id, step_groups, typed_state

BatchSink = Callable[[DataFrame, int], None]


def stream_tail(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Follow a folder of immutable files; each file is read once per checkpoint."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def catch_up(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"
) -> None:
    """Process everything that is there and stop; the next call goes on from here."""
    df.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def until_idle(query: StreamingQuery, idle: float, poll: float = 0.5) -> int:
    """Let a running query go on until ``idle`` seconds pass without a row, then stop it; how many rows it read.

    A batch that is at work, however long, is not idle. The checkpoint stays, so the next query goes on from there.
    An error of the query is raised.
    """
    rows, last, since = 0, -1, time.monotonic()
    while not query.awaitTermination(poll):
        fresh = [p for p in query.recentProgress if p["batchId"] > last]
        if fresh:
            last = fresh[-1]["batchId"]
            rows += sum(p["numInputRows"] for p in fresh)
        status = query.status
        if status["isTriggerActive"] or status["isDataAvailable"] or any(p["numInputRows"] for p in fresh):
            since = time.monotonic()
        elif time.monotonic() - since >= idle:
            query.stop()
            break
    return rows


def follow(df: DataFrame, path: str, checkpoint: str, idle: float, every: str = "1 second", fmt: str = "parquet") -> int:
    """Write what comes until nothing came for ``idle`` seconds."""
    query = df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    return until_idle(query, idle)


def catch_up_batches(df: DataFrame, sink: BatchSink, checkpoint: str, mode: str = "append") -> None:
    """The same with a function per micro-batch."""
    df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def tee(df: DataFrame, sinks: Sequence[BatchSink], checkpoint: str) -> StreamingQuery:
    """Every micro-batch to several sinks, computed once."""

    def run(batch: DataFrame, epoch: int) -> None:
        with scratch(batch.sparkSession):
            kept = stored(batch, "tee")
            for s in sinks:
                s(kept, epoch)

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def event_time(df: DataFrame, delay: str, time: str = "timeissued") -> DataFrame:
    """The progress clock: the newest time seen, less ``delay``."""
    return df.withColumn("ts", F.timestamp_seconds(time)).withWatermark("ts", delay)


def tumbling_stats(
    df: DataFrame, catalogue: Catalogue, width: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Points to one value per (series, window), by the metric's mode."""
    mode = mode_of(F.col("key"), catalogue)
    val = F.col("val")
    return (
        event_time(df, delay)
        .groupBy(F.window("ts", width), *SERIES)
        .agg(
            F.when(mode == "sum", F.sum(val)).when(mode == "min", F.min(val)).when(mode == "max", F.max(val))
            .otherwise(F.avg(val)).alias("val"),
            F.count(val).alias("n"),
        )
        .select(F.unix_timestamp(F.col("window.start")).alias("timeissued"), *SERIES, "val", "n")
    )


def split_late(batch: DataFrame, watermark: int, on_time: Callable[[DataFrame], None], late: Callable[[DataFrame], None]) -> None:
    """Rows at or past the watermark go on, older ones to the side table."""
    on_time(batch.where(F.col("timeissued") >= watermark))
    late(batch.where(F.col("timeissued") < watermark))


# --- profile alarms --------------------------------------------------------------------


def worst_samples(matched: DataFrame) -> DataFrame:
    """One sample per series and time of a batch in each task: the worst severity, then the largest score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _worst(pdf)

    return matched.select(*SERIES, "timeissued", "sev", "score").mapInPandas(run, SAMPLES)


SAMPLES = "level string, id string, key string, timeissued bigint, sev int, score double"


def _worst(pdf: pd.DataFrame) -> pd.DataFrame:
    rank = pdf["sev"].where(pdf["sev"] != -1, 99)
    ordered = pdf.assign(__r=rank).sort_values(["__r", "score"], ascending=[True, False])
    return ordered.drop_duplicates([*SERIES, "timeissued"]).drop(columns="__r")


#: Parts that all keys of a stream are dealt over; the keys of a part are one state.
STATE_PARTS = 4096


def _part(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(STATE_PARTS))


def profile_alarms(matched: DataFrame, rule: ProfileRule, delay: str = "0 seconds", keep: int = 14 * 86_400) -> DataFrame:
    """The deviation-alarm state machine over a stream.

    ``matched``: streaming ``range_rule_match`` output (a stream-static join with
    the profile). Samples of one time are merged, as in batch, in the tasks and in the series;
    a series looks at a time when the event time, less ``delay``, has reached it. State per
    series is the samples within the rule horizon, those that wait, the current alarm
    and where each range counts from. A series without samples for ``keep`` seconds is forgotten.

    A call of Python costs more than the samples of a series do, so series are stepped by the
    part they fall in: a batch takes one call, and one value of state, for each of ``STATE_PARTS`` at most.
    """

    def due(memory: SeriesState) -> int:
        """The time at which a series is looked at without new samples."""
        return memory.pending[0][0] if memory.pending else _latest(memory) + keep

    def step(memory: SeriesState, fresh: list[tuple], clock: int) -> list[tuple]:
        one: dict[int, tuple] = {}
        for t, sev, score in [*map(tuple, memory.pending), *fresh]:
            if t not in one or worse((sev, score)) < worse(one[t][1:]):
                one[t] = (t, sev, score)
        memory.samples = [tuple(s) for s in memory.samples]
        memory.pending = sorted(s for s in one.values() if s[0] > clock)
        ready = sorted(s for s in one.values() if s[0] <= clock)
        out = step_series(memory, ready, rule, max([s[0] for s in ready], default=0))
        prune(memory, rule)
        return out

    def run(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {tuple(name): SeriesState(**kept) for name, kept in json.loads(state.get[0])} if state.exists else {}
        clock = state.getCurrentWatermarkMs() // 1000
        fresh: dict[tuple, list[tuple]] = {}
        if not state.hasTimedOut:
            for pdf in pdfs:
                samples = zip(pdf["timeissued"].astype(int).tolist(), pdf["sev"].astype(int).tolist(), pdf["score"].tolist())
                for name, sample in zip(zip(*[pdf[c].tolist() for c in SERIES]), samples):
                    fresh.setdefault(name, []).append(sample)
        out = []
        for name in [*fresh, *(n for n, m in known.items() if n not in fresh and due(m) <= clock)]:
            memory = known.setdefault(name, SeriesState())
            out += [(*name, *r) for r in step(memory, fresh.get(name, []), clock)]
            if not memory.pending and due(memory) <= clock:
                del known[name]
        if known:
            state.update((json.dumps([(name, vars(memory)) for name, memory in known.items()]),))
            # a timer fires once the watermark is past it
            state.setTimeoutTimestamp(max(min(map(due, known.values())), clock + 1) * 1000 - 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=CHANGE_COLUMNS)

    timed = event_time(worst_samples(matched), delay).withColumn("part", _part(*SERIES))
    return timed.groupBy("part").applyInPandasWithState(run, CHANGES, "memory string", "append", GroupStateTimeout.EventTimeTimeout)


def _latest(memory: SeriesState) -> int:
    return max([s[0] for s in memory.samples + memory.pending], default=0)


# --- correlation ------------------------------------------------------------------------


def correlate(
    alarms: DataFrame, rules: Sequence[CorrelationRule], delay: str = "0 seconds", heartbeat: int | None = None,
    clears: str | None = None, keep: int = 129_600,
) -> DataFrame:
    """Rule-driven correlation: one group of alarms per (rule, key).

    An alarm joins every rule whose predicate it meets. A group looks at a second when the
    event time, less ``delay``, has reached it, so alarms that arrive in any order within
    ``delay`` give the same tickets; later ones join late. Groups time out as the event time
    moves on. With ``heartbeat`` (seconds) alarms are looked at as they come, and
    groups time out on processing time, that often, also when no data arrives.

    ``clears`` is a predicate: rows that meet it are no alarms but clears (columns id1, alarmid, ccid,
    timecleared), of everything, a ccid, object and alarm id, object and the time of an alarm, or an object, in
    the precedence of ``alarms.clear_key``. A clear ends every open group that holds, within its window, an alarm
    that fits and is not later, with an event "clear"; clears and alarms may arrive in any order within
    ``delay``. ``keep``: how long after an alarm its object is known to be in the group; give the
    longest window, if that is longer. Clears need event time, so not with ``heartbeat``.
    """
    if heartbeat and clears:
        raise ValueError("clears are looked at in event time: give either heartbeat or clears")
    typed_state(alarms.sparkSession)
    is_clear = F.coalesce(F.expr(clears), F.lit(False)) if clears else F.lit(False)
    hits = [
        F.when(
            F.coalesce(F.expr(r.match), F.lit(False)) & ~is_clear,
            F.struct(
                F.lit(r.id).alias("rule"), F.to_json(F.struct(*r.keys)).alias("group"), F.expr(r.step).cast("int").alias("step"),
                _settings(r).alias("settings"),
            ),
        )
        for r in rules
    ]
    names = F.concat_ws(APART, F.coalesce("id1", F.lit("")), F.coalesce("alarmid", F.lit(""))) if clears else F.lit("")
    one = F.explode_outer(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")
    out = alarms.select("*", one).select(
        F.when(F.col("h").isNotNull(), "alarm").alias("kind"), F.col("h.rule").alias("rule"), F.col("h.group").alias("group"),
        "timeissued", "state", "seq", "severity", F.col("h.step").alias("step"), F.lit(1).cast("bigint").alias("n"),
        F.col("seq").alias("lead"), F.col("h.settings").alias("settings"), names.alias("who"),
    )
    if clears:
        objects = F.coalesce("id1", F.lit(""))
        shard = F.pmod(F.xxhash64("h.rule", "h.group"), F.lit(SHARDS)).cast("string")
        slots = F.array(F.concat(F.lit("o:"), objects), F.concat(F.lit("all:"), shard))
        known = alarms.select("*", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select(
            F.lit("name").alias("kind"), F.col("h.rule").alias("rule"), F.col("h.group").alias("group"), "timeissued",
            F.explode(slots).alias("slot"), (F.col("timeissued") + keep).cast("bigint").alias("until"),
        )
        key = clear_key()
        named = F.regexp_extract("ccid", "^(.*):([0-9a-f]{32}):([0-9]+)$", 1)
        asked = alarms.where(is_clear).withColumn("__mode", key["kind"]).where("__mode is not null")
        asked = asked.select("*", F.explode(clear_rows("__mode")).alias("slot")).select(
            F.lit("clear").alias("kind"), F.when(F.col("__mode") == "c", named).alias("rule"),
            F.when(F.col("__mode") == "c", F.regexp_extract("ccid", "^(.*):([0-9a-f]{32}):([0-9]+)$", 2)).alias("group"), "timeissued", "slot",
            F.col("__mode").alias("mode"), "id1", "alarmid", F.col("timecleared").cast("bigint").alias("at"),
            F.when(F.col("__mode") == "c", F.regexp_extract("ccid", "^(.*):([0-9a-f]{32}):([0-9]+)$", 3)).try_cast("bigint").alias("opened"),
        )
    kinds = dict(c.split(None, 1) for c in KEYED.split(", "))

    def combined(df: DataFrame) -> DataFrame:
        df = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        return event_time(df.mapInPandas(combine, KEYED), delay)

    # the groups need no names, and the names no alarms; the clock meets every time in both
    keyed = combined(out.unionByName(asked, allowMissingColumns=True) if clears else out)
    gid = F.when(F.col("kind") == "clear", F.col("group")).otherwise(group_id(F.col("group"))).alias("gid")
    columns = [c.split()[0] for c in MESSAGE.split(", ")]
    # conditions name the event time, so that Spark cannot move them below the clock, which every row must reach
    direct = keyed.where("kind = 'alarm' or (kind = 'clear' and mode = 'c') or ts is null").select("*", gid, F.col("timeissued").alias("t"))
    direct = direct.withColumn("group", F.when(F.col("kind") == "alarm", F.col("group"))).select(*columns)
    if clears:
        idle = out.where("kind is null").select("timeissued")
        slots = combined(known.unionByName(asked, allowMissingColumns=True).unionByName(idle, allowMissingColumns=True))
        slots = slots.where("slot is not null or ts is null").select("slot", "kind", "rule", gid, "timeissued", "until", "who", "mode", "id1", "alarmid", "at", "ts").groupBy("slot")
        passed = slots.transformWithState(Names(), MESSAGE, "Append", "EventTime", eventTimeColumnName="ts")
        direct = direct.unionByName(passed)
    return step_groups(direct, {r.id: r for r in rules}, heartbeat)


def defer_flags(alarms: DataFrame, rules: Sequence[CorrelationRule]) -> DataFrame:
    """Alarms with the ticket mode "defer" in place of "keep" if a group takes them; others are ticketed at once.

    A group takes every alarm that meets its rule, opening one if need be, apart from an up that ends it. That is known from the
    alarm and the rules alone, so it needs no state: every alarm leaves once, in the batch in which it came.
    """
    taken = F.lit(False)
    for r in rules:
        fits = F.coalesce(F.expr(r.match), F.lit(False))
        taken = taken | (fits & (F.coalesce("state", F.lit(0)) != UP) if r.closes_on_up else fits)
    keep, defer = F.lit(ALARM_MODE["keep"]), F.lit(ALARM_MODE["defer"])
    return alarms.withColumn("tmode", F.when(taken & (F.col("tmode") == keep), defer).otherwise(F.col("tmode")))


def _settings(rule: CorrelationRule) -> Column:
    """What an alarm would give a group that it opens, as JSON; missing values count as 0."""
    given = [F.coalesce(F.expr(e).cast("bigint"), F.lit(0)).alias(n) for n, e in rule.from_alarm.items()]
    return F.to_json(F.struct(*given)) if given else F.lit(None).cast("string")


# --- service impact -----------------------------------------------------------------------

RAISED, CLEARED, AGED = 1, 2, 3


class Aging(StatefulProcessor):
    """The open events of the nodes of a part, and a timer for the oldest of them."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "due bigint, nodes array<struct<level: string, id: string, at: bigint>>")

    def _load(self) -> tuple[int | None, dict[tuple, int]]:
        if not self.open.exists():
            return None, {}
        due, nodes = self.open.get()
        return due, {(n[0], n[1]): n[2] for n in nodes}

    def _save(self, was: int | None, nodes: dict[tuple, int]) -> None:
        """``was``: the time of the timer that is set, if one is."""
        due = (min(nodes.values()) + self.keep) * 1000 if nodes else None
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        if nodes:
            self.open.update((due, [(*node, at) for node, at in nodes.items()]))
        elif self.open.exists():
            self.open.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        latest: dict[tuple, tuple] = {}
        for r in rows:
            node, event = (r.level, r.id), (r.at, -r.type)
            if node not in latest or event > latest[node]:
                latest[node] = event
        due, nodes = self._load()
        for node, (t, kind) in latest.items():
            nodes.pop(node, None)
            if kind == -RAISED:
                nodes[node] = t
        self._save(due, nodes)
        for (level, id_), (t, kind) in latest.items():
            yield Row(level=level, id=id_, type=-kind, at=t)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        due, nodes = self._load()
        old = {node: at for node, at in nodes.items() if (at + self.keep) * 1000 < now}
        # the timer that brought this call goes by itself
        fired = expiredTimerInfo.getExpiryTimeInMs()
        self._save(None if due == fired else due, {node: at for node, at in nodes.items() if node not in old})
        for (level, id_), t in old.items():
            yield Row(level=level, id=id_, type=AGED, at=t)

    def close(self) -> None:
        pass


def aging_events(events: DataFrame, keep: int, delay: str = "0 seconds", time: str = "timeissued") -> DataFrame:
    """Raises (type 1) and clears (type 2) of nodes, and a row of type 3 when an open event grows older than ``keep`` seconds.

    (level, id, type, at). An event ages by the event time less ``delay``, also in batches without data; a new raise of the
    node starts its age anew, a clear ends it. Of several events of a node in a batch the latest counts, a clear before a
    raise of the same time. Rows of other types only move the clock. Nodes are dealt over
    ``STATE_PARTS`` parts: the open events of a part are one typed value of state, with one timer, so a batch makes as many calls
    of Python at most, not one or more for each node.
    """
    typed_state(events.sparkSession)
    timed = event_time(events.select("level", "id", F.col("type").cast("int").alias("type"), F.col(time).cast("bigint").alias("at")), delay, "at")
    # the condition names the event time, so that Spark cannot move it below the clock
    return timed.where("type in (1, 2) or ts is null").withColumn("part", _part("level", "id")).groupBy("part").transformWithState(
        Aging(keep), "level string, id string, type int, at bigint", "Append", "EventTime"
    )


def impact_batches(
    edges: DataFrame, roles: DataFrame, members: DataFrame, read_open: Callable[[int], DataFrame], emit: BatchSink,
    save_open: BatchSink, order: str = "timeissued",
) -> BatchSink:
    """A ``foreachBatch`` function: re-evaluate the touched components, emit changes.

    ``members`` is the stored ``connected_components`` of the inventory; only
    components with a node whose event came, went or aged in the batch are looked at. Of several events
    of a node in a batch the latest by ``order`` counts, a clear before a raise of the same time.
    Services are evaluated before the batch, with its raises and clears, and, if events aged (type 3, see
    ``aging_events``), once more without those: ``cause`` says whether a change is by an "event" or by "age".
    ``read_open`` gives the (level, id) that were open before an epoch, ``save_open`` gets
    those that are open after it; both must give the same again when an epoch is repeated.
    """
    known: list[ImpactGraph] = []

    def run(batch: DataFrame, epoch: int) -> None:
        if not known:
            # numbered once per job, for all its batches
            known.append(impact_graph(edges, roles, members, keep=True))
        with scratch(batch.sparkSession):
            given = stored(batch.select("level", "id", "type", F.col(order).alias("__t")), "impact-batch")
            said = given.where(F.col("type") != AGED).groupBy("level", "id").agg(F.max_by("type", F.struct("__t", -F.col("type"))).alias("type"))
            last = stored(said, "impact-last")
            aged = stored(given.where(F.col("type") == AGED).select("level", "id").distinct().join(last, ["level", "id"], "left_anti"), "impact-aged")
            moved = last.select("level", "id").unionByName(aged)
            touched = stored(known[0].nodes.join(moved, ["level", "id"], "left_semi").select("root").distinct(), "impact-touched")
            was_open = read_open(epoch).select("level", "id").distinct()
            now_open = was_open.join(last, ["level", "id"], "left_anti").unionByName(last.where(F.col("type") == RAISED).select("level", "id"))
            left_open = now_open = stored(now_open, "impact-open")
            states = [was_open, now_open]
            if not aged.isEmpty():
                left_open = now_open.join(aged, ["level", "id"], "left_anti")
                states.append(left_open)
            found = stored(graph_impacts(known[0].within(touched), states), "impact-states")
            before, after, *rest = [found.where(F.col("state") == i) for i in range(len(states))]
            changes = impact_changes(before, after).withColumn("cause", F.lit("event"))
            for later in rest:
                changes = changes.unionByName(impact_changes(after, later).withColumn("cause", F.lit("age")))
            emit(changes, epoch)
            save_open(left_open, epoch)

    return run


def epoch_path(path: str, epoch: int) -> str:
    return f"{path}/epoch={epoch:010d}"


def write_epoch(path: str) -> BatchSink:
    """A sink with a folder per epoch, replaced as a whole: a repeated batch writes the same again.

    ``spark.read.parquet(path)`` reads all epochs, with a column ``epoch``.
    """

    def run(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(epoch_path(path, epoch))

    return run


def read_before(spark: SparkSession, path: str, schema: T.StructType) -> Callable[[int], DataFrame]:
    """What the epoch before an epoch has written with ``write_epoch``; nothing before the first."""

    def run(epoch: int) -> DataFrame:
        if epoch == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(epoch_path(path, epoch - 1))

    return run
