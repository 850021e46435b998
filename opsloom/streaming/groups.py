"""Correlation groups as typed state: one processor finds the groups that a clear may reach, one steps them.

A clear names an object, everything, or a group; it does not say which groups hold alarms that fit. The first
processor therefore keeps, per object (and, for clears of everything, per one of ``SHARDS`` parts of all groups), the
groups that its alarms went to, and passes a clear on to those. The second keeps a group: its seconds, if they are many in blocks of
typed arrays, so that a batch writes only the blocks it changed; what waits for the clock; and one timer.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .correlate import GROUP_EVENTS, Clear, CorrelationRule, GroupMemory, Window, by_second, step_group

SHARDS = 64  # parts of all groups that a clear of everything is sent to
BLOCK = 1024  # seconds of a block of a window
FEW = 64  # a window of so many seconds is kept with its group, not in blocks
APART, NEXT = "\x1f", "\x1e"  # between an object and an alarm id; between such pairs

#: What comes out of the tasks of a batch: alarms of a group and second, names (which group an object's alarms went to), clears.
KEYED = (
    "kind string, rule string, group string, timeissued bigint, state int, seq bigint, severity int, step int, n bigint, lead bigint, "
    "settings string, who string, slot string, until bigint, mode string, id1 string, alarmid string, at bigint, opened bigint"
)
EVENTS = GROUP_EVENTS + ", ccid string"
MESSAGE = (
    "rule string, gid string, kind string, t bigint, group string, seq bigint, severity int, step int, state int, n bigint, lead bigint, "
    "settings string, who string, mode string, id1 string, alarmid string, at bigint, opened bigint, ts timestamp"
)


_TEXT = [c.split()[0] for c in KEYED.split(", ") if c.endswith(" string")]


def typed_state(spark: SparkSession) -> None:
    """Typed state lives in RocksDB, with a log of changes per batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def group_id(group: Column) -> Column:
    return F.md5(group)


def ccid_of(rule: str, gid: str, opened: int) -> str:
    """The name of a group from its first alarm on: rule, key and the second in which it opened."""
    return f"{rule}:{gid}:{opened}"


def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add up the alarms of one group and second within a batch of a task, and the names of one object and group.

    Done before the shuffle, so a group or object that receives a third of all alarms brings one row per
    second (or one row) and batch to its task. Rows of no rule only move the clock: the latest of them will do.
    """
    cols = [c.split()[0] for c in KEYED.split(", ")]
    keys = ["rule", "group", "timeissued"]
    for pdf in batches:
        # the row of a name has its first second, the clock needs the last one
        idle = pdf[pdf["kind"].isna() | (pdf["kind"] == "name")]
        if len(idle):
            latest = idle.nlargest(1, "timeissued").reset_index(drop=True)
            yield _columns(latest if latest["kind"].isna()[0] else latest[["timeissued"]], cols)
        clears = pdf[pdf["kind"] == "clear"]
        if len(clears):
            yield _columns(clears, cols)
        names = pdf[pdf["kind"] == "name"]
        if len(names):
            by = ["slot", "rule", "group"]
            ends = names.groupby(by, as_index=False).agg(timeissued=("timeissued", "min"), until=("until", "max"), at=("timeissued", "max"))
            parts = names[names["slot"].map(is_part)].drop_duplicates([*by, "timeissued"])
            seconds = parts["timeissued"].astype("int64").astype(str).groupby([parts[c] for c in by]).agg(NEXT.join)
            ends = ends.merge(seconds.rename("who").reset_index(), on=by, how="left") if len(parts) else ends
            yield _columns(ends.assign(kind="name"), cols)
        part = pdf[pdf["kind"] == "alarm"]
        if len(part):
            many = part.duplicated(keys, keep=False)
            if not many.all():
                yield _columns(part[~many], cols)
            part = part[many]
        if len(part):
            first = part.sort_values("lead").groupby(keys, sort=False, as_index=False).agg(lead=("lead", "first"), settings=("settings", "first"))
            g = part.sort_values(["severity", "seq"]).groupby(keys, sort=False, as_index=False)
            sums = g.agg(
                state=("state", "max"), seq=("seq", "first"), severity=("severity", "first"), step=("step", "sum"), n=("n", "sum"),
                who=("who", lambda lists: NEXT.join(sorted({x for one in lists if one for x in one.split(NEXT)}))),
            )
            yield _columns(sums.merge(first, on=keys).assign(kind="alarm"), cols)


def _columns(df: pd.DataFrame, cols: list[str]) -> pd.DataFrame:
    """The columns in order, absent ones null; text as plain objects, as numbers of an absent column are no text."""
    return df.reindex(columns=cols).astype({c: object for c in _TEXT})


class Names(StatefulProcessor):
    """Per slot (an object, or a part of all groups): the groups it is in, and clears that the clock has not passed.

    The rows of a batch are added up first, so a group costs one read and one write of the state per batch. A clear of everything ends
    what is open, so the next one changes nothing in a group without an alarm in between: only the first such clear at or after each second
    with alarms is passed on. For that a part of all groups keeps the seconds of a group that no clear has reached for
    good, and the last clear that the clock has passed.
    """

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "rule string, gid string", "until bigint, seconds array<bigint>")
        self.slot = handle.getValueState("slot", "kept string, due bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        kept, due = self._slot()
        clears: list[tuple] = []
        new: dict[tuple, list] = {}  # group: until, its first second here, its seconds
        for r in rows:
            if r.kind == "clear":
                clears.append((r.timeissued, r.mode, r.id1, r.alarmid, r.at))
                continue
            one = new.setdefault((r.rule, r.gid), [r.until, r.timeissued, set()])
            one[0], one[1] = max(one[0], r.until), min(one[1], r.timeissued)
            if r.who:
                one[2].update(int(t) for t in r.who.split(NEXT))
        whole = is_part(key[0])
        if clears:
            known = {tuple(n): tuple(v) for n, v in self.names.iterator()}
        else:
            known = {n: tuple(v) for n in new if (v := self.names.getValue(n))}
        if whole:
            yield from self._first_clears(known, new, kept, clears, now)
        else:
            for name, (until, first, _) in new.items():
                old = known.get(name)
                if old is None or until > old[0]:
                    self.names.updateValue(name, (until, []))
                # an alarm that comes after a clear, but is not later, is cleared too
                yield from (self._message(name, c, now) for c in kept if c[0] >= first)
            yield from (self._message(n, c, now) for c in clears for n in {**known, **new})
        still = _not_passed([*kept, *clears], now, whole)
        self._wake(kept, still, due, due, [one[0] for one in new.values()], now)

    def _first_clears(self, known: dict, new: dict, kept: list[tuple], clears: list[tuple], now: int) -> Iterator[Row]:
        """Pass a clear of everything on to each group that has a second for which it is the first one; keep the seconds that still wait."""
        before = sorted({c[0]: c for c in kept}.items())
        after = sorted({c[0]: c for c in (*kept, *clears)}.items())
        at_before, at_after = [t for t, _ in before], [t for t, _ in after]
        passed = max((t for t in at_after if t * 1000 < now), default=None)
        for name in (known.keys() | new.keys()) if clears else new.keys():
            until, waits = known.get(name, (0, []))
            until = max(until, new[name][0]) if name in new else until
            waits = set(waits)
            seconds = waits | new[name][2] if name in new else waits
            sent = {bisect_left(at_before, s) for s in waits}
            sent = {at_before[i] for i in sent if i < len(at_before)}
            reach = {bisect_left(at_after, s) for s in seconds}
            for i in sorted(reach):
                if i < len(after) and at_after[i] not in sent:
                    yield self._message(name, after[i][1], now)
            left = _waiting_seconds(seconds, passed, now)
            if left:
                if (until, sorted(waits)) != (known.get(name, (None,))[0], left):
                    self.names.updateValue(name, (until, left))
            elif name in known:
                self.names.removeKey(name)

    def _message(self, name: tuple, clear: Sequence, now: int) -> Row:
        t, mode, id1, alarmid, at = clear
        # a row must not be older than the clock; its own time is t
        ts = pd.Timestamp(max(t * 1000, now), unit="ms").to_pydatetime()
        return Row(
            rule=name[0], gid=name[1], kind="clear", t=t, group=None, seq=None, severity=None, step=None, state=None, n=None, lead=None,
            settings=None, who=None, mode=mode, id1=id1, alarmid=alarmid, at=at, opened=None, ts=ts,
        )

    def _slot(self) -> tuple[list[tuple], int | None]:
        saved = self.slot.get()
        return ([tuple(c) for c in json.loads(saved[0])], saved[1]) if saved else ([], None)

    def _wake(self, kept: list[tuple], still: list[tuple], stored: int | None, old: int | None, until: list[int], now: int) -> None:
        """One timer per slot, at the earliest time that something in it is over; ``old`` is the one that is set, ``stored`` what the state says."""
        times = [*until, *(c[0] for c in still if c[0] * 1000 >= now)]
        due = min((max((t + 1) * 1000, now + 1) for t in times), default=None)
        if due is None or old is not None and old <= due:
            due = old
        elif old is not None:
            self.handle.deleteTimer(old)
        if due != old:
            self.handle.registerTimer(due)
        if still != kept or due != stored:
            self.slot.update((json.dumps(still), due)) if still or due is not None else self.slot.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        kept, due = self._slot()
        whole = is_part(key[0])
        still = _not_passed(kept, now, whole)
        passed = max((c[0] for c in still if c[0] * 1000 < now), default=None)
        left = []
        for name, value in [(tuple(n), tuple(v)) for n, v in self.names.iterator()]:
            until, seconds = value
            waits = _waiting_seconds(seconds, passed, now) if whole else seconds
            if until * 1000 < now or whole and not waits:
                self.names.removeKey(name)
                continue
            left.append(until)
            if waits != seconds:
                self.names.updateValue(name, (until, waits))
        self._wake(kept, still, due, None, left, now)
        return iter(())

    def close(self) -> None:
        pass


def is_part(slot: str) -> bool:
    """Whether a slot is a part of all groups."""
    return slot.startswith("all:")


def _not_passed(clears: list[tuple], now: int, whole: bool) -> list[tuple]:
    """Clears that the clock has not passed; for a part of all groups one per second, and the last one that it has passed."""
    still = [c for c in clears if c[0] * 1000 >= now]
    if whole:
        over = [c for c in clears if c[0] * 1000 < now]
        still = [c for _, c in sorted({c[0]: c for c in (*sorted(over, key=lambda c: c[0])[-1:], *still)}.items())]
    return still


def _waiting_seconds(seconds: Iterable[int], passed: int | None, now: int) -> list[int]:
    """Seconds for which a clear that is yet to come may be the first: it is later than ``passed``, and not before the clock."""
    left = sorted(s for s in seconds if passed is None or s > passed)
    return left[max(bisect_left(left, now / 1000) - 1, 0) :]


def _pairs(who: str) -> list[tuple]:
    return [tuple(x.split(APART)) for x in who.split(NEXT)]


#: What waits for the clock, as JSON with its group: the state is asked once and written once per group and batch.
_WAITING = ["kind", "t", "seq", "severity", "step", "state", "n", "lead", "settings", "who", "mode", "id1", "alarmid", "at", "opened"]
_BLOCK = "times array<bigint>, steps array<bigint>, counts array<bigint>, severities array<int>, seqs array<bigint>, who array<string>"


class Groups(StatefulProcessor):
    """A group per key (rule, md5 of its JSON key)."""

    def __init__(self, rules: Mapping[str, CorrelationRule], heartbeat: int | None = None):
        self.rules = dict(rules)
        self.heartbeat = heartbeat

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.group = handle.getValueState(
            "group",
            "group string, open boolean, opened bigint, last bigint, ticket bigint, spent boolean, settings string, due bigint, few string, waiting string",
        )
        self.blocks = handle.getMapState("seconds", "block bigint", _BLOCK)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        yield from self._advance(key, list(rows), timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key: Any, rows: list[Row], timers: Any) -> Iterator[Row]:
        rule = self.rules.get(key[0])
        saved = self.group.get()
        group = saved[0] if saved else next((r.group for r in rows if r.group is not None), None)
        if rule is None or group is None:  # a rule that is gone, or a clear of a group that is not there
            return
        if self.heartbeat:
            clock = timers.getCurrentProcessingTimeInMs() // 1000
        else:
            clock = timers.getCurrentWatermarkInMs() // 1000
        waited = [tuple(w) for w in json.loads(saved[9])] if saved and saved[9] else []
        new = [tuple(r[c] for c in _WAITING) for r in rows]
        ready = [w for w in (*waited, *new) if self.heartbeat or w[1] <= clock]
        pending = [] if self.heartbeat else [w for w in (*waited, *new) if w[1] > clock]
        g, loaded = self._load(saved)
        alarms = [(t, seq, sev, step, state, n, lead, settings) for _, t, seq, sev, step, state, n, lead, settings, *_ in (w for w in ready if w[0] == "alarm")]
        who: dict[int, set] = {}
        for w in ready:
            if w[0] == "alarm" and w[9]:
                who.setdefault(w[1], set()).update(_pairs(w[9]))
        clears = [Clear(w[1], w[10], w[11] or "", w[12] or "", w[13] or 0, w[14] or 0) for w in ready if w[0] == "clear"]
        opened = g.opened
        for event, at, seq, sev, n in step_group(g, by_second(alarms), rule, clock, clears, who):
            of = g.opened if event != "clear" and g.open else opened
            yield Row(rule=key[0], group=group, event=event, at=at, seq=seq, severity=sev, n=n, ccid=ccid_of(key[0], key[1], of))
        self._save(group, g, loaded, {a[0] for a in alarms}, pending, saved, rule, clock, timers)

    def _load(self, saved: Any) -> tuple[GroupMemory, set[int]]:
        """The group, and which blocks the store has."""
        if not saved or not saved[1]:
            return GroupMemory(), set()
        _, open_, opened, last, ticket, spent, settings, _, few, _ = saved
        seconds, who, loaded = [], [], set()
        for block, value in [(None, json.loads(few))] if few else ((b, v) for (b,), v in self.blocks.iterator()):
            if block is not None:
                loaded.add(block)
            times, steps, counts, severities, seqs, names = value
            seconds += zip(times, steps, counts, severities, seqs)
            who += [(t, _pairs(ns)) for t, ns in zip(times, names) if ns]
        g = GroupMemory(open_, opened, last, ticket, spent, Window(seconds), json.loads(settings) if settings else {})
        for t, ns in sorted(who):
            g.note(t, ns)
        return g, loaded

    def _save(
        self, group: str, g: GroupMemory, loaded: set[int], touched: Iterable[int], pending: list, saved: Any,
        rule: CorrelationRule, clock: int, timers: Any,
    ) -> None:
        old_due = saved[7] if saved else None
        few = None
        if not g.open or len(g.window) <= FEW:
            if loaded:
                self.blocks.clear()
            if g.open:
                few = json.dumps(_columns_of(g, g.recent))
        else:
            fresh = not (saved and saved[1] and saved[2] == g.opened)
            changed = {t // BLOCK for t in touched}
            now: dict[int, list] = {}
            for r in g.recent:
                now.setdefault(r[0] // BLOCK, []).append(r)
            for block in loaded - now.keys():
                self.blocks.removeKey((block,))
            first = min(now)
            for block, part in now.items():
                if fresh or block in changed or block not in loaded or block == first:
                    self.blocks.updateValue((block,), _columns_of(g, part))
        due = None
        if self.heartbeat:
            if g.open:
                due = timers.getCurrentProcessingTimeInMs() + self.heartbeat * 1000
        elif g.open or pending:
            times = [w[1] for w in pending] + ([g.next_due(rule)] if g.open else [])
            # a timer fires once the watermark is past it
            due = max(min(times), clock + 1) * 1000 - 1
        if due != old_due:
            if old_due is not None:
                self.handle.deleteTimer(old_due)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            if saved:
                self.group.clear()
            return
        settings = json.dumps(g.settings) if g.settings else None
        waiting = json.dumps(pending) if pending else None
        self.group.update((group, g.open, g.opened, g.last, g.ticket, g.spent, settings, due, few, waiting))


def _columns_of(g: GroupMemory, part: list[list]) -> tuple:
    """Seconds by column, with their names."""
    times, steps, counts, severities, seqs = (list(c) for c in zip(*part))
    seen: set[int] = set()  # names are kept with one row of a second
    who = ["" if t in seen or seen.add(t) else NEXT.join(sorted(APART.join(n) for n in g.who.get(t, ()))) for t in times]
    return times, steps, counts, severities, seqs, who


def clear_rows(kind: str, shards: int = SHARDS) -> Column:
    """Slots that a clear is sent to: its object's, those of all groups, or none if it names a group."""
    return (
        F.when(F.col(kind) == "all", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.concat(F.lit("all:"), i.cast("string"))))
        .when(F.col(kind).isin("o", "i", "a"), F.array(F.concat(F.lit("o:"), F.col("id1"))))
        .when(F.col(kind) == "c", F.array(F.lit(None).cast("string")))
    )


def step_groups(messages: DataFrame, rules: Mapping[str, CorrelationRule], heartbeat: int | None) -> DataFrame:
    return messages.groupBy("rule", "gid").transformWithState(Groups(rules, heartbeat), EVENTS, "Append", "ProcessingTime" if heartbeat else "EventTime")
