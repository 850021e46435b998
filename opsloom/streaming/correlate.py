"""Correlation rules and the step of one alarm group.

A rule is data: predicates and steps are SQL expressions, the rest numbers, or SQL
expressions over the alarm that opens a group. ``step_group`` is the whole behaviour over
the alarms of one group; the stream calls it as its clock moves on, tests call it on lists.
Alarms of one second are looked at together.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, groupby

GROUP_EVENTS = "rule string, group string, event string, at bigint, seq bigint, severity int, n bigint"
UP, DOWN = 4, 3
SETTINGS = ("window", "immediate", "first_delay", "defer_count", "defer_time", "refresh")


@dataclass(frozen=True)
class CorrelationRule:
    """``match`` opens or joins a group of ``keys``; ``step`` is what an alarm adds.

    window: a later alarm joins only this many seconds after the last one, and an alarm
    leaves the group, and what it added, when it is older than that;
    immediate: ticket when the counter reaches it; first_delay: ticket this long
    after the first alarm; defer_count/defer_time: ticket when the counter is at
    least that and nothing came for that long (0: never); refresh: repeat the ticket
    (0: the group ends with its first ticket); closes_on_up: an up ends the group.
    A setting that is text is an expression over the alarm that opens the group.
    """

    id: str
    match: str
    keys: Sequence[str]
    step: str = "1"
    window: int | str = 1800
    immediate: int | str | None = None
    first_delay: int | str | None = None
    defer_count: int | str | None = None
    defer_time: int | str = 0
    refresh: int | str = 0
    closes_on_up: bool = False

    @property
    def from_alarm(self) -> dict[str, str]:
        """The settings that the opening alarm gives."""
        return {n: v for n in SETTINGS if isinstance(v := getattr(self, n), str)}


# The ids, alarm ids, attribute names and times of the three shipped behaviours:
# repeating alarms, up/down balance, up/down timeout.
GEN1 = CorrelationRule(
    "GEN1_ANY", "alarmid = 'any.1'", ("id1", "text"), window=1800, immediate=2, first_delay=300, refresh=7200
)
GEN2 = CorrelationRule(
    "GEN2_BALANCE", "`unique` <> ''", ("id1", "`unique`", "alarmid"),
    "CASE WHEN balancemode = 0 OR state = 3 THEN 1 WHEN state = 4 THEN -1 ELSE 0 END",
    window="matchwindow", immediate="ticketimmediatecount", defer_count="ticketdefercount", defer_time="ticketdefertime",
    refresh="ticketupdatetime",
)
IOT = CorrelationRule(
    "IOT_UPDOWN", "alarmid = 'IoT.1' AND state IN (3, 4)", ("id1", "alarmid"),
    window="matchwindow", defer_count=1, defer_time="ticketdefertime", refresh="ticketupdatetime", closes_on_up=True,
)


class Window:
    """The seconds of a group, oldest first: [time, step, count, severity, seq] with an aggregate over any latest part.

    A second is added at the end and old ones leave at the front in constant amortised time: steps and counts are
    running sums, and the representative comes from a stack of the seconds that are better than all after
    them. A second that is older than the last one is put in its place, and everything is summed up again.
    """

    def __init__(self, seconds: Iterable[Sequence] = ()):
        self.rows: list[list] = sorted(list(r) for r in seconds)
        self._sum()

    def _sum(self) -> None:
        self.first = 0
        self.times = [r[0] for r in self.rows]
        self.steps = [0, *accumulate(r[1] for r in self.rows)]
        self.counts = [0, *accumulate(r[2] for r in self.rows)]
        self.better: list[tuple] = []  # (time, severity, seq), the best of all from its time on
        for r in self.rows:
            self._rank(r)

    def _rank(self, r: Sequence) -> None:
        while self.better and (self.better[-1][1], -self.better[-1][0], self.better[-1][2]) >= (r[3], -r[0], r[4]):
            self.better.pop()
        self.better.append((r[0], r[3], r[4]))

    def __len__(self) -> int:
        return len(self.rows) - self.first

    def live(self) -> list[list]:
        return self.rows[self.first :]

    def add(self, row: Sequence) -> None:
        row = list(row)
        if self.rows and row < self.rows[-1]:
            self.drop(self.times[self.first] if len(self) else row[0], now=True)
            insort(self.rows, row)
            self._sum()
            return
        self.rows.append(row)
        self.times.append(row[0])
        self.steps.append(self.steps[-1] + row[1])
        self.counts.append(self.counts[-1] + row[2])
        self._rank(row)

    def drop(self, before: int, now: bool = False) -> None:
        """Seconds before a time leave."""
        self.first = bisect_left(self.times, before, self.first)
        if now or self.first > 64 and 2 * self.first > len(self.rows):
            lead = bisect_left(self.better, (before,))
            del self.rows[: self.first], self.times[: self.first], self.steps[: self.first], self.counts[: self.first], self.better[:lead]
            self.first = 0

    def counter(self, since: int) -> int:
        """The steps of all seconds from a time on."""
        return self.steps[-1] - self.steps[bisect_left(self.times, since, self.first)]

    def count(self, since: int) -> int:
        return self.counts[-1] - self.counts[bisect_left(self.times, since, self.first)]

    def best(self, since: int) -> tuple[int, int]:
        """(severity, seq) of the representative of all seconds from a time on: lowest severity, then latest, then lowest seq."""
        at = bisect_left(self.better, (max(since, self.times[self.first]),))
        return self.better[at][1:]


@dataclass
class GroupMemory:
    """An open group: its seconds, its ticket and settings, and which alarms were in which second."""

    open: bool = False
    opened: int = 0
    last: int = 0
    ticket: int = -1
    spent: bool = False
    window: Window = field(default_factory=Window)
    settings: dict = field(default_factory=dict)
    who: dict[int, set] = field(default_factory=dict)  # second: {(object, alarm id)}
    latest: dict[tuple, int] = field(default_factory=dict)  # (object, alarm id) and (object, None): its last second

    @property
    def recent(self) -> list[list]:
        return self.window.live()

    def get(self, rule: CorrelationRule, name: str):
        return self.settings[name] if name in self.settings else getattr(rule, name)

    def since(self, rule: CorrelationRule, at: int) -> int:
        """The oldest time that the window reaches back to."""
        return at - self.get(rule, "window")

    def counter(self, rule: CorrelationRule, at: int) -> int:
        return self.window.counter(self.since(rule, at))

    def note(self, t: int, names: Iterable[tuple]) -> None:
        """Remember who was in a second."""
        known = self.who.setdefault(t, set())
        for name in names:
            known.add(tuple(name))
            for key in (tuple(name), (name[0], None)):
                self.latest[key] = max(t, self.latest.get(key, t))

    def holds(self, rule: CorrelationRule, clear: Clear) -> bool:
        """Whether an alarm within the window fits a clear."""
        since = self.since(rule, self.last)
        if clear.mode == "all":
            return True
        if clear.mode == "c":
            return clear.opened == self.opened
        if clear.mode == "a":
            return clear.time >= since and any(n[0] == clear.id1 for n in self.who.get(clear.time, ()))
        return self.latest.get((clear.id1, clear.alarmid if clear.mode == "i" else None), since - 1) >= since

    def delays(self, rule: CorrelationRule) -> list[int]:
        """When a delayed first ticket is due."""
        due, end = [], self.last + self.get(rule, "window")
        first, count, wait = (self.get(rule, n) for n in ("first_delay", "defer_count", "defer_time"))
        if first is not None and self.recent_first() + first <= end:
            due.append(self.recent_first() + first)
        if count is not None and wait and self.last + wait <= end and self.counter(rule, self.last + wait) >= count:
            due.append(self.last + wait)
        return due

    def recent_first(self) -> int:
        return self.window.times[self.window.first]

    def next_due(self, rule: CorrelationRule) -> int:
        """When the group changes by itself: a delayed ticket, a refresh, its end."""
        due = [self.last + self.get(rule, "window") + 1]
        if self.ticket < 0:
            due += [d + 1 for d in self.delays(rule)]
        elif self.get(rule, "refresh"):
            due.append(self.ticket + self.get(rule, "refresh"))
        return min(due)


@dataclass(frozen=True)
class Clear:
    """A clear by everything ("all"), ccid ("c"), object and alarm id ("i"), object and time ("a") or object ("o")."""

    at: int
    mode: str
    id1: str = ""
    alarmid: str = ""
    time: int = 0  # of the alarm that mode "a" names
    opened: int = 0  # from the ccid that mode "c" names


def by_second(alarms: Iterable[tuple]) -> list[tuple]:
    """(time, seq, severity, step, state, count[, first seq, settings]) rows, one per second.

    Steps and counts add up, an up stands for the second, the worst severity and then the lowest
    seq represent it, the lowest seq gives the settings.
    """
    out = []
    for t, rows in groupby(sorted(((*a, a[1], None) if len(a) == 6 else tuple(a) for a in alarms), key=lambda a: a[0]), key=lambda a: a[0]):
        rows = list(rows)
        sev, seq = min((r[2], r[1]) for r in rows)
        lead = min(rows, key=lambda r: r[6])
        out.append((t, seq, sev, sum(r[3] for r in rows), max(r[4] for r in rows), sum(r[5] for r in rows), lead[6], lead[7]))
    return out


def _elapse(g: GroupMemory, rule: CorrelationRule, clock: int, out: list) -> None:
    """What happens up to ``clock`` without further alarms."""
    end = g.last + g.get(rule, "window")
    if g.ticket < 0 and not g.spent:
        due = [d for d in g.delays(rule) if clock > d]
        if due:
            _ticket(g, rule, min(due), "first", out)
    refresh = g.get(rule, "refresh")
    while g.ticket >= 0 and refresh and g.ticket + refresh <= min(clock, end):
        _ticket(g, rule, g.ticket + refresh, "refresh", out)
    if clock > end:
        g.open = False


def _ticket(g: GroupMemory, rule: CorrelationRule, at: int, event: str, out: list) -> None:
    since = g.since(rule, at)
    sev, seq = g.window.best(since)
    out.append((event, at, seq, sev, g.window.count(since)))
    g.ticket = at
    if event == "first" and not g.get(rule, "refresh"):
        g.spent = True


def step_group(
    g: GroupMemory, alarms: Iterable[tuple], rule: CorrelationRule, clock: int | None,
    clears: Iterable[Clear] = (), who: Mapping[int, Iterable[tuple]] | None = None,
) -> list[tuple]:
    """Feed (time, seq, severity, step, state, count) alarms and clears, then move the clock.

    Returns (event, time, representative seq, severity, alarms in the group) rows with
    event first, refresh or clear. The representative has the lowest severity number; of
    those the latest, then the lowest seq. A late alarm joins the open group and counts
    from its own time, but does not turn the clock back. A clear ends the group if an
    alarm in its window fits, after the alarms of the same second; ``who`` has the
    (object, alarm id) of each second's alarms.
    """
    out: list[tuple] = []
    late = defaultdict(list)
    for c in clears:
        late[c.at].append(c)
    seconds = {a[0]: a for a in by_second(alarms)}
    for t in sorted({*seconds, *late}):
        if g.open:
            _elapse(g, rule, t, out)
        if t in seconds:
            _join(g, rule, seconds[t], (who or {}).get(t, ()), out)
        if g.open and not g.spent and any(g.holds(rule, c) for c in late.get(t, ())):
            since = g.since(rule, g.last)
            sev, seq = g.window.best(since)
            out.append(("clear", t, seq, sev, g.window.count(since)))
            g.open = False
    if clock is not None and g.open:
        _elapse(g, rule, clock, out)
    return out


def _join(g: GroupMemory, rule: CorrelationRule, second: tuple, names: Iterable[tuple], out: list) -> None:
    """The alarms of a second open the group or join it."""
    t, seq, sev, step, state, count, _, settings = second
    if rule.closes_on_up and state == UP:
        g.open = False
        return
    if not g.open or g.spent:
        g.open, g.opened, g.last, g.ticket, g.spent = True, t, t, -1, False
        g.window, g.who, g.latest = Window(), {}, {}
        g.settings = json.loads(settings) if settings else {}
    g.last = max(g.last, t)
    g.window.add([t, step, count, sev, seq])
    since = g.since(rule, g.last)
    g.window.drop(since)
    if names:
        g.note(t, names)
    if len(g.who) > 2 * len(g.window) + 64:
        g.who = {s: n for s, n in g.who.items() if s >= since}
        g.latest = {k: s for k, s in g.latest.items() if s >= since}
    immediate = g.get(rule, "immediate")
    if g.ticket < 0 and immediate is not None and g.counter(rule, g.last) >= immediate:
        _ticket(g, rule, g.last, "first", out)
