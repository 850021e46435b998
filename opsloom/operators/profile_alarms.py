"""The deviation-alarm state machine: exact m-of-n matches, changes, repeats.

``step_series`` is the whole rule over one ordered series. Batch streams sorted
partitions through it and the stream calls it per key and micro-batch with the
state it returned last; a series has at most one sample per frame.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import SERIES, ProfileRule, worst_per_time

CHANGE_COLUMNS = ["level", "id", "key", "timeissued", "kind", "severity", "range", "val"]
CHANGES = "level string, id string, key string, timeissued bigint, kind string, severity int, range int, val double"


@dataclass
class SeriesState:
    """What is carried between runs: recent samples, open windows, current alarm."""

    samples: list = field(default_factory=list)  # (time, sev, val), oldest first
    starts: list = field(default_factory=list)  # per range: time after which it counts
    mode: str = "none"
    sev: int = 0
    since: int = 0
    repeat: int = 0
    pending: list = field(default_factory=list)  # samples of times that a stream's clock has not passed

    def to_dict(self) -> dict:
        return asdict(self)


def worse(sample: tuple) -> tuple:
    """The order in which one of several (sev, score) of a time stands for it: the first."""
    sev, score = sample
    return (99 if sev == -1 else sev, -score)


def first_match(samples: list, r, after: int | None) -> int | None:
    """Index of the first sample at which m of the last n qualify, counting only
    samples later than ``after``."""
    begin = 0 if after is None else bisect_right(samples, after, key=lambda s: s[0])
    window: deque[bool] = deque()
    hits = 0
    for i in range(begin, len(samples)):
        sev = samples[i][1]
        good = sev == -1 if r.kind == "CLEAR" else sev != -1 and sev <= r.sev
        window.append(good)
        hits += good
        if len(window) > r.n:
            hits -= window.popleft()
        if hits >= r.m:
            return i
    return None


def step_series(state: SeriesState, new: list, rule: ProfileRule, now: int | None) -> list[tuple]:
    """Add samples, emit the changes, then a repeat if one is due at ``now``.

    Every range finds its matches on its own and starts counting afresh after
    each. Matches are taken in time order, earlier ranges first. A clear is not
    emitted twice; an alarm not at an equal or worse-numbered severity.
    """
    out: list[tuple] = []
    if not state.starts:
        state.starts = [None] * len(rule.ranges)
    if new:
        state.samples = sorted(state.samples + new, key=lambda s: s[0])
        nxt = [first_match(state.samples, r, a) for r, a in zip(rule.ranges, state.starts)]
        while any(i is not None for i in nxt):
            at, ri = min((state.samples[i][0], k) for k, i in enumerate(nxt) if i is not None)
            r = rule.ranges[ri]
            _, _, val = state.samples[nxt[ri]]
            if r.kind == "CLEAR":
                if state.mode != "clear":
                    out.append((at, "clear", r.sev, ri, val))
                    state.mode, state.sev, state.since, state.repeat = "clear", r.sev, at, 0
            elif state.mode != "alarm" or state.sev > r.sev:
                out.append((at, "alarm", r.sev, ri, val))
                state.mode, state.sev, state.since, state.repeat = "alarm", r.sev, at, r.repeat
            for k, i in enumerate(nxt):
                if i is not None and state.samples[i][0] <= at:
                    state.starts[k] = state.samples[i][0]
                    nxt[k] = first_match(state.samples, rule.ranges[k], state.starts[k])
    due = now is not None and state.repeat > 0 and state.since + state.repeat <= now
    if due and not out and state.mode == "alarm":
        last = [s for s in state.samples if s[1] == state.sev]
        if last:
            ri = next(k for k, r in enumerate(rule.ranges) if r.kind != "CLEAR" and r.sev == state.sev)
            out.append((now, "repeat", state.sev, ri, last[-1][2]))
            state.since = now
    return out


def prune(state: SeriesState, rule: ProfileRule) -> None:
    """Forget samples that no range can count any more."""
    state.samples = state.samples[-rule.horizon :]


def alarm_state_changes(matched: DataFrame, rule: ProfileRule, now: int | None = None) -> DataFrame:
    """Alarm, clear and repeat events of every series.

    ``matched`` is ``range_rule_match`` output over ``sample_points``: one row per
    (series, frame start). Equal times are merged before the shuffle, worst
    severity first, so the rows of a series are bounded by the horizon read.
    """
    src = worst_per_time(matched.select(*SERIES, "timeissued", "sev", "score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, state, last = None, SeriesState(), 0

        def finish() -> list[tuple]:
            if cur is None:
                return []
            return [(*cur, *r) for r in step_series(state, [], rule, now if now is not None else last)]

        for pdf in batches:
            rows: list[tuple] = []
            samples = zip(pdf["timeissued"].tolist(), pdf["sev"].tolist(), pdf["score"].tolist())
            keys = zip(*[pdf[c].tolist() for c in SERIES])
            for key, part in groupby(zip(keys, samples), key=itemgetter(0)):
                if key != cur:
                    rows += finish()
                    cur, state = key, SeriesState()
                new = [s for _, s in part]
                rows += [(*key, *r) for r in step_series(state, new, rule, None)]
                last = new[-1][0]
                prune(state, rule)
            yield pd.DataFrame(rows, columns=CHANGE_COLUMNS)
        yield pd.DataFrame(finish(), columns=CHANGE_COLUMNS)

    # whole series per task, many series per task: no cost per group
    lined_up = src.repartition(*SERIES).sortWithinPartitions(*SERIES, "timeissued")
    return lined_up.mapInPandas(run, CHANGES)


def alarm_repeat(changes: DataFrame, rule: ProfileRule, until: int) -> DataFrame:
    """Repeats of standing alarms: one per elapsed repeat interval until the next
    change or ``until``. ``changes`` is ``alarm_state_changes`` output."""
    gaps = F.array(*[F.lit(r.repeat).cast("bigint") for r in rule.ranges])
    w = Window.partitionBy(*SERIES).orderBy("timeissued")
    src = changes.where("kind <> 'repeat'").withColumns(
        {"__next": F.lead("timeissued").over(w), "__gap": F.get(gaps, F.col("range"))}
    )
    end = F.coalesce(F.col("__next") - 1, F.lit(until))
    n = F.floor((end - F.col("timeissued")) / F.col("__gap")).cast("int")
    return (
        src.where((F.col("kind") == "alarm") & (F.col("__gap") > 0))
        .withColumn("__k", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
        .select(
            *SERIES,
            (F.col("timeissued") + F.col("__k") * F.col("__gap")).alias("timeissued"),
            F.lit("repeat").alias("kind"),
            "severity",
            "range",
            "val",
        )
    )


def change_alarms(changes: DataFrame, rule: ProfileRule, label: str = "label") -> DataFrame:
    """State changes as alarm events with their text."""
    texts = F.array(*[F.lit(r.text()) for r in rule.ranges])
    kinds = F.array(*[F.lit(r.kind.lower()) for r in rule.ranges])
    ms = F.array(*[F.lit(f"{r.m}/{r.n}") for r in rule.ranges])
    name = F.col(label) if label in changes.columns else F.col("key")
    alarm = F.concat(
        F.lit("Profile Alarm ("), name, F.lit("="), F.format_string("%.2f", "val"), F.lit(" "),
        F.get(kinds, F.col("range")), F.lit(" "), F.get(texts, F.col("range")), F.lit(") for "),
        F.get(ms, F.col("range")), F.lit(" cycles"), F.when(F.col("kind") == "repeat", F.lit(" (repeat)")).otherwise(F.lit("")),
    )
    text = F.when(F.col("kind") == "clear", F.concat(F.lit("Profile Alarm Cleared ("), name, F.lit(")"))).otherwise(alarm)
    clear = F.col("kind") == "clear"
    return changes.select(
        F.col("key").alias("alarmid"), F.col("level").alias("level1"), F.col("id").alias("id1"), "timeissued",
        F.when(clear, F.lit(2)).otherwise(F.lit(1)).alias("type"),
        F.when(clear, F.lit(4)).otherwise(F.lit(3)).alias("state"),
        "severity", text.alias("text"),
    )
