"""Operators against small plain-Python models on random input."""

import ipaddress
import hashlib
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from opsloom.functions import net, text
from opsloom.operators import alarms, callbacks, frames, graph, joins, ordered, prefixes, profile_alarms, rows, sorts, stats
from opsloom.streaming.correlate import CorrelationRule, GroupMemory, step_group


@pytest.fixture
def many_chunks(spark):
    """No coalescing: small inputs still span several chunks."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


def test_scans_over_chunks_with_a_hot_series(spark, many_chunks):
    rng = random.Random(1)
    data = [(i, "a" if rng.random() < 0.4 else rng.choice("bcd"), rng.randint(0, 60), rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "i long, s string, t int, v int")
    o = ordered.in_order(df, ["t", "i"], ["s"])
    assert o.df.select(ordered.CHUNK).distinct().count() > 4
    o = o.scans(
        {
            "rn": ordered.row_count(),
            "total": (F.col("v"), "sum"),
            "top": (F.col("v"), "max", False),
            "prev": ordered.lag_of(F.col("v")),
            "big": (F.when(F.col("v") > 7, F.col("v")), "last"),
        }
    )
    got = {r.i: (r.rn, r.total, r.top, r.prev.v if r.prev else None, r.big) for r in o.rows().collect()}
    exp = {}
    for s in "abcd":
        total, seen, big = 0, [], None
        for n, (i, _, _, v) in enumerate(sorted((d for d in data if d[1] == s), key=lambda d: (d[2], d[0]))):
            total += v
            big = v if v > 7 else big
            exp[i] = (n + 1, total, max(seen, default=None), seen[-1] if seen else None, big)
            seen.append(v)
    assert got == exp


def test_sessions_and_groups_match_the_group_step(spark, many_chunks):
    rng = random.Random(2)
    data = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 5)}", rng.randint(0, 40000), rng.choice([3, 4]), rng.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(data, "seq long, id1 string, timeissued long, state int, severity int")
    clock = max(d[2] for d in data)
    rule = CorrelationRule("x", "true", ("id1",), window=1800, immediate=2, first_delay=300, refresh=1000)
    exp = []
    for k in {d[1] for d in data}:
        g = GroupMemory()
        alarms_of = sorted((t, s, sev, 1, st, 1) for s, i, t, st, sev in data if i == k)
        out = step_group(g, alarms_of, rule, clock)
        exp += [(k, at) for e, at, *_ in out if e == "first"]
        refreshes = [at for e, at, *_ in out if e == "refresh"]
        exp += [(k, "r", len(refreshes))]
    r = alarms.repeat_groups(df, ["id1"], 1800, 2, 300, 1000).collect()
    got = [(x.id1, x.ticket) for x in r if x.ticket is not None]
    for k in {d[1] for d in data}:
        got.append((k, "r", sum(x.refreshes for x in r if x.id1 == k)))
    assert sorted(got, key=str) == sorted(exp, key=str)


def test_updown_timeout(spark, many_chunks):
    rng = random.Random(3)
    data = [(i, rng.choice("aab"), rng.randint(0, 5000), rng.choice([3, 4])) for i in range(200)]
    df = spark.createDataFrame(data, "seq long, id1 string, timeissued long, state int")
    clock = max(d[2] for d in data)
    exp = set()
    for s, k, t, st in data:
        if st == 3 and t + 60 < clock:
            later = [u for v, kk, u, x in data if kk == k and x == 4 and (u, v) > (t, s)]
            if not later or min(later) > t + 60:
                exp.add(s)
    assert {r.seq for r in alarms.updown_timeout(df, ["id1"], 60).collect()} == exp


def random_ranges(rng, n, top):
    return [(a, min(top, a + rng.randint(0, 40))) for a in (rng.randint(0, top) for _ in range(n))]


def as_ranges(s, top):
    out = []
    for x in sorted(s):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_address_sets(spark, many_chunks, seed):
    rng = random.Random(seed)
    top = 1500
    a, b = random_ranges(rng, 25, top), random_ranges(rng, 25, top)
    sa, sb = ({x for lo, hi in r for x in range(lo, hi + 1)} for r in (a, b))
    da, db = (spark.createDataFrame(r, "lo long, hi long") for r in (a, b))

    def rows_of(df):
        return sorted((r.lo, r.hi) for r in df.collect())

    assert rows_of(prefixes.union([da, db])) == as_ranges(sa | sb, top)
    assert rows_of(prefixes.intersect(da, db)) == as_ranges(sa & sb, top)
    assert rows_of(prefixes.difference(da, db)) == as_ranges(sa - sb, top)
    inv = rows_of(prefixes.invert(da))
    assert inv[-1][1] == 2**32 - 1
    assert not any(lo <= x <= hi for lo, hi in inv for x in sa)
    covered = [r for r in as_ranges(sa, top) if any(x in sb for x in range(r[0], r[1] + 1))]
    assert rows_of(prefixes.cover(da, db)) == covered
    nets = [n for lo, hi in as_ranges(sa, top) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(lo), ipaddress.IPv4Address(hi))]
    got = prefixes.cidrs(prefixes.union([da])).collect()
    assert sorted((r.addr, r.len) for r in got) == sorted((int(n.network_address), n.prefixlen) for n in nets)


def test_address_sets_v6_to_the_last_address(spark, many_chunks):
    def raw(n):
        return bytearray(n.to_bytes(16, "big"))

    top = (1 << 128) - 1
    a = spark.createDataFrame([(raw(top - 5), raw(top)), (raw(0), raw(3)), (raw(4), raw(9))], "lo binary, hi binary")
    got = [(int.from_bytes(r.lo, "big"), int.from_bytes(r.hi, "big")) for r in prefixes.union([a], prefixes.V6).collect()]
    assert sorted(got) == [(0, 9), (top - 5, top)]
    inv = [(int.from_bytes(r.lo, "big"), int.from_bytes(r.hi, "big")) for r in prefixes.invert(a, prefixes.V6).collect()]
    assert inv == [(10, top - 6)]


def test_lpm_and_containment(spark):
    rng = random.Random(5)
    nets = {(rng.randint(0, 255) << 24 >> (32 - n) << (32 - n), n) for n in [0, 2, 3, 5, 6, 8, 8, 8] for _ in range(3)}
    t = spark.createDataFrame([(a, n, f"{a}/{n}") for a, n in nets], "addr long, len int, name string")
    pts = [rng.randint(0, 2**32 - 1) for _ in range(150)] + [7] * 80
    got = prefixes.lpm_join(spark.createDataFrame([(p,) for p in pts], "a long"), "a", t, ["name"]).collect()
    assert len(got) == len(pts)
    for r in got:
        hits = [(n, a) for a, n in nets if r.a >> (32 - n) == a >> (32 - n)]
        assert r.name == (f"{max(hits)[1]}/{max(hits)[0]}" if hits else None)

    def inside(x, y):
        return x != y and x[1] >= y[1] and x[0] >> (32 - y[1]) == y[0] >> (32 - y[1])

    top = {x for x in nets if not any(inside(x, y) for y in nets)}
    assert {(r.addr, r.len) for r in prefixes.supernets(t).collect()} == top
    assert {(r.addr, r.len) for r in prefixes.subnets(t).collect()} == nets - top


def test_interval_join(spark):
    rng = random.Random(6)
    rs = [(i, *sorted((rng.randint(0, 10**9), rng.randint(0, 10**9)))) for i in range(40)]
    pts = [(i, rng.randint(0, 10**9)) for i in range(100)]
    got = joins.interval_join(
        spark.createDataFrame(pts, "i long, p long"), "p", spark.createDataFrame(rs, "r long, lo long, hi long"), "lo", "hi"
    ).collect()
    assert sorted((r.i, r.r) for r in got) == sorted((i, r) for i, p in pts for r, lo, hi in rs if lo <= p <= hi)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 120):03d}", f"n{rng.randint(0, 120):03d}") for _ in range(70)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]
    edges += [("hub", f"h{i:03d}") for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    comp = {}
    for n in nodes:
        comp.setdefault(find(n), set()).add(n)
    exp = {n: (min(c), len(c)) for c in comp.values() for n in c}
    df = spark.createDataFrame([("o", a, "o", b) for a, b in edges], "level1 string, id1 string, level2 string, id2 string")
    got = {r.ndid: (r.ccid, r.ndn) for r in graph.connected_components(df).collect()}
    assert got == exp


def test_topological_sort_and_cycle(spark):
    pairs = [("a", "c"), ("b", "c"), ("c", "d"), ("a", "d"), ("e", "e")]
    df = spark.createDataFrame(pairs, "before string, after string")
    assert [r.node for r in graph.topological_sort(df).orderBy("position").collect()] == ["a", "b", "e", "c", "d"]
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_sort(spark.createDataFrame([("a", "b"), ("b", "a")], "before string, after string"))


def test_level_closure_paths(spark):
    pairs = spark.createDataFrame([("o", "g"), ("g", "s"), ("s", "l"), ("s", "c"), ("o", "t")], "id1 string, id2 string")
    got = {}
    for r in graph.level_closure(pairs).collect():
        got.setdefault((r.id1, r.id2), []).append((r["index"], r.iid1, r.iid2))
    assert sorted(got[("o", "c")]) == [(0, "o", "g"), (1, "g", "s"), (2, "s", "c")]
    assert ("c", "o") not in got and ("t", "g") not in got
    full = graph.level_closure(pairs, transitive=["o", "g", "s"], full=True)
    back = {(r["index"], r.iid1, r.iid2, r.dir) for r in full.where("id1 = 'c' and id2 = 'o'").collect()}
    assert back == {(0, "c", "s", 2), (1, "s", "g", 2), (2, "g", "o", 2)}


def test_service_impact(spark):
    edges = [("p1", "x"), ("x", "c1"), ("x", "y"), ("y", "c2"), ("p2", "y")]
    e = spark.createDataFrame([("o", a, "o", b) for a, b in edges], "level1 string, id1 string, level2 string, id2 string")
    attrs = [("p1", "prod:s"), ("p2", "prod:s"), ("c1", "cons:s"), ("c2", "cons:s")]
    roles = graph.service_roles(spark.createDataFrame([("o", i, "gce_service0", v) for i, v in attrs], "level string, id string, key string, val string"))

    def impact(down):
        ev = spark.createDataFrame([("o", d) for d in down], "level string, id string")
        return [(r.lost_all, r.lost_some, r.remaining, r.severity) for r in graph.service_impact(e, roles, ev).collect()]

    assert impact([]) == []
    assert impact(["c1"]) == [(0, 2, 100.0, 4)]
    assert impact(["x"]) == [(1, 1, 50.0, 3)]
    assert impact(["x", "y"]) == [(2, 0, 0.0, 1)]


def brute_changes(samples, rule):
    """The m-of-n scan written out: every range rescans from after its last match."""
    found = []
    for ri, r in enumerate(rule.ranges):
        i = 0
        while i < len(samples):
            hit = None
            for j in range(i, len(samples)):
                win = samples[max(i, j - r.n + 1) : j + 1]
                ok = sum(1 for _, sev, _ in win if (sev == -1 if r.kind == "CLEAR" else sev != -1 and sev <= r.sev))
                if ok >= r.m:
                    hit = j
                    break
            if hit is None:
                break
            found.append((samples[hit][0], ri))
            i = hit + 1
    mode, cur, out = "none", 0, []
    for t, ri in sorted(found):
        r = rule.ranges[ri]
        if r.kind == "CLEAR":
            if mode != "clear":
                out.append((t, "clear", r.sev))
                mode, cur = "clear", r.sev
        elif mode != "alarm" or cur > r.sev:
            out.append((t, "alarm", r.sev))
            mode, cur = "alarm", r.sev
    return out


RULE = stats.parse_rule("SIGMA:i:3:n::1:2:3:1:0;SIGMA:i:2:n::2:3:5:1:0;ACTUAL:i:5:n::4:1:1:1:0;CLEAR:5:2:4")


@pytest.mark.parametrize("seed", range(6))
def test_alarm_steps_in_one_go_and_in_pieces(seed):
    rng = random.Random(seed)
    samples = [(t * 300, rng.choice([-1, -1, 1, 2, 4]), float(t)) for t in range(120)]
    exp = brute_changes(samples, RULE)
    whole = profile_alarms.step_series(profile_alarms.SeriesState(), samples, RULE, None)
    assert [r[:3] for r in whole] == exp
    state, got, i = profile_alarms.SeriesState(), [], 0
    while i < len(samples):
        k = rng.randint(1, 15)
        got += profile_alarms.step_series(state, samples[i : i + k], RULE, None)
        profile_alarms.prune(state, RULE)
        i += k
    assert [r[:3] for r in got] == exp


def test_alarm_state_changes_by_series(spark):
    rng = random.Random(11)
    data = {k: [(t * 300, rng.choice([-1, 1, 2, 4]), float(t)) for t in range(60)] for k in ("a", "b", "c")}
    rows_ = [("o", "h", k, t, sev, v) for k, s in data.items() for t, sev, v in s]
    df = spark.createDataFrame(rows_, "level string, id string, key string, timeissued long, sev int, score double")
    got = profile_alarms.alarm_state_changes(df, RULE).where("kind <> 'repeat'").collect()
    for k, s in data.items():
        assert [(r.timeissued, r.kind, r.severity) for r in sorted(got, key=lambda r: r.timeissued) if r.key == k] == brute_changes(s, RULE)


def test_repeat_after_interval():
    rule = stats.parse_rule("SIGMA:i:3:n::1:1:1:2:600")
    assert rule.ranges[0].repeat == 300
    assert rule.ranges[1].kind == "CLEAR" and rule.ranges[1].sev == 5
    state = profile_alarms.SeriesState()
    assert [r[1] for r in profile_alarms.step_series(state, [(0, 1, 9.0)], rule, 0)] == ["alarm"]
    assert profile_alarms.step_series(state, [], rule, 299) == []
    assert [r[1] for r in profile_alarms.step_series(state, [], rule, 300)] == ["repeat"]
    assert profile_alarms.step_series(state, [], rule, 301) == []


def test_rule_grammar_and_bounds(spark):
    r = stats.parse_rule("VR:i:1:e:10;SIGMA:e:2:i:3:1:1:1:4:40")
    assert r.ranges[0].repeat == 15 and r.ranges[0].text() == "in range (2.00,3.00]"
    assert [x.kind for x in r.ranges] == ["SIGMA", "CLEAR"]
    df = spark.createDataFrame([(0.5, 2.5, 0.0), (5.0, 2.0, 0.0), (5.0, 2.5, 0.0), (5.0, 3.5, 0.0), (10.0, 2.5, 0.0)], "val double, sigma double, actual double")
    assert [x.sev for x in stats.range_rule_match(df, r).collect()] == [-1, -1, 1, -1, -1]
    with pytest.raises(ValueError):
        stats.parse_rule("FOO:1")


def test_profile_drops_one_outlier(spark):
    vals = [10.0, 10.2, 9.8, 10.1, 50.0]
    df = spark.createDataFrame([("o", "h", "k", 0, v) for v in vals], "level string, id string, key string, frame int, val double")
    r = stats.stat_profile(df, wide=True).first()
    assert abs(r["mean"] - 10.025) < 1e-9
    low = spark.createDataFrame([("o", "h", "k", 0, v) for v in [10.0, 10.2, 9.8, 10.1, -90.0]], df.schema)
    assert abs(stats.stat_profile(low, wide=True).first()["mean"] - 10.025) < 1e-9
    two = spark.createDataFrame([("o", "h", "k", 0, 1.0), ("o", "h", "k", 0, 99.0), ("o", "h", "j", 0, 5.0)], df.schema)
    assert {x.key: x["mean"] for x in stats.stat_profile(two, wide=True).collect()} == {"k": 50.0, "j": 5.0}


def test_open_alarms_precedence(spark):
    cols = "seq long, ccid string, alarmid string, id1 string, timeissued long, timecleared long, type int, sortorder int, state int, severity int, text string"

    def row(seq, t, type_=1, ccid="", aid="a", id1="h", tc=0):
        return (seq, ccid, aid, id1, t, tc, type_, 1, 3, 1, f"t{seq}")

    data = [
        row(1, 100, ccid="g"), row(2, 100, aid="x"), row(3, 100, aid="y"), row(4, 100, id1="other"), row(5, 300, aid="x"),
        row(6, 200, 2, ccid="g"), row(7, 200, 2, aid="x"), row(8, 201, 2, aid="", tc=100),
    ]
    df = spark.createDataFrame(data, cols)
    cleared = {r.seq: r.cleared_at for r in alarms.match_clears(df.where("type = 1"), df.where("type = 2")).collect()}
    assert cleared == {1: 200, 2: 200, 3: 100, 4: None, 5: None}
    assert {r.seq for r in alarms.open_alarms(df, 150, "seq").collect()} == {5}
    assert {r.seq for r in alarms.open_alarms(df, 1000, "seq").collect()} == {4, 5}
    all_clear = df.unionByName(spark.createDataFrame([row(9, 400, 2, aid="", id1="__all_clear__")], cols))
    assert alarms.open_alarms(all_clear, 1000, "seq").count() == 0


def test_echo_is_dropped_once(spark):
    cols = "seq long, ccid string, timeissued long, severity int, state int, type int, text string, sortorder int"
    data = [(1, "g", 5, 1, 3, 1, "t", 2), (2, "g", 5, 1, 3, 1, "t", 1), (3, "g", 5, 1, 3, 1, "t", 1), (4, "g", 6, 1, 3, 1, "t", 1), (5, "", 5, 1, 3, 1, "t", 1)]
    got = alarms.ticket_echo_dedupe(spark.createDataFrame(data, cols), "seq").collect()
    assert sorted((r.seq, r.sortorder) for r in got) == [(1, 1), (3, 1), (4, 1), (5, 1)]


def test_first_ticket_ends_a_one_shot_group():
    rule = CorrelationRule("b", "true", ("k",), window=100, immediate=2)
    g = GroupMemory()
    out = step_group(g, [(0, 1, 3, 1, 3, 1), (10, 2, 1, 1, 3, 1), (20, 3, 1, 1, 3, 1), (30, 4, 2, 1, 3, 1)], rule, 500)
    assert out == [("first", 10, 2, 1, 2), ("first", 30, 3, 1, 2)]


def test_up_closes_a_group():
    rule = CorrelationRule("i", "true", ("k",), window=90_000, defer_count=1, defer_time=86_400, closes_on_up=True)
    g = GroupMemory()
    assert step_group(g, [(0, 1, 1, 1, 3, 1), (50, 2, 5, 0, 4, 1)], rule, 200_000) == []
    g = GroupMemory()
    assert step_group(g, [(0, 1, 1, 1, 3, 1)], rule, 86_401) == [("first", 86_400, 1, 1, 1)]


def test_representative_is_worst_then_latest_then_lowest():
    rule = CorrelationRule("r", "true", ("k",), window=100, immediate=4)
    g = GroupMemory()
    out = step_group(g, [(0, 9, 1, 1, 3, 1), (5, 7, 1, 1, 3, 1), (5, 8, 1, 1, 3, 1), (6, 1, 2, 1, 3, 1)], rule, None)
    assert out == [("first", 6, 7, 1, 4)]


def test_keyed_frames_treat_absent_as_zero(spark):
    a = spark.createDataFrame([("x", 0, 4.0), ("y", 1, -2.0)], "key string, frame int, val double")
    b = spark.createDataFrame([("x", 0, 6.0), ("z", 0, 3.0)], "key string, frame int, val double")
    def cells(df):
        return {(r.key, r.frame): r.val for r in df.collect()}

    assert cells(frames.combine("min", [a, b])) == {("x", 0): 4.0, ("y", 1): -2.0, ("z", 0): 0.0}
    assert cells(frames.combine("max", [a, b])) == {("x", 0): 6.0, ("y", 1): 0.0, ("z", 0): 3.0}
    assert cells(frames.combine("div", [a, b]))[("z", 0)] == 0.0
    ms = {(r.key, r.frame): (r["mean"], r.sdev) for r in frames.mean_sdev([a, b]).collect()}
    assert ms[("x", 0)] == (5.0, pytest.approx(2**0.5)) and ms[("z", 0)] == (1.5, pytest.approx(4.5**0.5))
    assert {r.key: r.val for r in frames.sum_frames(a, "max").collect()} == {"x": 4.0, "y": 0.0}
    assert {r.frame: r.val for r in frames.sum_items(a, "min").collect()} == {0: 0.0, 1: -2.0}
    assert cells(frames.cat([a, b]))[("z", 2)] == 3.0


def test_text_functions(spark):
    lines = ["a&b;c", "x|y%z", "q\"<r>'\\", "é ü;&#x41;", "tab\there", ""]
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    c = F.col("s")
    got = df.select(
        "s", text.html_dec(text.html_enc(c)).alias("h"), text.url_dec(text.url_enc(c)).alias("u"),
        text.simple_dec(text.simple_enc(c)).alias("p"), text.checksum(c, "crc").alias("crc"),
    ).collect()
    for r in got:
        assert r.h == r.s and r.u == r.s and r.p == r.s and r.crc == zlib.crc32(r.s.encode())
    one = df.limit(1).select(
        text.cut_chars(F.lit("abcdef"), "2-3,5-").alias("cut"),
        text.cut_fields(F.lit("a:b:c:d"), "-2,4", ":").alias("fields"),
        text.cut_fields(F.lit("plain"), "2", ":").alias("whole"),
        text.tr(F.lit("aabbcc"), "a-c", "x", squeeze=True).alias("tr"),
        text.fold(F.lit("the quick brown fox"), 10, True).alias("fold"),
    ).first()
    assert tuple(one) == ("bcef", "a:b:d", "plain", "x", ["the quick ", "brown fox"])


def test_addresses(spark):
    good = ["0.0.0.0", "255.255.255.255", "10.1.2.3"]
    bad = ["256.1.1.1", "1.2.3", "a.b.c.d", "1.2.3.4.5", ""]
    df = spark.createDataFrame([(s,) for s in good + bad], "s string")
    got = {r.s: (r.n, r.t) for r in df.select("s", net.ip_parse(F.col("s")).alias("n"), net.ip_format(net.ip_parse(F.col("s"))).alias("t")).collect()}
    assert all(got[s] == (int(ipaddress.IPv4Address(s)), s) for s in good)
    assert all(got[s][0] is None for s in bad)
    p = spark.createDataFrame([("10/8",), ("199.37/16",), ("1.2.3.4/31",), ("0/0",), ("1.2.3.4/33",), ("1.2.3.4",)], "s string")
    pp = {r.s: r.p for r in p.select("s", net.prefix_parse(F.col("s")).alias("p")).collect()}
    assert tuple(pp["10/8"]) == (10 << 24, 8) and tuple(pp["0/0"]) == (0, 0) and tuple(pp["1.2.3.4"])[1] == 32
    assert tuple(pp["1.2.3.4/31"]) == (0x01020304, 31) and pp["1.2.3.4/33"] is None
    assert tuple(pp["199.37/16"]) == ((199 << 24) + (37 << 16), 16)


def test_aspath_patterns(spark):
    df = spark.createDataFrame([([1, 2, 2, 3],), ([2],), ([],), ([12, 3],)], "p array<long>")

    def hits(pattern):
        return [r.m for r in df.select(net.aspath_match(F.col("p"), pattern).alias("m")).collect()]

    assert hits("2") == [True, True, False, False]
    assert hits("^1 2* 3$") == [True, False, False, False]
    assert hits("^!1") == [False, True, False, True]
    assert hits("^[1 12] .* 3$") == [True, False, False, True]
    assert hits("2{2}") == [True, False, False, False]


def test_validate_and_branch(spark):
    df = spark.createDataFrame([(1, "a"), (50, "b"), (None, "a"), (7, "z")], "n int, s string")
    cons = [rows.Constraint("n", min=0, max=10, default=0), rows.Constraint("s", pattern="[ab]")]
    assert [tuple(r) for r in rows.validate_discard(df, cons).collect()] == [(1, "a")]
    assert sorted(tuple(r) for r in rows.validate_repair(df, cons).collect()) == [(0, "a"), (0, "b"), (1, "a")]
    assert {(r.field, r.value): r["count"] for r in rows.validate_summary(df, cons).collect()} == {("n", "50"): 1, ("n", None): 1, ("s", "z"): 1}
    yes, no = rows.branch(df, "n > 5", lambda d: d, lambda d: d)
    assert yes.count() == 2 and no.count() == 2


def test_sort_checks(spark, many_chunks):
    df = spark.createDataFrame([(i, i // 2) for i in range(100)], "i long, v long")
    r = sorts.sort_check(df, ["i"], "v").first()
    assert r.ordered and r.disorders == 0
    assert not sorts.sort_check(df, ["i"], "v", unique=True).first().ordered
    assert sorted(r.i for r in sorts.tail(df, 3, ["i"]).collect()) == [97, 98, 99]


def test_join_goldens(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], "k string, x string")
    b = spark.createDataFrame([("b", "9"), ("c", "8")], "k string, y string")
    full = joins.join_tables(a, b, ["k"], "full", fill="-")
    assert sorted(tuple(r) for r in full.collect()) == [("a", "1", "-"), ("b", "2", "9"), ("b", "3", "9"), ("c", "-", "8")]
    salted = joins.salted_join(a, b, ["k"], "left").collect()
    assert sorted((tuple(r) for r in salted), key=str) == [("a", "1", None), ("b", "2", "9"), ("b", "3", "9")]
    assert joins.longest_literal("disk .* full") in ("disk ", " full")
    assert joins.longest_literal("a|b") == ""


def test_address_sets_v6_prefixes(spark):
    def raw(text):
        return bytearray(ipaddress.IPv6Address(text).packed)

    a = spark.createDataFrame([(raw("2001:db8::1"), raw("2001:db8::ff")), (raw("::"), raw("::1"))], "lo binary, hi binary")
    got = {(str(ipaddress.IPv6Address(bytes(r.addr))), r.len) for r in prefixes.cidrs(a, prefixes.V6).collect()}
    exp = ipaddress.summarize_address_range(ipaddress.IPv6Address("2001:db8::1"), ipaddress.IPv6Address("2001:db8::ff"))
    assert got == {(str(n.network_address), n.prefixlen) for n in exp} | {("::", 127)}
    wide = {(str(ipaddress.IPv6Address(bytes(r.lo))), str(ipaddress.IPv6Address(bytes(r.hi)))) for r in prefixes.rebit(a, 64, prefixes.V6).collect()}
    assert wide == {("::", "::ffff:ffff:ffff:ffff"), ("2001:db8::", "2001:db8::ffff:ffff:ffff:ffff")}
    n = prefixes.size6(a).first()
    assert (n.prefixes, n.networks64, n.addresses, n.ranges) == (9, "0", "257", 2)
    low = prefixes.min_max(a).first()
    assert bytes(low.min) == bytes(raw("::")) and bytes(low.max) == bytes(raw("2001:db8::ff"))


def test_copies_of_a_hot_value_are_kept(spark, many_chunks):
    a = spark.createDataFrame([("x",)] * 70 + [("y",)] * 3, "v string")
    b = spark.createDataFrame([("x",)] * 25 + [("z",)], "v string")
    for column, exp in (("only_a", {"x": 45, "y": 3}), ("both", {"x": 25}), ("only_b", {"z": 1})):
        got = sorts.comm_rows(a, b, "v", column).groupBy("v").count().collect()
        assert {r.v: r["count"] for r in got} == exp
    assert [r.v for r in sorts.sort_keys(a, [("v", True)]).collect()] == ["y"] * 3 + ["x"] * 70
    assert sorted(r.rn for r in ordered.number_rows(a, ["v"]).collect()) == list(range(1, 74))


def test_combining_seconds_keeps_the_groups():
    import pandas as pd

    from opsloom.streaming.correlate import by_second
    from opsloom.streaming.groups import KEYED, combine

    cols = [c.split()[0] for c in KEYED.split(", ")]
    rows_ = [{"kind": "alarm", "rule": "GEN1_ANY", "group": "g", "timeissued": 5, "state": 3, "seq": s, "severity": sev, "step": 1, "n": 1, "lead": s,
              "settings": f"s{s}", "who": f"o{s % 2}"} for s, sev in ((3, 2), (1, 4), (2, 2))]
    rows_ += [{"timeissued": t, "state": 0, "seq": 0, "severity": 0, "n": 1, "lead": 0} for t in (1, 9, 4)]
    rows_ += [{"kind": "name", "rule": "GEN1_ANY", "group": "g", "timeissued": t, "slot": "o:x", "until": t + 10} for t in (4, 2, 3)]
    rows_ += [{"kind": "clear", "timeissued": 7, "slot": "o:x", "mode": "o", "id1": "x"}]
    out = pd.concat(list(combine(iter([pd.DataFrame(rows_, columns=cols)]))))
    hit = out[out["kind"] == "alarm"].iloc[0]
    assert (hit["seq"], hit["severity"], hit["n"], hit["step"], hit["settings"], hit["who"]) == (2, 2, 3, 3, "s1", "o0\x1eo1")
    assert out[out["kind"].isna()]["timeissued"].tolist() == [9]
    assert out[out["kind"] == "name"][["timeissued", "until"]].values.tolist() == [[2, 14]]
    assert out[out["kind"] == "clear"]["mode"].tolist() == ["o"]
    plain = [(5, s, sev, 1, 3, 1, s, f"s{s}") for s, sev in ((3, 2), (1, 4), (2, 2))]
    assert by_second(plain) == [(5, 2, 2, 3, 3, 3, 1, "s1")] == by_second([*by_second(plain[:2]), plain[2]])


def test_window_equals_sums_over_lists():
    from opsloom.streaming.correlate import Window

    rng = random.Random(9)
    for _ in range(200):
        w, plain, t = Window(), [], 0
        for i in range(rng.randrange(1, 400)):
            t += rng.randrange(0, 4)
            row = [t - rng.randrange(20) * (rng.random() < 0.1), rng.choice([1, -1]), rng.randrange(1, 4), rng.randrange(1, 5), i]
            w.add(row)
            plain.append(row)
            since = t - rng.choice([5, 30])
            w.drop(since)
            plain = [r for r in plain if r[0] >= since]
            live = [r for r in plain if r[0] >= since + 2]
            assert sorted(w.live()) == sorted(plain) and w.counter(since + 2) == sum(r[1] for r in live) and w.count(since + 2) == sum(r[2] for r in live)
            if live:
                sev, _, seq = min((r[3], -r[0], r[4]) for r in live)
                assert w.best(since + 2) == (sev, seq)


def test_a_hundred_thousand_seconds_are_linear():
    import time

    rule = CorrelationRule("r", "true", ("k",), window=129_600, immediate=10**9, defer_count=10**9, defer_time=60)
    seconds = [(t, t, 1 + t % 5, 1, 3, 1) for t in range(100_000)]
    start = time.perf_counter()
    g = GroupMemory()
    for at in range(0, 100_000, 20_000):
        assert step_group(g, seconds[at : at + 20_000], rule, None) == []
    assert len(g.recent) == 100_000 and time.perf_counter() - start < 20


@pytest.mark.parametrize("order", [0, 1])
def test_clears_reach_open_groups_in_any_arrival_order(spark, tmp_path, order):
    """Every mode of clear, against the group step with all clears; a group may hold alarms of several objects."""
    from opsloom.streaming import jobs
    from opsloom.streaming.correlate import Clear
    from opsloom.streaming.groups import ccid_of

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    rng = random.Random(20 + order)
    rules = [
        CorrelationRule("own", "type = 1", ("id1",), window=900, immediate=2, first_delay=300, refresh=400),
        CorrelationRule("mixed", "type = 1", ("text",), window=700, immediate=3, refresh=500),
    ]
    alarms_ = [(i, 1, rng.choice("abc"), rng.choice("xy"), rng.choice("tu"), rng.randrange(0, 20_000), rng.randint(1, 4), "", 0) for i in range(150)]
    clears_ = []
    for i in range(60):
        mode, t = rng.choice("oiac" if i else ["all"]), rng.randrange(0, 20_000)
        if i % 20 == 0:
            mode = "all"
        near = min(alarms_, key=lambda r: (r[5] > t, abs(t - r[5])))
        if rng.random() < 0.3:
            t = near[5]  # a clear of the same second comes after the alarm
        own = f'{{"id1":"{near[2]}"}}'
        ccid = ccid_of("own", md5(own), near[5]) if mode == "c" else ""
        obj = "__all_clear__" if mode == "all" else near[2]
        clears_.append((1000 + i, 2, obj, near[3] if mode == "i" else "", "", t, 1, ccid, near[5] if mode == "a" else 0, mode, own))
    schema = "seq long, type int, id1 string, alarmid string, text string, timeissued long, severity int, ccid string, timecleared long, state int"
    arriving = sorted([*alarms_, *(c[:9] for c in clears_)], key=lambda r: r[5] + rng.randrange(1500) * bool(order))
    arriving.append((9999, 0, "z", "", "", 1_000_000, 1, "", 0))
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for at in range(0, len(arriving), 75):
        spark.createDataFrame([(*r, 3) for r in arriving[at : at + 75]], schema).coalesce(1).write.mode("append").parquet(path)
        live = jobs.stream_tail(spark, path, spark.read.parquet(path).schema)
        jobs.catch_up(jobs.correlate(live, rules, delay="2000 seconds", clears="type = 2"), out, cp)
    got = sorted((r.rule, r.group, r.event, r["at"], r.seq, r.severity, r.n) for r in spark.read.parquet(out).collect())
    want = []
    for rule, place in zip(rules, (2, 4), strict=True):
        for k in sorted({a[place] for a in alarms_}):
            mine = [a for a in alarms_ if a[place] == k]
            who = {}
            for a in mine:
                who.setdefault(a[5], set()).add((a[2], a[3]))
            group = f'{{"{rule.keys[0]}":"{k}"}}'
            asked = [
                Clear(c[5], c[9], c[2], c[3], c[8], int(c[7].split(":")[-1]) if c[7] else 0) for c in clears_ if c[9] != "c" or (rule.id == "own" and c[10] == group)
            ]
            events = step_group(GroupMemory(), [(a[5], a[0], a[6], 1, 3, 1) for a in mine], rule, 1_000_000 - 2000, asked, who)
            want += [(rule.id, group, *e) for e in events]
    assert got == sorted(want)
    assert sum(w[2] == "clear" for w in want) > 10


def test_a_late_alarm_does_not_turn_the_clock_back():
    rule = CorrelationRule("l", "true", ("k",), window=100, immediate=3)
    g = GroupMemory()
    out = [r for t, s in ((1000, 1), (950, 2), (1060, 3)) for r in step_group(g, [(t, s, 1, 1, 3, 1)], rule, None)]
    assert out == [] and g.last == 1060 and [a[0] for a in g.recent] == [1000, 1060]
    assert step_group(g, [(1061, 4, 1, 1, 3, 1)], rule, None) == [("first", 1061, 4, 1, 3)]


def test_old_alarms_leave_the_group():
    rule = CorrelationRule("p", "true", ("k",), window=100, immediate=3)
    g = GroupMemory()
    assert step_group(g, [(t, i, 1, 1, 3, 1) for i, t in enumerate(range(0, 1000, 60))], rule, None) == []
    assert step_group(g, [(970, 50, 1, 1, 3, 1)], rule, None) == [("first", 970, 50, 1, 3)]


def test_settings_of_the_opening_alarm():
    rule = CorrelationRule("s", "true", ("k",), window="w", immediate="n")
    g = GroupMemory()
    given = ['{"window": 50, "immediate": 2}', '{"window": 5000, "immediate": 9}']
    out = step_group(g, [(0, 1, 1, 1, 3, 1, 1, given[0]), (10, 2, 1, 1, 3, 1, 2, given[1])], rule, None)
    assert out == [("first", 10, 2, 1, 2)]


@pytest.mark.parametrize("order", [0, 1, 2])
def test_stream_equals_the_group_step_in_any_arrival_order(spark, tmp_path, order):
    from opsloom.streaming import jobs
    from opsloom.streaming.correlate import GEN1, GEN2, IOT, by_second

    rng = random.Random(order)
    rows_ = []
    for i in range(160):
        k = rng.choice("abc")
        state = rng.choice([3, 3, 4])
        rows_.append((i, k, "t", rng.choice(["any.1", "IoT.1"]), rng.choice(["", "u"]), rng.randrange(0, 30_000), state, rng.randint(1, 5),
                      600 * (1 + "abc".index(k)), 2, 2, 300, 900, "abc".index(k) % 2))
    schema = ("seq long, id1 string, text string, alarmid string, `unique` string, timeissued long, state int, severity int, matchwindow long, "
              "ticketimmediatecount long, ticketdefercount long, ticketdefertime long, ticketupdatetime long, balancemode long")  # fmt: skip
    shuffled = sorted(rows_, key=lambda r: r[5] + rng.randrange(2000) * bool(order))
    # the last row moves the clock past everything
    shuffled.append((999, "z", "t", "none", "", 1_000_000, 3, 1, 1, 1, 1, 1, 1, 0))
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for at in range(0, len(shuffled), 60):
        spark.createDataFrame(shuffled[at : at + 60], schema).coalesce(1).write.mode("append").parquet(path)
        live = jobs.stream_tail(spark, path, spark.read.parquet(path).schema)
        jobs.catch_up(jobs.correlate(live, [GEN1, GEN2, IOT], delay="2000 seconds"), out, cp)
    got = sorted((r.rule, json.loads(r.group)["id1"], json.loads(r.group).get("alarmid"), r.event, r["at"], r.seq, r.n) for r in spark.read.parquet(out).collect())
    want = []
    balance = lambda r: 1 if r[13] == 0 or r[6] == 3 else -1
    sets = lambda r: json.dumps({"window": r[8], "immediate": r[9], "defer_count": r[10], "defer_time": r[11], "refresh": r[12]})
    late = lambda r: json.dumps({"window": r[8], "defer_time": r[11], "refresh": r[12]})
    for rule, use, key, step, settings in (
        (GEN1, lambda r: r[3] == "any.1", lambda r: (r[1], None), lambda r: 1, lambda r: None),
        (GEN2, lambda r: r[4] != "", lambda r: (r[1], r[3]), balance, sets),
        (IOT, lambda r: r[3] == "IoT.1", lambda r: (r[1], r[3]), lambda r: 1, late),
    ):
        groups = {}
        for r in rows_:
            if use(r):
                groups.setdefault(key(r), []).append((r[5], r[0], r[7], step(r), r[6], 1, r[0], settings(r)))
        for k, alarms_of in groups.items():
            events = step_group(GroupMemory(), by_second(alarms_of), rule, 1_000_000 - 2000)
            want += [(rule.id, *k, e, at, seq, n) for e, at, seq, _, n in events]
    assert got == sorted(want, key=lambda w: tuple("" if x is None else x for x in w)) or sorted(map(str, got)) == sorted(map(str, want))
    assert len(want) > 20


def test_thresholds_of_restricted_accounts(spark):
    assets = spark.createDataFrame([("o", "1"), ("o", "2"), ("o", "3")], "level string, id string")
    up = spark.createDataFrame([("o", str(i), "c", "cust") for i in (1, 2, 3)], "level1 string, id1 string, level2 string, id2 string")
    attrs = spark.createDataFrame([("o", "1", "custpriv", "xT"), ("o", "2", "custpriv", "x")], "level string, id string, key string, val string")
    rule = joins.ThresholdRule("cpu", "spec", ".*", account="a")

    def matched(**kw):
        out = joins.threshold_match(assets, up, attrs, [rule], {"a": [("c", "cust")]}, **kw)
        return sorted(r.id for r in out.collect())

    assert matched() == ["1", "2", "3"]
    assert matched(restricted={"a"}) == ["1", "3"]


def test_event_elements_keep_malformed_lines_apart(spark):
    from opsloom.sources.readers import parse_event_xml

    good = "<stat><rt>5</rt><lv>o</lv><id>a&#x26;b</id><key>cpu</key><num>1.5</num></stat>"
    bad = ["<stat><rt>5</rt>", "noise", "<stat><rt>x</rt></stat>", "<alarm><ti>1</ti></alarm>"]
    ok, rest = parse_event_xml(spark.createDataFrame([(x,) for x in [good, *bad]], "value string"), "stat")
    assert [(r.timeissued, r.id, r.val, r.label) for r in ok.collect()] == [(5, "a&b", 1.5, "")]
    assert sorted(r.value for r in rest.collect()) == sorted(bad)


def test_delimited_escapes_and_skips(spark, tmp_path):
    from opsloom.model import struct
    from opsloom.sources.readers import parse_delimited, read_delimited

    schema = struct("a string, b int")
    lines = spark.createDataFrame([(r"x\|y|7",), ("only",), ("p|q|r",)], "value string")
    got = [tuple(r) for r in parse_delimited(lines, schema, "|", "simple").collect()]
    assert got == [("x|y", 7), ("only", None), ("p", None)]
    for i in (1, 2):
        (tmp_path / f"f{i}").write_text(f"title\nmore\nr{i};{i}\n")
    got = sorted(tuple(r) for r in read_delimited(spark, str(tmp_path), schema, ";", skip=2).collect())
    assert got == [("r1", 1), ("r2", 2)]


def test_a_hundred_conditions(spark):
    attrs = spark.createDataFrame([("o", "1", f"k{i}", "v") for i in range(100)] + [("o", "2", f"k{i}", "v") for i in range(99)], "level string, id string, key string, val string")
    conds = [(f"k{i}", "^v$") for i in range(100)]
    assert [r.id for r in joins.attr_conditions(attrs, conds).collect()] == ["1"]
    up = spark.createDataFrame([("o", i, f"l{k}", "x") for i in ("1", "2") for k in range(100 if i == "1" else 99)] + [("o", i, "c", "cust") for i in "12"], "level1 string, id1 string, level2 string, id2 string")
    scope = [graph.NodeCondition(f"l{k}", "x") for k in range(100)]
    rows_ = spark.createDataFrame([("o", "1"), ("o", "2")], "level1 string, id1 string")
    assert [r.id1 for r in graph.propagate_filter(rows_, up, scope).collect()] == ["1"]
    assets = rows_.toDF("level", "id")
    nodes = attrs.limit(0)
    assert [r.id for r in graph.select_nodes(assets, up, nodes, scope, "c").collect()] == ["1"]
    rule = joins.ThresholdRule("cpu", "spec", ".*", account="a")
    got = joins.threshold_match(assets, up, nodes, [rule], {"a": [(f"l{k}", "x") for k in range(100)]})
    assert [r.id for r in got.collect()] == ["1"]


def test_long_chains_branches_and_cycles(spark):
    rng = random.Random(11)
    chain = [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(1500)]
    dag = [(f"d{a}", f"d{b}") for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(60)) if a < b]
    pairs = chain + dag + [("n00700", "d0"), ("d29", "z"), ("solo", "solo")]
    layers, left = graph.topological_layers(spark.createDataFrame(pairs, "before string, after string"))
    got = {r.node: r.layer for r in layers.collect()}
    exp = {n: 0 for p in pairs for n in p}
    for _ in range(len(exp)):
        nxt = dict(exp)
        for a, b in pairs:
            if a != b:
                nxt[b] = max(nxt[b], exp[a] + 1)
        if nxt == exp:
            break
        exp = nxt
    assert got == exp and left.isEmpty()
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y"), ("x", "e")], "before string, after string")
    layers, left = graph.topological_layers(ring)
    assert {r.node: r.layer for r in layers.collect()} == {"x": 0, "y": 1}
    assert {(r.before, r.after) for r in left.collect()} >= {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")}


def test_a_hub_with_a_third_of_the_edges(spark, many_chunks):
    rng = random.Random(7)
    edges = [(0, i) for i in range(1, 400)] + [(rng.randrange(400, 1200), rng.randrange(400, 1200)) for _ in range(700)]
    df = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in edges], "id1 string, id2 string").selectExpr("'o' as level1", "id1", "'o' as level2", "id2")
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = {int(r.ndid): int(r.ccid) for r in graph.connected_components(df).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_one_parser_whatever_is_skipped(spark, tmp_path):
    from pyspark.sql import types as T

    from opsloom.sources.readers import parse_delimited, read_delimited, skip_lines

    body = ['"q|z"|3', "a\\|b|4", "", "plain|5"]
    schema = T.StructType.fromDDL("name string, n bigint")
    want = sorted(map(tuple, parse_delimited(spark.createDataFrame([(b,) for b in body], "value string"), schema).collect()), key=str)
    for skip in (0, 1, 3):
        path = tmp_path / str(skip)
        path.mkdir()
        for name in ("x", "y"):
            (path / name).write_text("\n".join([f"h{i}" for i in range(skip)] + body) + "\n")
        got = sorted(map(tuple, read_delimited(spark, str(path), schema, skip=skip).collect()), key=str)
        assert got == sorted(want * 2, key=str)
    many = tmp_path / "many"
    many.mkdir()
    (many / "f").write_text("".join(f"{i:06d}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = spark.read.text(str(many))
        assert lines.rdd.getNumPartitions() > 8
        assert sorted(int(r.value) for r in skip_lines(lines, 333).collect()) == list(range(333, 5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_escapes_other_than_punctuation_are_unsure(spark):
    for rx, text_ in ((r"\x41BC", "ABC"), (r"a\tb", "a\tb"), (r"\QABC\E", "ABC"), (r"ABC\.d", "ABC.d"), (r"\101BC", None)):
        lit = joins.longest_literal(rx)
        assert text_ is None or lit in text_
    df = spark.createDataFrame([("ABC",)], "text string").selectExpr("'' as alarmid", "text", "'x' as id1")
    assert joins.rule_match_first(df, [joins.AlarmRule("r", r"\x41BC")]).first()["rule"] == 0


def test_groups_that_look_alike_stay_apart(spark):
    from opsloom.operators import aggs

    rows_ = [("a,b", "c", 1.0), ("a", "b,c", 2.0), (None, "", 3.0), ("", "", 4.0), ("OVERFLOW", "", 5.0)]
    df = spark.createDataFrame(rows_, "x string, y string, v double")
    assert sorted((r.group, r["sum"]) for r in aggs.stats(df, ["x", "y"], ["v"]).collect()) == [(",", 3.0), (",", 4.0), ("OVERFLOW,", 5.0), ("a,b,c", 1.0), ("a,b,c", 2.0)]
    out = {(r.group, r["sum"]) for r in aggs.stats(df, ["x"], ["v"], max_groups=2, first_by=["v"]).collect()}
    assert out == {("a,b", 1.0), ("a", 2.0), ("OVERFLOW", 12.0)}


def test_smallest_reads_its_input_once(spark):
    from opsloom.functions.text import smallest

    df = spark.range(100).selectExpr("id % 3 as k", "string(id % 10) as v").repartition(2)
    out = smallest(df, ["k"], "v", 6)
    assert {r.k: r.vs for r in out.collect()} == {k: [str(i) for i in range(6)] for k in range(3)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_head_has_one_rule_for_any_size(spark, many_chunks):
    df = spark.range(5000).selectExpr("id", "id % 7 as k", "id % 3 as tie").repartition(9)
    small = [r.id for r in sorts.head(df, 40, ["tie"], by=["k"]).collect()]
    large = [r.id for r in sorts.head(df, 1200, ["tie"], by=["k"]).collect()]
    assert set(small) <= set(large) and len(small) == 280 and len(large) == 5000
    assert sorted(r.id for r in sorts.head(df, 10, [F.col("id").desc()], skip=5).collect()) == list(range(4985, 4995))
    assert sorts.head(df, 10, ["id"]).columns == df.columns


def test_ipv6_text_and_neighbours(spark):
    rng = random.Random(13)
    nums = [0, 1, (1 << 128) - 1, 0xFFFF << 32, (0xFFFF << 32) + 0x01020304, 1 << 32, (1 << 64) - 1, 0x10002, 5 << 112]
    for _ in range(300):
        groups = [rng.choice([0, 0, 0, 1, 0xFFFF, rng.randrange(1 << 16)]) for _ in range(8)]
        nums.append(sum(g << (16 * i) for i, g in enumerate(groups)))
    import socket

    packed = [n.to_bytes(16, "big") for n in nums]
    good = [socket.inet_ntop(socket.AF_INET6, p) for p in packed] + [str(ipaddress.IPv6Address(p).exploded) for p in packed]
    bad = ["", "1", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "::1.2.3.400", "1:2:3:4:5:6:7:8::", "1.2.3.4:1"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string").repartition(3)

    def parsed(t):
        try:
            return socket.inet_pton(socket.AF_INET6, t)
        except OSError:
            return None

    for r in df.select("t", net.ip6_parse(F.col("t")).alias("b")).collect():
        assert (bytes(r.b) if r.b is not None else None) == parsed(r.t), r.t
    rows_ = spark.createDataFrame([(bytearray(p), rng.randrange(129)) for p in packed], "a binary, n int")
    out = rows_.select(
        "a", "n", net.ip6_format(F.col("a")).alias("t"), net.ip6_next(F.col("a")).alias("up"), net.ip6_prev(F.col("a")).alias("down"),
        net.network6(F.col("a"), F.col("n")).alias("lo"), net.broadcast_address6(F.col("a"), F.col("n")).alias("hi"),
    )
    for r in out.collect():
        n = int.from_bytes(r.a, "big")
        host = (1 << (128 - r.n)) - 1
        assert r.t == socket.inet_ntop(socket.AF_INET6, bytes(r.a))
        assert bytes(r.up) == ((n + 1).to_bytes(16, "big") if n + 1 < 1 << 128 else net.V6_END)
        assert n == 0 or int.from_bytes(r.down, "big") == n - 1
        assert (int.from_bytes(r.lo, "big"), int.from_bytes(r.hi, "big")) == (n & ~host, n | host)
    pairs = [tuple(sorted(rng.sample(nums, 2))) for _ in range(60)] + [(0, (1 << 128) - 1), (5, 5), (0, 0), ((1 << 128) - 1,) * 2]
    pairs += [(n, n + rng.randrange(300)) for n in nums[9:60] if n < 1 << 127]
    rng_df = spark.createDataFrame([(bytearray(a.to_bytes(16, "big")), bytearray(b.to_bytes(16, "big"))) for a, b in pairs], "lo binary, hi binary")
    for r in rng_df.select("lo", "hi", net.range_cidrs6(F.col("lo"), F.col("hi")).alias("p")).collect():
        exp = ipaddress.summarize_address_range(ipaddress.IPv6Address(bytes(r.lo)), ipaddress.IPv6Address(bytes(r.hi)))
        assert [(bytes(x.addr), x.len) for x in r.p] == [(n.network_address.packed, n.prefixlen) for n in exp]
    whole = prefixes.size6(rng_df.limit(0).unionByName(spark.createDataFrame([(bytearray(16), bytearray(b"\xff" * 16))], "lo binary, hi binary"))).first()
    assert tuple(whole) == (1, str(1 << 64), "0", 1)


def test_routes_of_both_families_and_rejects(spark):
    from opsloom.sources.readers import parse_routes

    lines = ["*> 10.1.0.0/16 10.0.0.1 7018 {5,6} 9 i", "*>i2001:db8::/32 2001:db8::1 7018 5 e", "2001:db8::/129 ::1 7", "noise", ""]
    rows_, rejects = parse_routes(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = sorted((r.family, r.len, list(r.path), r.origin) for r in rows_.collect())
    assert got == [(4, 16, [7018, 5, 6, 9], "i"), (6, 32, [7018, 5], "e")]
    assert sorted(r.value for r in rejects.collect()) == sorted(lines[2:])


def test_whole_patterns_and_profile_times(spark):
    from opsloom.plans import dashboard

    alarms_ = spark.createDataFrame([("cc1", 1, 1, "t", ""), ("cc10", 1, 1, "t", "")], "ccid string, severity int, tmode int, text string, comment string")
    assert [r.ccid for r in alarms_.where(dashboard.alarm_predicate([("ccid", "cc1"), ("severity", "CRITICAL"), ("ticket", "keep")])).collect()] == ["cc1"]
    assert alarms_.where(dashboard.alarm_predicate([("ticket", "KEEP")])).count() == 0
    s = spark.createDataFrame([("o", "1", "k", f, 1000 + f * 100, 1.0, "") for f in range(4)], "level string, id string, key string, frame int, timeissued long, val double, label string")
    p = spark.createDataFrame([("o", "1", "k", f, 5.0, "___mean___") for f in range(4)], "level string, id string, key string, frame int, val double, label string")
    up = spark.createDataFrame([("o", "1", "n", "x")], "level1 string, id1 string, level2 string, id2 string")
    got = dashboard.query_stats_profile(s, p, times=[(1200, 1300)], closure=up, out_level="n").collect()
    assert sorted((r.label, r.frame, r.timeissued) for r in got) == [("", 2, 1200), ("", 3, 1300), ("___mean___", 0, 1200), ("___mean___", 1, 1200), ("___mean___", 2, 1200), ("___mean___", 3, 1300)]


def test_breaches_at_one_time_count_once_in_stream_and_batch(spark, tmp_path):
    from opsloom.streaming import jobs

    rule = stats.parse_rule("SIGMA:i:1:n::1:2:3:1:0;CLEAR:5:2:2")
    rng = random.Random(5)
    rows_ = [("o", str(k), "m", t, rng.choice([-1, 1, 1]), 1.0 + t % 3) for k in range(4) for t in [1000 + rng.randrange(60) * 10 for _ in range(70)]]
    rows_ += [("o", "two", "m", 1005, 1, 2.0), ("o", "two", "m", 1005, 1, 3.0)]
    schema = "level string, id string, key string, timeissued long, sev int, score double"
    batch = profile_alarms.alarm_state_changes(spark.createDataFrame(rows_, schema), rule).where("kind <> 'repeat'")
    rows_.sort(key=lambda r: r[3] + rng.randrange(100))
    rows_.append(("o", "clock", "m", 100_000, -1, 0.0))
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for at in range(0, len(rows_), 90):
        spark.createDataFrame(rows_[at : at + 90], schema).coalesce(1).write.mode("append").parquet(path)
        live = jobs.stream_tail(spark, path, spark.read.parquet(path).schema)
        jobs.catch_up(jobs.profile_alarms(live, rule, delay="100 seconds"), out, cp)
    key = lambda df: sorted((r.id, r.timeissued, r.kind, r.severity) for r in df.where("id <> 'clock'").collect())
    assert key(spark.read.parquet(out).where("kind <> 'repeat'")) == key(batch)
    assert "two" not in {r.id for r in batch.where("kind = 'alarm'").collect()}


def test_heartbeat_moves_groups_without_data(spark, tmp_path):
    """Processing time alone brings the delayed ticket."""
    import time

    from opsloom.streaming import jobs

    rule = CorrelationRule("hb", "true", ("id1",), window=60, first_delay=2)
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    now = int(time.time())
    spark.createDataFrame([(1, "a", now, 3, 2)], "seq long, id1 string, timeissued long, state int, severity int").coalesce(1).write.parquet(path)
    live = jobs.stream_tail(spark, path, spark.read.parquet(path).schema)
    events = jobs.correlate(live, [rule], heartbeat=1)
    run = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(processingTime="1 second").start()
    try:
        until, got = time.time() + 60, []
        while not got and time.time() < until:
            time.sleep(1)
            got = spark.read.schema(events.schema).parquet(out).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    finally:
        run.stop()
    assert [(r.event, r["at"], r.seq) for r in got] == [("first", now + 2, 1)]


def test_equal_times_are_one_sample(spark):
    rule = stats.parse_rule("SIGMA:i:1:n::1:2:3:1:0;CLEAR:5:2:2")
    rows_ = [("o", "x", "m", t, sev, 1.0) for t, sev in ((5, 1), (5, 1), (5, -1), (9, -1), (9, 1))]
    got = stats.m_of_n_alarm(spark.createDataFrame(rows_, "level string, id string, key string, timeissued long, sev int, score double"), rule)
    assert sorted((r.timeissued, r.sev, r.r0) for r in got.collect()) == [(5, 1, False), (9, 1, True)]


@pytest.mark.parametrize("per_chunk", [1, 6, 50_000])
def test_flat_and_nested_segments(spark, per_chunk):
    from opsloom.operators import intervals

    rng = random.Random(per_chunk)
    rows_ = [(None, 4, "a", -1), (9, 8, "a", -2), (5, None, "b", -3)]
    for i in range(90):
        lo = rng.choice([7, 7, rng.randrange(300)])  # a hot start
        rows_.append((lo, lo + rng.choice([0, 1, 5, 200, rng.randrange(300)]), rng.choice([None, "a", "b"]), i))
    rows_ += rows_[20:30]
    df = spark.createDataFrame(rows_, "s long, e long, v string, o long").repartition(3)

    def plainly(key):
        at = {}
        for s, e, v, _ in sorted((r for r in rows_ if None not in r[:2]), key=key):
            at |= dict.fromkeys(range(s, e + 1), v)
        out = []
        for x in sorted(x for x, v in at.items() if v is not None):
            if out and out[-1][1] == x - 1 and out[-1][2] == at[x]:
                out[-1][1] = x
            else:
                out.append([x, x, at[x]])
        return [tuple(r) for r in out]

    key = lambda d: sorted((r.lo, r.hi, r.value) for r in d.collect())
    assert key(intervals.flat_segments(df, "s", "e", "v", "o", per_chunk)) == plainly(lambda r: r[3])
    nested = intervals.nested_segments(df, "s", "e", "v", "o", per_chunk)
    assert key(nested) == plainly(lambda r: (r[0] - r[1], r[3]))
    points = spark.createDataFrame([(x,) for x in range(0, 320, 7)], "p long")
    want = {x: v for lo, hi, v in plainly(lambda r: (r[0] - r[1], r[3])) for x in range(lo, hi + 1)}
    got = {r.p: r.value for r in intervals.innermost_join(points, "p", nested, how="left").collect()}
    assert got == {x: want.get(x) for x in range(0, 320, 7)}


def test_indexed_rules_equal_the_ladder(spark, monkeypatch):
    """Random large tables: the first match, overrides and filters are those of one CASE."""
    rng = random.Random(8)
    pats = ["disk_[0-9] usage at {n}%", "host{n} .*down", "(a|b){n}x?", "link {n}-[0-9]+ (up|down)", ".*error {n}.*", "[a-z]+{n}", r"node\.{n}: ok+", r"\Qq{n}\E"]
    k = 70
    some = lambda: rng.choice(pats).replace("{n}", str(rng.randrange(25)))
    rules = [
        joins.AlarmRule("__ANY__" if i == 20 else f"r{rng.randrange(k)}", some(), rng.choice([None, None, "obj[0-3]", f"o{rng.randrange(5)}.*"]), state=i % 5, severity=i % 3)
        for i in range(k)
    ]
    filters = [
        joins.FilterRule(obj=rng.choice([".*", "obj[0-2]"]), text=rng.choice([".*", some()]), alarmid=rng.choice([".*", f"r{rng.randrange(9)}"]), account=f"a{i}", start=100, end=100 + rng.randrange(60), severity=i % 4)
        for i in range(k)
    ]
    rows_ = []
    for i in range(500):
        m = rng.randrange(25)
        t = rng.choice([f"disk_{m % 10} usage at {m}%", f"host{m} is down", f"a{m}x", f"link {m}-4 up", f"big error {m} here", f"zz{m}", f"node.{m}: okkk", f"q{m}", "nothing", None, ""])
        rows_.append((i, rng.choice(["", "", None, f"r{rng.randrange(k)}", "unknown"]), t, rng.choice(["obj1", "o3xx", None, "zz"]), 100 + i % 50, 1, 1, 1, 3, "c", "v"))
    df = spark.createDataFrame(rows_, "seq long, alarmid string, text string, id1 string, timeissued long, tmode int, smode int, severity int, state int, comment string, variables string")
    got = []
    for ladder in (10**6, 10):
        monkeypatch.setattr(joins, "LADDER", ladder)
        matched = joins.rule_apply_overrides(joins.rule_match_first(df, rules), rules)
        got.append([sorted(map(str, d.collect())) for d in (matched, joins.filter_rule_match(df, filters))])
    assert got[0] == got[1]
    assert sum("rule=None" not in r for r in got[0][0]) > 50 and sum("account=None" not in r for r in got[0][1]) > 10


def test_runs_that_patterns_need():
    from opsloom.operators.rule_index import needed_runs

    assert needed_runs("abc[0-9]+de?f") == ["abc", "d", "f"]
    assert needed_runs("(?:xy)+z|q") == needed_runs("(a|b)") == needed_runs("(?i)abc") == needed_runs(r"\Qab\E") == []
    assert needed_runs(r"a\.b(cd){2}") == ["a.b", "cd"]


def test_late_days_are_merged_and_others_left_alone(spark, tmp_path):
    import datetime as dt
    import os

    from opsloom.streaming import hours

    store = str(tmp_path / "store")
    schema = "level string, id string, key string, unit string, frame int, timeissued long, val double"
    day = 86_400
    point = lambda d, h, frame, val: ("o", "a", "k", "u", frame, d * day + h * 3600, val)
    today = lambda epoch: dt.date(1970, 1, 1) + dt.timedelta(days=100 + epoch)
    step = hours.ingest(store, today, open_days=2, max_age_days=10)

    def batch(*rows):
        return spark.createDataFrame(list(rows), schema)

    def files():
        return {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(f"{store}/hours") for f in fs if f.endswith(".parquet")}

    def stored_rows():
        return sorted((r.event_date.toordinal() - dt.date(1970, 1, 1).toordinal(), r.event_hour, r.frame, r.val) for r in spark.read.parquet(f"{store}/hours").collect())

    step(batch(point(100, 1, 0, 1.0), point(100, 1, 0, 2.0), point(100, 2, 0, 3.0), point(95, 5, 0, 4.0), point(80, 5, 0, 9.0)), 0)
    assert stored_rows() == [(95, 5, 0, 4.0), (100, 1, 0, 2.0), (100, 2, 0, 3.0)]  # day 80 is too old
    before = files()
    late = batch(point(95, 5, 0, 7.0), point(95, 5, 1, 8.0), ("o", "a", "k", "u", 0, None, 1.0))
    for _ in range(2):  # repeated, as after a crash
        step(late, 1)
        assert stored_rows() == [(95, 5, 0, 7.0), (95, 5, 1, 8.0), (100, 1, 0, 2.0), (100, 2, 0, 3.0)]
    after = files()
    assert {f: t for f, t in before.items() if "1970-04-11" in f} == {f: t for f, t in after.items() if "1970-04-11" in f}
    assert {r.event_date.toordinal() - dt.date(1970, 1, 1).toordinal(): r.reopened for r in hours.touched_dates(spark, store, 1).collect()} == {95: True}
    assert spark.read.parquet(f"{store}/rejected").count() == 2
    step(batch(), 2)
    assert files() == after


def test_escaped_backslashes_before_separators(spark):
    from pyspark.sql import types as T

    from opsloom.sources import readers

    schema = T.StructType.fromDDL("a string, b string, c string")
    lines = ["x|y|z", r"x\|y|z", r"x\\|y|z", r"x\\\|y|z", "||", "\\"]
    df = spark.createDataFrame([(line,) for line in lines], f"`{readers.LINE}` string")
    got = [tuple(r) for r in readers.parse_delimited(df, schema).collect()]
    assert got == [("x", "y", "z"), (r"x\|y", "z", None), (r"x\\", "y", "z"), (r"x\\\|y", "z", None), ("", "", ""), ("\\", None, None)]


def test_following_stops_when_idle(spark, tmp_path):
    """Files arrive twice, then it stops by itself; the next run goes on from there."""
    import threading
    import time

    from opsloom.streaming import jobs

    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put = lambda a, b: spark.range(a, b).coalesce(1).write.mode("append").parquet(path)
    put(0, 10)
    live = jobs.stream_tail(spark, path, spark.read.parquet(path).schema)
    later = threading.Timer(2, put, (10, 25))
    later.start()
    start = time.monotonic()
    assert jobs.follow(live, out, cp, idle=5) == 25
    later.join()
    assert time.monotonic() - start >= 5 and not any(q.isActive for q in spark.streams.active)
    put(25, 30)
    assert jobs.follow(live, out, cp, idle=3) == 5
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(30))


def test_user_aggregate_reduces_a_hot_key_in_the_map_tasks(spark):
    """Random keys, null ones too, and a key with most rows: results as in plain Python, at any number of keys that a task holds."""
    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([0, 1, None]), rng.choice([None, *map(float, range(60))])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "key string, __k1 int, val double").repartition(6)
    want = {}
    for k, f, v in rows:
        want.setdefault((k, f), set()).update([v] if v is not None else [])
    want = {k: tuple([*sorted(v, reverse=True), None, None][:2]) for k, v in want.items()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for held in (0, 2, 50_000):
            got = callbacks.user_aggregate(df, ["key", "__k1"], callbacks.second_largest(), ["val"], held=held).collect()
            assert len(got) == len(want) and {(r.key, r["__k1"]): (r.top, r.val) for r in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    total = callbacks.user_aggregate(df, [], callbacks.second_largest(), ["val"]).collect()
    assert [(r.top, r.val) for r in total] == [(59.0, 58.0)]
    assert callbacks.user_aggregate(df.limit(0), ["key"], callbacks.second_largest(), ["val"]).collect() == []
    # a task sends one row per key on, whatever its rows
    plan = callbacks.user_aggregate(df.where("key = 'hot'").select("key", "val"), ["key"], callbacks.second_largest(), ["val"])
    text = plan._jdf.queryExecution().toString()
    early, shuffle = text.rindex("MapInArrow early"), text.rindex("Exchange hashpartitioning(__k0")
    assert shuffle < early  # plans print from the result down: states are started below the shuffle
