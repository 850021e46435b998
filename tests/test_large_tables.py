"""What must hold so that work grows no faster than its tables: plans, and results on rows that take the other path."""

import ipaddress
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from opsloom.functions import net
from opsloom.model import ALARM
from opsloom.operators import graph, joins, prefixes, profile_alarms, stats
from opsloom.plans import dashboard
from opsloom.registry import inventory
from opsloom.sources import readers
from opsloom.streaming import groups, jobs


def plan(df):
    """What Spark will run, without figures of earlier runs."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def test_salted_copies_are_not_broadcast(spark):
    a = spark.createDataFrame([(i % 3, i) for i in range(40)], "k int, x int")
    b = spark.createDataFrame([(0, "n"), (1, "m"), (1, "m"), (None, "z")], "k int, y string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = joins.salted_join(a, b, ["k"], how)
        assert "Broadcast" not in plan(got)
        assert sorted(map(str, got.collect())) == sorted(map(str, a.join(b, ["k"], how).collect()))


def test_lines_are_split_once_below_the_filter(spark):
    broken = "1.1.1.1|2.2.2|x"
    lines = spark.range(3).select(F.concat(F.lit("1.2.3.4|5.6.7.8|9.9.9."), "id").alias("value")).unionByName(spark.createDataFrame([(broken,), (None,)], "value string"))
    good, rejects = readers.parse_flow(lines.repartition(1))
    assert sorted(r.hop_num for r in good.collect()) == [151587072, 151587073, 151587074]
    assert {r.value for r in rejects.collect()} == {broken, None}
    for df in (good, rejects):
        assert plan(df).count("split(value") == 1
    routes, _ = readers.parse_routes(spark.range(4).selectExpr("'*> 10.0.0.0/' || (id + 8) || ' 1.1.1.1 7 i' as value").repartition(1))
    assert plan(routes).count("regexp_extract(value") == 4
    assert sorted(r.len for r in routes.collect()) == [8, 9, 10, 11]


def test_separators_behind_many_backslashes(spark):
    lines = ["a|b", "|", "||a|", "", "a\\|b|c", "a\\\\|b|c", "\\|a", "\\\\|a", "|\\\\|\\|", "x" + "\\" * 1000 + "|y", "x" + "\\" * 999 + "|y"]
    fields = readers.struct("a string, b string, c string, d string")
    df = readers.parse_delimited(spark.createDataFrame([(x,) for x in lines], "value string"), fields, keep=("value",))

    def split(line):
        out, behind = [""], 0
        for ch in line:
            if ch == "|" and behind % 2 == 0:
                out.append("")
            else:
                out[-1] += ch
            behind = behind + 1 if ch == "\\" else 0
        return tuple((out + [None] * 4)[:4])

    assert {tuple(r)[0]: tuple(r)[1:] for r in df.collect()} == {x: split(x) for x in lines}
    # what is looked back for is tied to a separator
    assert "split(value" in plan(df) and "{0,500}" not in plan(df)


def test_ip6_reads_its_argument_once(spark):
    rng = random.Random(5)
    near = [rng.getrandbits(128) & rng.getrandbits(128) & (0xFFFF0000FFFF << rng.randrange(80)) for _ in range(60)]
    nums = [*near, *(rng.getrandbits(128) for _ in range(20)), 0, 1, (1 << 128) - 1, 0xFFFF01020304, 0x01020304]
    df = spark.createDataFrame([(str(ipaddress.IPv6Address(n)), bytearray(n.to_bytes(16, "big")), rng.randrange(129)) for n in nums], "t string, a binary, n int").repartition(1)
    back = df.select("t", "a", net.ip6_parse(net.ip6_format(net.ip6_parse(F.col("t")))).alias("b"))
    assert all(r.a == r.b for r in back.collect())
    whole = plan(df.select(net.ip6_parse(net.ip6_format(net.ip6_parse(F.concat("t", F.lit("")))))))
    assert whole.count("concat(t#") == 1
    ends = df.select("a", "n", net.network6(F.col("a"), F.col("n")).alias("lo"), net.broadcast_address6(F.col("a"), F.col("n")).alias("hi"))
    for r in ends.collect():
        want = ipaddress.IPv6Network((bytes(r.a), r.n), strict=False)
        assert (bytes(r.lo), bytes(r.hi)) == (want.network_address.packed, want.broadcast_address.packed)
    assert "conv(" not in plan(ends)
    odd = [(bytearray(16), None), (None, 3), (bytearray(4), 3)]
    assert {r[0] for r in spark.createDataFrame(odd, "a binary, n int").select(net.network6(F.col("a"), F.col("n"))).collect()} == {None}


def test_tables_with_a_row_per_asset_are_not_broadcast(spark, tmp_path):
    def kept(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    ids = [str(i) for i in range(30)]
    up = [("c", i, "n", "n1" if int(i) % 2 else "n2") for i in ids]
    up += [("c", i, "c", i) for i in ids] + [("n", n, "n", n) for n in ("n1", "n2")]
    closure = kept(up, "level1 string, id1 string, level2 string, id2 string", "closure")
    names = [("c", i, "name", "big") for i in ids] + [("n", "n1", "name", "Big one"), ("n", "n2", "name", "small")]
    nodes = kept([*names, ("c", "3", "segment", "S"), ("c", "4", "segment", "S")], "level string, id string, key string, val string", "nodes")
    chosen = graph.select_nodes(nodes, closure, nodes, [graph.NodeCondition("n", "big.*", by_name=True)], "n", [("segment", "S")])
    assert [tuple(r) for r in chosen.collect()] == [("n", "n1", "c", "3")]
    assert plan(chosen).count("BroadcastHashJoin") == 1  # the names of the one level that is asked for by name

    picked = kept([("n", "n1", "c", "3"), ("n", "n1", "c", "5")], "ilevel string, iid string, level string, id string", "picked")
    stats = kept([("c", i, "k", 1.0) for i in ids], "level string, id string, key string, val double", "stats")
    got = dashboard.query_stats(stats, closure, "n", selected=picked)
    assert sorted((r.id, r.iid) for r in got.collect()) == [("3", "n1"), ("5", "n1")]
    assert plan(got).count("BroadcastHashJoin") <= 1  # the entities of the level that is shown
    a = [("c", i, "c" if int(i) % 3 else "", "3" if int(i) % 3 else "") for i in ids]
    alarms = kept(a, "level1 string, id1 string, level2 string, id2 string", "alarms")
    whole = dashboard.query_alarms(alarms, closure, "n")
    assert len(whole.collect()) == 30 and "Broadcast" not in plan(whole)
    some = dashboard.query_alarms_by_asset(picked.select("level", "id"), alarms, closure, "n")
    assert sorted(r.id1 for r in some.collect()) == ["3", "5"] and "Broadcast" not in plan(some)


def test_query_alarms_leaves_echoes_out(spark, monkeypatch):
    """of a correlated record and its echo the query shows the record alone."""
    plain = {f.name: "" if f.dataType.typeName() == "string" else 1 for f in ALARM.fields}
    one = plain | {"level1": "o", "id1": "7", "ccid": "cc1", "text": "disk_1 full", "timeissued": 1704067300}
    rows = [
        one | {"seq": 1, "sortorder": 2, "text": "disk_2 full"}, one | {"seq": 2, "text": "disk_2 full"}, one | {"seq": 3},
        one | {"seq": 4, "sortorder": 2}, one | {"seq": 5}, one | {"seq": 6, "ccid": "cc2"}, one | {"seq": 7, "ccid": ""},
        # no echo of these: their correlated record does not fit
        one | {"seq": 8, "ccid": "cc3", "sortorder": 2, "text": "other"}, one | {"seq": 9, "ccid": "cc3", "text": "other"}, one | {"seq": 10, "ccid": "cc3"},
    ]
    schema = "seq bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ALARM.fields)
    alarms = spark.createDataFrame([tuple(r[c] for c in ["seq", *ALARM.fieldNames()]) for r in rows], schema)
    closure = spark.createDataFrame([("o", "7", "n", "n1"), ("o", "7", "r", "r1")], "level1 string, id1 string, level2 string, id2 string")
    selected = spark.createDataFrame([("n", "n1", "o", "7")], "ilevel string, iid string, level string, id string")
    monkeypatch.setattr(inventory.V, "alarm", lambda *_: alarms)
    monkeypatch.setattr(inventory.V, "closure", lambda *_: closure)
    monkeypatch.setattr(inventory, "_selected", lambda *_: selected)
    assert sorted(r.seq for r in entry.queries()["query_alarms"](spark, "").collect()) == [1, 2, 4, 5, 6, 7, 10]


def test_longest_match_compares_lengths_only(spark, tmp_path):
    rng = random.Random(9)
    table = [(a - a % (1 << 32 - n), n, f"{a}/{n}") for a, n in ((rng.randrange(1 << 32), rng.randrange(0, 12)) for _ in range(40))]
    spark.createDataFrame([(rng.randrange(1 << 32),) for _ in range(200)] + [(7,)] * 50 + [(None,)], "a long").write.parquet(f"{tmp_path}/a")
    df, t = spark.read.parquet(f"{tmp_path}/a"), spark.createDataFrame(table, "addr long, len int, name string")
    out = prefixes.lpm_join(df, "a", t, ["name"])
    rows = out.collect()
    assert len(rows) == 251
    for r in rows:
        fits = [] if r.a is None else [(n, name) for addr, n, name in table if r.a - r.a % (1 << 32 - n) == addr]
        longest = max((n for n, _ in fits), default=None)
        assert r.prefix_len == longest and (r.name is None if longest is None else (longest, r.name) in fits)
    assert "max_by" not in plan(out)


def test_an_address_is_not_shuffled_once_per_length(spark, monkeypatch):
    """one row per address goes to the prefix table; a filter that says yes too often, or always, changes nothing."""
    rng = random.Random(4)
    near = [0, 7, 255, 256, 1 << 31, (1 << 32) - 1]
    table = [(a - a % (1 << 32 - n), n) for a, n in ((rng.choice([rng.randrange(1 << 32), *near]), rng.choice([0, 1, 8, 24, 31, 32])) for _ in range(60))]
    pts = [*near, *(rng.randrange(1 << 32) for _ in range(80)), *(a + 1 for a, _ in table if a < (1 << 32) - 1), 7, 7]
    t4 = spark.createDataFrame([*[(a, n, f"{a}/{n}") for a, n in table], (7, None, "no"), (None, 8, "no")], "addr long, len int, name string")
    a4 = spark.createDataFrame([(p,) for p in [*pts, None]], "a long")
    wide = lambda n: bytearray((n << 64 | 5).to_bytes(16, "big"))
    t6 = spark.createDataFrame([*[(wide(a), n + 32, f"{a}/{n}") for a, n in table], (bytearray(4), 40, "no")], "addr binary, len int, name string")
    a6 = spark.createDataFrame([(wide(p),) for p in pts] + [(None,), (bytearray(4),), (bytearray(0),)], "a binary")
    for bits in ((16, 27), (6, 6), (7, 7)):
        monkeypatch.setattr(prefixes, "FILTER_BITS", bits)
        for rows, t, space, more in ((a4, t4, prefixes.V4, 0), (a6, t6, prefixes.V6, 32)):
            out = prefixes.lpm_join(rows, "a", t, ["name"], space=space)
            assert "Generate" not in plan(out)
            got = out.collect()
            assert len(got) == rows.count()
            for r in got:
                if r.a is None or more and len(r.a) != 16:
                    fits = []
                else:
                    n = int.from_bytes(r.a, "big") >> 64 if more else r.a
                    fits = [(m + more, f"{a}/{m}") for a, m in table if n - n % (1 << 32 - m) == a]
                longest = max(fits, default=(None, None))[0]
                assert r.prefix_len == longest and (r["name"] is None if longest is None else (longest, r["name"]) in fits)
    empty = prefixes.lpm_join(a4, "a", t4.where("addr < 0"), ["name"])
    assert len(empty.collect()) == len(pts) + 1 and {r.prefix_len for r in empty.collect()} == {None}


def test_series_are_stepped_by_parts(spark, tmp_path, monkeypatch):
    """a value of state per part, not per series; the changes are those of each series on its own, and silent ones are forgotten."""
    monkeypatch.setattr(jobs, "STATE_PARTS", 3)
    rule = stats.parse_rule("SIGMA:i:1:n::1:2:3:1:0;CLEAR:5:2:2")
    rng = random.Random(8)
    rows = [("o", f"s{k}", m, 1000 + 10 * t, rng.choice([-1, 1, 1]), 1.0 + t % 3) for k in range(20) for m in "ab" for t in rng.sample(range(60), 25)]
    schema = "level string, id string, key string, timeissued long, sev int, score double"
    batch = profile_alarms.alarm_state_changes(spark.createDataFrame(rows, schema), rule).where("kind <> 'repeat'")
    rows.sort(key=lambda r: r[3] + rng.randrange(50))
    late = [("o", f"s{k}", m, t, -1, 0.0) for k in range(2) for m in "ab" for t in (1700, 9000)] + [("o", "clock", "a", 9000, -1, 0.0)]
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (rows[:400], rows[400:], late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        live = jobs.stream_tail(spark, path, spark.read.parquet(path).schema)
        jobs.catch_up(jobs.profile_alarms(live, rule, delay="100 seconds", keep=1000), out, cp)
    key = lambda df: sorted((r.id, r.key, r.timeissued, r.kind, r.severity) for r in df.where("kind <> 'repeat' and timeissued < 1700").collect())
    assert key(spark.read.parquet(out)) == key(batch)
    kept = [r[0] for r in spark.read.format("statestore").load(cp).selectExpr("to_json(value)").collect()]
    assert 0 < len(kept) <= 3 and "s1" in "".join(kept) and "s5" not in "".join(kept)


def test_open_events_age_by_parts(spark, tmp_path, monkeypatch):
    """state and timers per part, not per node; raises, clears and aging are those of each node on its own."""
    monkeypatch.setattr(jobs, "STATE_PARTS", 2)
    rng, keep = random.Random(3), 500
    schema = "level string, id string, type int, t bigint"
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    want, open_, clock, sizes = [], {}, 0, []
    for begin in (1000, 1400, 1700, 2600):
        rows = [("n", f"k{rng.randrange(40)}", rng.choice([1, 1, 2, 3]), begin + 1 + rng.randrange(250)) for _ in range(60)]
        rows += [("n", "twice", 1, begin + 7), ("n", "twice", 2, begin + 7), (None, "k1", 1, begin + 9), ("n", "once", 1, 1003)][: 3 if sizes else 4]
        said = {}
        for level, id_, kind, t in rows:
            if kind in (1, 2):
                said[level, id_] = max(said.get((level, id_), (0, 0)), (t, -kind))
        for node, (t, kind) in said.items():
            want.append((*node, -kind, t))
            open_.pop(node, None)
            if kind == -1:
                open_[node] = t
        for clock in (clock, max(r[3] for r in rows)):
            for node, t in [x for x in open_.items() if x[1] + keep < clock]:
                want.append((*node, jobs.AGED, t))
                del open_[node]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        live = jobs.aging_events(jobs.stream_tail(spark, path, spark.read.parquet(path).schema), keep, time="t")
        query = live.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes += [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(spark.read.parquet(out).select("level", "id", "type", "at").collect()) == key(want)
    assert len([w for w in want if w[2] == jobs.AGED]) > 10 and len(open_) > 10
    assert 0 < max(sizes) <= 3 * 2  # a value and a timer, by key and by time, of each part


class _Store:
    """State of one key in memory, which counts what it is asked."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, 0, set()

    def getMapState(self, name, *_):
        return _Map(self)

    def getValueState(self, name, *_):
        return _Value(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class _Value:
    def __init__(self, store, name):
        self.store, self.name, self.value = store, name, None

    def get(self):
        self.store.calls += 1
        return self.value

    def update(self, value):
        self.store.calls += 1
        self.value = value

    def clear(self):
        self.store.calls += 1
        self.value = None


class _Map:
    def __init__(self, store):
        self.store, self.rows = store, {}

    def getValue(self, k):
        self.store.calls += 1
        return self.rows.get(k)

    def updateValue(self, k, v):
        self.store.calls += 1
        self.rows[k] = v

    def removeKey(self, k):
        self.store.calls += 1
        self.rows.pop(k, None)

    def iterator(self):
        self.store.calls += 1
        return iter([*self.rows.items()])


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _names(batches, slot):
    """(group, second) of the clears that are passed on for batches of (clock, seconds of groups, clears), and the state."""
    store, p, out = _Store(), groups.Names(), []
    p.init(store)
    for clock, seconds, clears in batches:
        rows = [Row(kind="name", rule="r", gid=g, timeissued=t, until=t + 1000, who=str(t), mode=None, id1=None, alarmid=None, at=None) for g, t in seconds]
        rows += [Row(kind="clear", rule=None, gid=None, timeissued=t, until=None, who=None, mode="all", id1="", alarmid="", at=0) for t in clears]
        out.append([(m.gid, m.t) for m in p.handleInputRows((slot,), iter(rows), _Clock(clock * 1000))])
    return out, store, p


def test_a_clear_of_everything_goes_to_groups_with_alarms_since_the_last_one():
    (first, second, third), store, p = _names([(0, [("a", 10), ("a", 50), ("b", 90)], [20, 30, 40, 60]), (65, [], [70, 80]), (85, [("b", 95)], [96, 200])], "all:3")
    assert sorted(first) == [("a", 20), ("a", 60)]
    assert second == [] and third == [("b", 96)]
    assert ("r", "a") not in p.names.rows
    rng = random.Random(4)
    for _ in range(200):
        moving = [(40 * k, [(rng.choice("ab"), 40 * k + rng.randint(1, 60)) for _ in range(rng.randrange(4))], [40 * k + rng.randint(1, 60) for _ in range(rng.randrange(3))]) for k in range(6)]
        out, _, _ = _names(moving, "all:0")
        sent = {m for one in out for m in one}
        clears = sorted({t for _, _, cs in moving for t in cs})
        want = {(g, min(t for t in clears if t >= s)) for _, ss, _ in moving for g, s in ss if clears and s <= clears[-1]}
        assert want <= sent and len([m for one in out for m in one]) <= 2 * sum(len(ss) for _, ss, _ in moving)


def test_names_of_a_batch_cost_one_read_and_one_write():
    many = [("a", t) for t in range(1, 400)]
    (passed,), store, p = _names([(0, many, [])], "o:x")
    assert passed == [] and p.names.rows == {("r", "a"): (1399, [])}
    assert store.calls <= 6


def test_states_of_a_service_are_evaluated_at_once_on_numbers(spark):
    edges = spark.createDataFrame([("c", "1", "o", x) for x in ("p1", "p2", "k1", None)] + [("c", "2", "o", "p3"), ("c", "2", "o", "p3")], "level1 string, id1 string, level2 string, id2 string")
    roles = spark.createDataFrame([("o", "p1", "s", "prod"), ("o", "p2", "s", "prod"), ("o", "k1", "s", "cons"), ("o", "p3", "s", "prod")], "level string, id string, service string, role string")
    states = [spark.createDataFrame(rows, "level string, id string") for rows in ([], [("o", "p1"), ("o", "p1")], [("c", "1")], [("o", "zz")])]
    numbered = graph.impact_graph(edges, roles, graph.connected_components(edges))
    got = graph.graph_impacts(numbered, states)
    assert sorted((r.state, r.cclevel, r.ccid, r.service, r.producers, r.lost_all, r.lost_some, r.severity) for r in got.collect()) == [
        (1, "c", "1", "s", 2, 1, 0, 3), (2, "c", "1", "s", 2, 2, 0, 1),
    ]
    assert dict(numbered.links.dtypes) == {"u": "bigint", "v": "bigint", "root": "bigint"}


def _smallest(edges):
    """Node to the smallest number it is connected with."""
    up = {x: x for u, v in edges if u != v for x in (u, v)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        if u != v:
            p, q = sorted((root(u), root(v)))
            up[q] = p
    return {x: root(x) for x in up}


def test_edges_are_written_once_and_contracted(spark, monkeypatch):
    rng = random.Random(11)
    pairs = [(f"s{rng.randrange(20)}", f"p{rng.randrange(150)}") for _ in range(1500)]
    df = spark.createDataFrame([("s", a, "p", b) for a, b in pairs], "level1 string, id1 string, level2 string, id2 string")
    rows = []

    def counted(table, *args):
        out = kept(table, *args)
        rows.append(out.count())
        return out

    kept = graph.stored
    monkeypatch.setattr(graph, "stored", counted)
    got = graph.connected_components(df).collect()
    n = len({a for a, _ in pairs}) + len({b for _, b in pairs})
    assert len(got) == n and {(r.cclevel, r.ccid, r.ndn) for r in got} == {("p", min(b for _, b in pairs), n)}
    assert len([k for k in rows if k > n]) == 1


def test_components_of_odd_graphs(spark, monkeypatch):
    rng = random.Random(12)
    shuffled = rng.sample(range(80), 80)
    graphs = [
        [(3, 3)], [(i, i + 1) for i in range(60)], [*zip(shuffled, shuffled[1:])], [*zip(rng.sample(range(90), 60), rng.sample(range(90), 60))],
        [(0, w) for w in range(50, 60)] + [(w, w - 40) for w in range(50, 60)] + [(9, 9), (70, 71), (71, 70), (70, 71)],
    ]
    edges = [(u + 1000 * k - 40, v + 1000 * k - 40) for k, one in enumerate(graphs) for u, v in one]
    for few in (graph.FEW_NODES, -1):
        monkeypatch.setattr(graph, "FEW_NODES", few)
        got = graph.number_components(spark.createDataFrame([*edges, (None, 1), (2, None)], "u long, v long")).collect()
        assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == _smallest(edges)
    assert graph.number_components(spark.createDataFrame([(3, 3)], "u long, v long")).collect() == []


def test_nodes_with_the_same_hash_are_told_apart(spark, monkeypatch):
    tried = []

    def weak(level, id_, seed):
        tried.append(seed)
        return F.length(id_).cast("long") if seed < 2 else F.xxhash64(F.lit(seed), level, id_)

    monkeypatch.setattr(graph, "_hashed", weak)
    edges = [("a", "1", "b", "1"), ("b", "1", "c", "2"), ("a", "4", "a", "5"), ("a", "4", "a", "4"), ("a", None, "b", "7"), (None, "8", "b", "9"), ("a", "5", "a", "4")]
    got = graph.connected_components(spark.createDataFrame(edges, "level1 string, id1 string, level2 string, id2 string"))
    assert sorted(map(tuple, got.collect())) == [("a", "1", "a", "1", 3), ("a", "4", "a", "4", 2), ("a", "5", "a", "4", 2), ("b", "1", "a", "1", 3), ("c", "2", "a", "1", 3)]
    assert max(tried) == 2
