"""Inventory graph: closure over levels, components, ordering, service impact."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, stored
from .aggs import distinct_first
from .joins import attr_conditions as by_attr
from .joins import holds_all, met_words
from .ordered import number_rows

FWD, REV = 1, 2
# The entity of unmapped assets and the service attribute.
UNKNOWN = "UNKNOWN"
SERVICE_ATTR = "gce_service"
SEP = "\u0001"  # sorts before every printable character


def inv_dedupe(df: DataFrame, keys: Sequence[str], first_by: Sequence[str]) -> DataFrame:
    """Unique nodes, edges or maps by key (give the endpoints for one per pair)."""
    return distinct_first(df, keys, first_by)


def map_reverse(df: DataFrame) -> DataFrame:
    """Swap the endpoints."""
    swap = {"level1": "level2", "id1": "id2", "level2": "level1", "id2": "id1"}
    return df.select(*[F.col(swap.get(c, c)).alias(c) for c in df.columns])


def first_attr_row(attrs: DataFrame, preferred: str = "name") -> DataFrame:
    """Per asset the row of the preferred attribute, else the first by key."""
    rank = F.struct((F.col("key") != preferred).alias("p"), F.col("key"), F.col("val"))
    out = attrs.groupBy("level", "id").agg(F.min_by(F.struct("key", "val"), rank).alias("__r"))
    return out.select("level", "id", "__r.key", "__r.val")


# --- levels -------------------------------------------------------------------------


def level_closure(pairs: DataFrame, transitive: Sequence[str] | None = None, full: bool = False) -> DataFrame:
    """Paths between all levels through transitive levels, one row per hop.

    ``pairs`` holds the direct (id1, id2) level relations. A path has the fewest
    hops; ties go to the first in level order. With ``full`` paths may also go
    against a relation. One round per hop: the paths found last are joined with the
    relations, and the first path to every new (start, end) is kept.
    """
    direct = pairs.select("id1", "id2").distinct()
    steps = direct.select(F.col("id1").alias("iid1"), F.col("id2").alias("iid2"), F.lit(FWD).alias("dir"))
    if full:
        steps = steps.unionByName(direct.select(F.col("id2").alias("iid1"), F.col("id1").alias("iid2"), F.lit(REV).alias("dir")))
    steps = stored(steps, "level-steps")
    hop = F.struct("iid2", "dir", "iid1")  # compared in this order
    here = (F.col("id1") == F.col("iid1")) & (F.col("iid2") != F.col("id1"))
    found = stored(
        steps.select(F.col("iid1").alias("id1"), "*").where(here).groupBy("id1", F.col("iid2").alias("id2")).agg(F.min(F.array(hop)).alias("path"))
    )
    rounds = [found]
    while not rounds[-1].isEmpty():
        inner = rounds[-1] if transitive is None else rounds[-1].where(F.col("id2").isin(list(transitive)))
        longer = inner.join(steps, F.col("id2") == F.col("iid1")).where("iid2 <> id1")
        longer = longer.groupBy("id1", F.col("iid2").alias("id2")).agg(F.min(F.concat("path", F.array(hop))).alias("path"))
        rounds.append(stored(longer.join(found, ["id1", "id2"], "left_anti")))
        found = found.unionByName(rounds[-1])
    one = found.select("id1", "id2", (F.size("path") == 1).cast("int").alias("orig"), F.posexplode("path").alias("index", "h"))
    return one.select("id1", "id2", "index", F.col("h.dir").alias("dir"), F.col("h.iid1").alias("iid1"), F.col("h.iid2").alias("iid2"), "orig")


def map_closure(
    nodes: DataFrame, maps: DataFrame, levels: DataFrame, targets: Sequence[str] | None = None, identity: bool = False
) -> DataFrame:
    """For every asset and target level the entities reached along the level path.

    ``levels`` is ``level_closure`` output. One equi join per hop, over all paths at
    once; paths that begin with the same hops share the rows of those hops, and rows
    of one asset that meet again are one row.
    """
    direct = maps.select("level1", "id1", "level2", "id2").distinct()
    step = direct.select(
        F.col("level1").alias("iid1"), F.col("id1").alias("at"), F.col("level2").alias("iid2"), F.col("id2").alias("to"), F.lit(FWD).alias("dir")
    ).unionByName(
        direct.select(F.col("level2").alias("iid1"), F.col("id2").alias("at"), F.col("level1").alias("iid2"), F.col("id1").alias("to"), F.lit(REV).alias("dir"))
    )
    own = nodes.select("level", "id").distinct()
    hops = levels if targets is None else levels.where(F.col("id2").isin(list(targets)))
    hop = F.struct("index", "iid1", "iid2", "dir")
    paths = hops.groupBy(F.col("id1").alias("level1"), F.col("id2").alias("level2")).agg(F.sort_array(F.collect_list(hop)).alias("path"))
    paths = stored(paths, "level-paths")
    longest = paths.agg(F.max(F.size("path"))).first()[0] or 0
    now = own.select(F.col("level").alias("level1"), F.col("id").alias("id1"), F.col("id").alias("at"), F.array().cast(paths.schema["path"].dataType).alias("done"))
    out = own.select(
        F.col("level").alias("level1"), F.col("id").alias("id1"), F.col("level").alias("level2"), F.col("id").alias("id2")
    ).where("true" if identity else "false")
    if identity and targets is not None:
        out = out.where(F.col("level2").isin(list(targets)))
    for k in range(1, longest + 1):
        ahead = paths.where(F.size("path") >= k).select(
            "level1", F.slice("path", 1, k - 1).alias("done") if k > 1 else F.array().cast(paths.schema["path"].dataType).alias("done"),
            F.slice("path", 1, k).alias("next"),
        ).distinct()
        ahead = ahead.withColumn("__h", F.element_at("next", -1)).select("level1", "done", "next", "__h.iid1", "__h.iid2", "__h.dir")
        now = now.join(ahead, ["level1", "done"]).join(step.hint("merge"), ["iid1", "iid2", "dir", "at"])
        now = now.select("level1", "id1", F.col("to").alias("at"), F.col("next").alias("done"))
        # several ways can only meet again from the second hop on
        now = stored(now.distinct() if k > 1 else now, "closure-hop")
        ends = paths.where(F.size("path") == k).select("level1", "level2", F.col("path").alias("done"))
        out = out.unionByName(now.join(ends, ["level1", "done"]).select("level1", "id1", "level2", F.col("at").alias("id2")))
    return out


def map_check(nodes: DataFrame, maps: DataFrame, required: Sequence[tuple[str, str]]) -> DataFrame:
    """Assets with no parent, or several, at a required level."""
    direct = maps.select("level1", "id1", "level2", "id2").distinct()
    n = direct.groupBy("level1", "id1", "level2").agg(F.count(F.lit(1)).alias("n"))
    want = F.explode(
        F.array(*[F.struct(F.lit(a).alias("level1"), F.lit(b).alias("level2")) for a, b in required])
    ).alias("w")
    need = (
        nodes.select("level", "id").distinct().select("level", F.col("id").alias("id1"), want)
        .where("level = w.level1")
        .select("w.level1", "id1", "w.level2")
    )
    out = need.join(n, ["level1", "id1", "level2"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    kind = F.when(F.col("n") == 0, F.lit("none")).otherwise(F.lit("multiple"))
    return out.where("n <> 1").withColumn("problem", kind)


# --- components ----------------------------------------------------------------------


#: Rows of numbers that are broadcast to all tasks; a table of more is met by a merge join.
FEW_NODES = 500_000


def _met(nodes: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(nodes) if rows <= FEW_NODES else nodes.hint("merge")


def number_components(edges: DataFrame) -> DataFrame:
    """(u, v) edges over numbers to (node, root), its smallest connected number; by contraction.

    In a round every node takes its smallest neighbour. The trees that come of it become one node
    each, and edges between trees are the edges of the next round. A tree has two
    nodes at least, so the nodes halve at worst, and in dense graphs nearly all edges go in the first round. All
    edges of a round are read for the minima, which are partial hash aggregates, and shuffled once per end, to
    meet one row per node, which AQE can split when a hub holds a large share of them.
    """
    edges = stored(edges.where("u <> v").select("u", "v"))
    return _contracted(edges, _nearest(edges))


def _nearest(edges: DataFrame) -> DataFrame:
    """(node, up): the smallest neighbour."""
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return stored(ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("up")), "near")


def _contracted(edges: DataFrame, near: DataFrame) -> DataFrame:
    """``number_components`` of edges with two ends and what is nearest in them; both are stored tables."""
    rounds = []
    while True:
        rows = near.count()
        trees = _tree_roots(near, rows)
        rounds.append((trees, rows))
        for end in ("u", "v"):
            edges = edges.join(_met(trees.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), rows), end)
        edges = edges.where("u_root <> v_root").select(F.greatest("u_root", "v_root").alias("u"), F.least("u_root", "v_root").alias("v"))
        edges = stored(edges.distinct(), "contracted")
        if edges.isEmpty():
            break
        near = _nearest(edges)
    found, rows = rounds.pop()
    while rounds:
        top = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        trees, more = rounds.pop()
        trees = trees.join(_met(top, rows), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        found, rows = stored(trees, "roots"), more
    return found


def _tree_roots(near: DataFrame, rows: int) -> DataFrame:
    """(node, root) of nodes that hang on their smallest neighbour, ``up``.

    Two steps up never lead to a larger number, so every tree ends in a pair that take each other, and the smaller of
    them is the smallest of the tree. Ways up double per round.
    """
    above = _met(near.select(F.col("node").alias("up"), F.col("up").alias("far")), rows)
    top = F.when(F.col("far") == F.col("node"), F.least("node", "up")).otherwise(F.col("far"))
    now = stored(near.join(above, "up").select("node", top.alias("up")), "trees")
    while True:
        above = _met(now.select(F.col("node").alias("up"), F.col("up").alias("far")), rows)
        now = stored(now.join(above, "up").select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")), "trees")
        if now.where("moved").isEmpty():
            return now.select("node", F.col("up").alias("root"))


def _hashed(level: Column, id_: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), level, id_)


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node that has an edge to another: its smallest (level, id), and the size.

    The rounds move and compare numbers only. They are hashes, so that no edge is joined for
    them; should two nodes have the same, others are taken. A null is no node.
    """
    e = stored(edges.where("level1 <> level2 or id1 <> id2").select("level1", "id1", "level2", "id2").dropna())
    one, two = e.toDF("level", "id", "level2", "id2"), e.toDF("level2", "id2", "level", "id")
    kind = dict(one.select("level", "id").unionByName(two.select("level", "id")).dtypes)  # equal nodes have equal hashes
    for seed in count():
        number = lambda level, id_: _hashed(F.col(level).cast(kind["level"]), F.col(id_).cast(kind["id"]), seed)  # noqa: E731, B023
        near = [ends.select("level", "id", number("level2", "id2").alias("up")) for ends in (one, two)]
        near = near[0].unionByName(near[1]).groupBy("level", "id").agg(F.min("up").alias("up"))
        nodes = stored(near.select("level", "id", number("level", "id").alias("node"), "up"), "nodes")
        rows, most = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)), F.max("k")).first()
        if not rows or most == 1:
            break
    numbered = e.select(number("level1", "id1").alias("u"), number("level2", "id2").alias("v"))
    roots = _contracted(numbered, nodes.select("node", "up"))
    placed = nodes.drop("up").join(_met(roots, rows), "node")
    named = placed.groupBy("root").agg(F.min(F.struct("level", "id")).alias("cc"), F.count(F.lit(1)).alias("ndn"))
    return placed.join(named, "root").select(
        F.col("level").alias("ndlevel"), F.col("id").alias("ndid"), F.col("cc.level").alias("cclevel"), F.col("cc.id").alias("ccid"), "ndn"
    )


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, head, off): nodes on an unbranched chain and how far they are from its head; and those that go in circles.

    A node hangs on the one before if that is its only predecessor, and it that one's only
    successor. Distances double per round, so the rounds grow with the logarithm of
    the longest chain; what has no head after as many rounds as there are bits in the
    number of nodes goes in a circle.
    """
    ins = edges.groupBy("after").agg(F.count(F.lit(1)).alias("i"), F.min("before").alias("before"))
    outs = edges.groupBy("before").agg(F.count(F.lit(1)).alias("o"))
    hangs = ins.where("i = 1").join(outs.where("o = 1"), "before").select(F.col("after").alias("node"), F.col("before").alias("up"), F.lit(1).cast("long").alias("off"))
    now = stored(hangs, "chains")
    left = now.count()
    while left:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("off").alias("more"))
        step = now.join(above, "up", "left").select("node", F.coalesce("far", "up").alias("up"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"))
        now, left = stored(step, "chains"), left >> 1
    heads = now.select(F.col("node").alias("up")).distinct()
    return now.join(heads, "up", "left_anti").select("node", F.col("up").alias("head"), "off"), now.join(heads, "up", "left_semi").select("node")


def topological_layers(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layer of every node: the length of the longest chain before it.

    Returns (node, layer) and the pairs left over, which are those on or behind a
    cycle. Unbranched chains are contracted first. Then one round per layer of what is
    left, until nothing is free; every round appends its nodes to one table.
    """
    spark = pairs.sparkSession
    p = pairs.select("before", "after")
    nodes = p.select(F.col("before").alias("node")).unionByName(p.select(F.col("after").alias("node"))).distinct()
    nodes = stored(nodes, "nodes")
    edges = stored(p.where("before <> after").distinct(), "edges")
    chains, circles = _chains(edges)
    chains, circles = stored(chains, "chains"), stored(circles, "circles")
    place = nodes.join(circles, "node", "left_anti").join(chains, "node", "left")
    place = stored(place.select("node", F.coalesce("head", "node").alias("head"), F.coalesce("off", F.lit(0)).alias("off")), "places")
    # an edge that is not a link of a chain ends at a head
    up = place.select(F.col("node").alias("before"), F.col("head").alias("src"), F.col("off").alias("at"))
    links = chains.select(F.col("node").alias("after"))
    weighted = edges.join(links, "after", "left_anti").join(circles.select(F.col("node").alias("before")), "before", "left_anti").join(up, "before")
    left = stored(weighted.groupBy("src", F.col("after").alias("dst")).agg(F.max(F.col("at") + 1).alias("w")), "contracted")
    behind = edges.join(circles.select(F.col("node").alias("before")), "before", "left_semi").select(F.col("after").alias("dst")).distinct()
    todo = stored(place.select(F.col("head").alias("node")).distinct().withColumn("layer", F.lit(0).cast("long")), "todo")
    path = scratch_path(spark, "layers")
    todo.limit(0).write.parquet(path)
    blocked = stored(behind, "behind")
    while True:
        waits = left.select(F.col("dst").alias("node")).unionByName(blocked.select(F.col("dst").alias("node"))).distinct()
        free = stored(todo.join(waits, "node", "left_anti"), "free")
        if free.isEmpty():
            break
        free.write.mode("append").parquet(path)
        out = left.join(free.select(F.col("node").alias("src"), "layer"), "src")
        reach = out.groupBy(F.col("dst").alias("node")).agg(F.max(F.col("layer") + F.col("w")).alias("reach"))
        rest = todo.join(free.select("node"), "node", "left_anti").join(reach, "node", "left")
        todo = stored(rest.select("node", F.greatest("layer", F.coalesce("reach", F.lit(0).cast("long"))).alias("layer")), "todo")
        left = stored(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "contracted")
    heads = spark.read.schema(todo.schema).parquet(path)
    layers = place.join(heads.withColumnRenamed("node", "head"), "head").select("node", (F.col("layer") + F.col("off")).cast("int").alias("layer"))
    layers = stored(layers, "node-layers")
    over = edges.join(layers.select(F.col("node").alias("after")), "after", "left_anti").select("before", "after")
    return layers, over


def topological_sort(pairs: DataFrame) -> DataFrame:
    """A total order consistent with (before, after) pairs: by layer, then name.

    Raises on a cycle.
    """
    layers, cycle = topological_layers(pairs)
    if not cycle.isEmpty():
        raise ValueError(f"cycle through {cycle.first()['before']}")
    return number_rows(layers, ["layer", "node"], "position")


# --- selection -------------------------------------------------------------------------


@dataclass(frozen=True)
class NodeCondition:
    """An ancestor at ``level`` whose id (or name) matches the whole pattern."""

    level: str
    pattern: str
    by_name: bool = False
    force: bool = False


def _names(attrs: DataFrame) -> DataFrame:
    return attrs.where("key = 'name'").groupBy(F.col("level").alias("level2"), F.col("id").alias("id2")).agg(
        F.min("val").alias("__name")
    )


def _tests(conditions: Sequence[NodeCondition]) -> list[Column]:
    out = []
    for c in conditions:
        subject = F.coalesce("__name", "id2") if c.by_name else F.col("id2")
        rx = f"(?i)^(?:{c.pattern})$" if c.by_name else f"^(?:{c.pattern})$"
        out.append((F.col("level2") == c.level) & subject.rlike(rx))
    return out


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def select_nodes(
    nodes: DataFrame, closure: DataFrame, attrs: DataFrame, conditions: Sequence[NodeCondition],
    out_level: str, attr_conditions: Sequence[tuple[str, str]] = (), mode: str = "all",
) -> DataFrame:
    """Assets whose ancestors meet the conditions, re-keyed to ``out_level``.

    What has rows per asset is joined by a shuffle (hint "merge"): a file of ids is far smaller
    than its rows, so the planner would broadcast it. ``closure`` must include the identity. ``all``: every condition holds for some
    ancestor; ``exact``: any one unforced condition matching the asset itself
    suffices, forced ones must hold too, and assets are not re-keyed.
    """
    own = nodes.select(F.col("level").alias("level1"), F.col("id").alias("id1")).distinct()
    hits = closure.join(own.hint("merge"), ["level1", "id1"], "left_semi")
    if any(c.by_name for c in conditions):
        hits = hits.join(_names(attrs.where(F.col("level").isin([c.level for c in conditions if c.by_name]))), ["level2", "id2"], "left")
    else:
        hits = hits.withColumn("__name", F.lit(None).cast("string"))
    sel = own
    if conditions:
        every = [c for c in conditions if mode == "all" or c.force]
        some = [c for c in conditions if mode != "all" and not c.force]
        self_only = (F.col("level1") == F.col("level2")) & (F.col("id1") == F.col("id2"))
        agg = hits.groupBy("level1", "id1").agg(
            *met_words(_tests(every)), F.coalesce(F.bool_or(_any([self_only & t for t in _tests(some)])), F.lit(False)).alias("__some")
        )
        agg = agg.where(holds_all(range(len(every))))
        if some:
            agg = agg.where("__some")
        sel = agg.select("level1", "id1")
    if attr_conditions:
        ok = by_attr(attrs, [(k, f"^(?:{rx})$") for k, rx in attr_conditions])
        sel = sel.join(ok.withColumnsRenamed({"level": "level1", "id": "id1"}).hint("merge"), ["level1", "id1"], "left_semi")
    if mode != "all":
        return sel.select(F.col("level1").alias("ilevel"), F.col("id1").alias("iid"), F.col("level1").alias("level"), F.col("id1").alias("id"))
    up = closure.where(F.col("level2") == out_level).select("level1", "id1", "level2", "id2")
    return sel.join(up.hint("merge"), ["level1", "id1"]).select(
        F.col("level2").alias("ilevel"), F.col("id2").alias("iid"), F.col("level1").alias("level"), F.col("id1").alias("id")
    )


def select_edges(
    edges: DataFrame, closure: DataFrame, selected: DataFrame, primary_level: str, secondary_level: str,
    attrs: DataFrame | None = None, edge_conditions: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Edges with an endpoint in the selection, re-keyed per endpoint.

    An endpoint in the selection (``select_nodes`` output) becomes its primary-level
    entity, class 1; the other one its secondary-level entity, class 2. Edge
    conditions hold on the edge's own attributes, else on both endpoints.
    """
    pairs = edges.select("level1", "id1", "level2", "id2").distinct()
    if edge_conditions:
        conds = [(k, f"^(?:{rx})$") for k, rx in edge_conditions]
        own = by_attr(edges, conds, keys=("level1", "id1", "level2", "id2"))
        ok = by_attr(attrs, conds)
        ends = pairs.join(ok.withColumnsRenamed({"level": "level1", "id": "id1"}), ["level1", "id1"], "left_semi")
        ends = ends.join(ok.withColumnsRenamed({"level": "level2", "id": "id2"}), ["level2", "id2"], "left_semi")
        pairs = own.unionByName(ends).distinct()
    keyed = rekey(closure, selected, primary_level, secondary_level)
    out = pairs
    for i in "12":
        out = out.join(keyed.withColumnsRenamed({c: f"{c}{i}" for c in keyed.columns}), [f"level{i}", f"id{i}"])
    return out.where("iclass1 = 1 or iclass2 = 1")


def rekey(closure: DataFrame, selected: DataFrame, primary_level: str, secondary_level: str) -> DataFrame:
    """What every asset is shown as: (level, id, ilevel, iid, iclass).

    Its primary-level entities that are selected, as class 1; if there are none,
    its secondary-level entities as class 2. ``closure`` includes the identity. The
    table grows with the inventory, not with the events it is joined to.
    """
    up = closure.select(F.col("level1").alias("level"), F.col("id1").alias("id"), "level2", F.col("id2").alias("iid"))
    chosen = selected.where(F.col("ilevel") == primary_level).select("iid").distinct()
    first = up.where(F.col("level2") == primary_level).join(chosen, "iid", "left_semi")
    rest = up.where(F.col("level2") == secondary_level).join(first.select("level", "id").hint("merge"), ["level", "id"], "left_anti")
    first, rest = first.withColumn("iclass", F.lit(1)), rest.withColumn("iclass", F.lit(2))
    both = first.unionByName(rest).withColumnRenamed("level2", "ilevel")
    return both.select("level", "id", "ilevel", "iid", "iclass")


def propagate_filter(
    df: DataFrame, closure: DataFrame, conditions: Sequence[NodeCondition], level: str = "level1", id_: str = "id1"
) -> DataFrame:
    """Keep rows whose asset's ancestors match all scope patterns; ``closure`` with identity."""
    met = closure.withColumn("__name", F.lit(None).cast("string")).groupBy("level1", "id1").agg(*met_words(_tests(conditions)))
    ok = met.where(holds_all(range(len(conditions)))).select(F.col("level1").alias("__l"), F.col("id1").alias("__i"))
    return df.join(ok, (df[level] == F.col("__l")) & (df[id_] == F.col("__i")), "left_semi")


# --- service impact ----------------------------------------------------------------------

# Remaining percentage up to which a severity applies.
IMPACT_LEVELS = ((0.0, 1), (25.0, 2), (50.0, 3), (100.0, 4))


def parse_impact(spec: str, severities: dict[str, int]) -> tuple[tuple[float, int], ...]:
    """``0:critical:25:major:..`` to (percentage, severity) pairs."""
    parts = spec.split(":")
    return tuple(sorted((float(p), severities[s]) for p, s in zip(parts[::2], parts[1::2])))


def service_roles(attrs: DataFrame) -> DataFrame:
    """``gce_service<n>`` attributes (``prod:name`` / ``cons:name``) to (level, id, service, role)."""
    kind = F.substring_index("val", ":", 1)
    return (
        attrs.where(F.col("key").rlike(f"^{SERVICE_ATTR}[0-9]+$") & kind.isin("prod", "cons"))
        .select("level", "id", F.expr("substring(val, 6)").alias("service"), kind.alias("role"))
        .distinct()
    )


@dataclass(frozen=True)
class ImpactGraph:
    """The inventory in numbers, so that an evaluation moves no names: ``nodes`` (level, id, n, root), ``links`` (u, v, root), ``parts`` (n, service, role, root)."""

    nodes: DataFrame
    links: DataFrame
    parts: DataFrame

    def within(self, touched: DataFrame) -> ImpactGraph:
        """The components whose ``root`` is in a table."""
        return ImpactGraph(self.nodes, self.links.join(touched, "root", "left_semi"), self.parts.join(touched, "root", "left_semi"))


def impact_graph(edges: DataFrame, roles: DataFrame, members: DataFrame, keep: bool = False) -> ImpactGraph:
    """Number the nodes of all components once; ``members`` is ``connected_components(edges)``."""
    place = members.select(F.col("ndlevel").alias("level"), F.col("ndid").alias("id"), "cclevel", "ccid")
    nodes = number_rows(place, ["level", "id"], "n")
    roots = nodes.where("level = cclevel and id = ccid").select("cclevel", "ccid", F.col("n").alias("root"))
    nodes = stored(nodes.join(roots, ["cclevel", "ccid"]).select("level", "id", "n", "root"), "impact-nodes", keep)
    one = nodes.select(F.col("level").alias("level1"), F.col("id").alias("id1"), F.col("n").alias("u"), "root")
    two = nodes.select(F.col("level").alias("level2"), F.col("id").alias("id2"), F.col("n").alias("v"))
    links = edges.where("level1 <> level2 or id1 <> id2").select("level1", "id1", "level2", "id2").join(one, ["level1", "id1"]).join(two, ["level2", "id2"])
    links = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "root").distinct(), "impact-links", keep)
    parts = stored(roles.join(nodes, ["level", "id"]).select("n", "service", "role", "root"), "impact-parts", keep)
    return ImpactGraph(nodes, links, parts)


def service_impact(
    edges: DataFrame, roles: DataFrame, events: DataFrame, levels: Sequence[tuple[float, int]] = IMPACT_LEVELS,
    members: DataFrame | None = None,
) -> DataFrame:
    """Per component and service: producers that lost all or some paths to consumers.

    A node with an open event is down. A producer keeps a path to every consumer
    in its component once down nodes are taken out; so the two labelings, with
    and without down nodes, replace any path search. ``remaining`` is the
    percentage of producers that still reach a consumer; the severity is that of
    the first level it does not exceed. Only impaired services are listed.
    ``members`` is ``connected_components(edges)`` if it is already known.
    """
    graph = impact_graph(edges, roles, members if members is not None else connected_components(edges))
    return graph_impacts(graph, [events], levels).drop("state")


def graph_impacts(graph: ImpactGraph, states: Sequence[DataFrame], levels: Sequence[tuple[float, int]] = IMPACT_LEVELS) -> DataFrame:
    """``service_impact`` for several tables of open events at once, told apart by ``state``: their place in the list."""
    k = len(states)
    open_ = states[0].select("level", "id", F.lit(0).alias("state"))
    for i in range(1, k):
        open_ = open_.unionByName(states[i].select("level", "id", F.lit(i).alias("state")))
    # a node in a state is a number of its own, in the order of the nodes
    number = lambda n, state: F.col(n) * k + F.col(state)
    down = stored(open_.distinct().join(graph.nodes.select("level", "id", "n"), ["level", "id"]).select(number("n", "state").alias("x")), "impact-down")
    every = F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("state")
    links = graph.links.select("u", "v", every).select(number("u", "state").alias("u"), number("v", "state").alias("v"))
    for end in ("u", "v"):
        links = links.join(down.withColumnRenamed("x", end), end, "left_anti")
    live = number_components(links).select(F.col("node").alias("x"), F.col("root").alias("part"))
    # a node that is up but lost all its edges is a part of its own; a down one is in none
    placed = graph.parts.select("*", every).withColumn("x", number("n", "state")).join(live, "x", "left")
    placed = placed.join(down.withColumn("__down", F.lit(True)), "x", "left").withColumn("part", F.when(F.col("__down").isNull(), F.coalesce("part", "x")))
    svc = ["root", "service", "state"]
    is_cons, is_prod = F.col("role") == "cons", F.col("role") == "prod"
    # of each part of a service: who is in it; a part without a number holds those that are down
    per = placed.groupBy(*svc, "part").agg(F.count_if(is_cons).alias("cons"), F.count_if(is_prod).alias("prod"))
    per = per.withColumn("reached", F.when(F.col("part").isNull(), F.lit(0)).otherwise(F.col("cons")))
    total = per.groupBy(*svc).agg(F.sum("cons").alias("consumers"))
    out = per.where("prod > 0").join(total.where("consumers > 0"), svc).groupBy(*svc).agg(
        F.sum("prod").alias("producers"),
        F.sum(F.when(F.col("reached") == 0, F.col("prod")).otherwise(0)).alias("lost_all"),
        F.sum(F.when((F.col("reached") > 0) & (F.col("reached") < F.col("consumers")), F.col("prod")).otherwise(0)).alias("lost_some"),
    )
    left = 100.0 * (F.col("producers") - F.col("lost_all")) / F.col("producers")
    sev = F.lit(None).cast("int")
    for pct, s in reversed(sorted(levels)):
        sev = F.when(F.col("remaining") <= pct, F.lit(s)).otherwise(sev)
    named = graph.nodes.where("n = root").select(F.col("level").alias("cclevel"), F.col("id").alias("ccid"), "root")
    out = out.where("lost_all > 0 or lost_some > 0").withColumn("remaining", left).withColumn("severity", sev).join(named, "root")
    return out.select("cclevel", "ccid", "service", "producers", "lost_all", "lost_some", "remaining", "severity", "state")


def impact_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Services whose severity changed between two evaluations (0 = unimpaired)."""
    svc = ["cclevel", "ccid", "service"]
    a = before.select(*svc, F.col("severity").alias("old"))
    b = after.select(*svc, F.col("severity").alias("new"))
    j = a.join(b, svc, "full")
    zero = F.lit(0)
    return j.select(*svc, F.coalesce("old", zero).alias("old"), F.coalesce("new", zero).alias("new")).where("old <> new")
