"""Address sets as inclusive ranges (lo, hi), and prefix tables.

Ranges are IPv4 ``bigint`` or IPv6 16-byte ``binary``. Set operations are one
sorted sweep over range ends, cut into chunks (see ``ordered``): no operation
compares ranges pairwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.net import (
    V4_BITS, V4_MAX, V6_BITS, V6_MAX, V6_MIN, broadcast_address, broadcast_address6, ip6_next, ip6_prev, network, network6,
    range_cidrs, range_cidrs6,
)
from ..session import stored
from .ordered import in_order


@dataclass(frozen=True)
class Space:
    """What the operators need to know about an address family."""

    first: int | bytes
    last: int | bytes
    dtype: str
    bits: int
    next: Callable[[Column], Column]
    prev: Callable[[Column], Column]
    network: Callable[[Column, Column], Column]
    broadcast: Callable[[Column, Column], Column]
    cidrs: Callable[[Column, Column], Column]

    def lit(self, v: int | bytes) -> Column:
        return F.lit(bytearray(v) if isinstance(v, bytes) else v).cast(self.dtype)


V4 = Space(0, V4_MAX, "bigint", V4_BITS, lambda c: c + 1, lambda c: c - 1, network, broadcast_address, range_cidrs)
V6 = Space(V6_MIN, V6_MAX, "binary", V6_BITS, ip6_next, ip6_prev, network6, broadcast_address6, range_cidrs6)


def to_ranges(prefixes: DataFrame, addr: str = "addr", length: str = "len", space: Space = V4) -> DataFrame:
    """Prefixes to ranges."""
    a, n = F.col(addr), F.col(length)
    return prefixes.select(space.network(a, n).alias("lo"), space.broadcast(a, n).alias("hi"))


def _edges(sets: list[DataFrame], space: Space) -> DataFrame:
    """+1 at the start of a range, -1 after its end, summed per address and set."""
    out = None
    for i, s in enumerate(sets):
        up = s.select(F.col("lo").alias("at"), F.lit(i).alias("set"), F.lit(1).alias("d"))
        down = s.select(space.next(F.col("hi")).alias("at"), F.lit(i).alias("set"), F.lit(-1).alias("d"))
        part = up.unionByName(down)
        out = part if out is None else out.unionByName(part)
    deltas = [F.sum(F.when(F.col("set") == i, F.col("d")).otherwise(0)).alias(f"d{i}") for i in range(len(sets))]
    # equal ends are added up before the sort, so no address repeats
    return out.groupBy("at").agg(*deltas)


def sweep(sets: list[DataFrame], inside: Callable[..., Column], space: Space = V4) -> DataFrame:
    """Maximal ranges where ``inside(depth of set 0, depth of set 1, ..)`` holds."""
    n = len(sets)
    o = in_order(_edges(sets, space), ["at"])
    o = o.scans({f"c{i}": (F.col(f"d{i}").cast("long"), "sum") for i in range(n)})
    o = o.with_columns({"__in": inside(*[F.col(f"c{i}") for i in range(n)])}).lag("__was", F.col("__in"))
    # only addresses at which membership flips are left: start, end, start, ..
    flips = o.where(F.col("__in") != F.coalesce("__was", F.lit(False))).lag("lo", F.col("at"))
    ends = flips.rows().where(~F.col("__in"))
    return ends.select("lo", space.prev(F.col("at")).alias("hi"))


def union(sets: list[DataFrame], space: Space = V4) -> DataFrame:
    """All addresses of all sets, coalesced."""
    whole = sets[0].select("lo", "hi")
    for s in sets[1:]:
        whole = whole.unionByName(s.select("lo", "hi"))
    return sweep([whole], lambda c: c > 0, space)


def intersect(a: DataFrame, b: DataFrame, space: Space = V4) -> DataFrame:
    return sweep([a, b], lambda x, y: (x > 0) & (y > 0), space)


def difference(a: DataFrame, b: DataFrame, space: Space = V4) -> DataFrame:
    return sweep([a, b], lambda x, y: (x > 0) & (y <= 0), space)


def invert(a: DataFrame, space: Space = V4) -> DataFrame:
    """The complement within the address space."""
    spark = a.sparkSession
    whole = spark.range(1).select(space.lit(space.first).alias("lo"), space.lit(space.last).alias("hi"))
    return difference(whole, a, space)


def cover(a: DataFrame, b: DataFrame, space: Space = V4) -> DataFrame:
    """Ranges of A (coalesced) that share an address with B.

    B's overlap is counted on a sorted sweep: a range of A meets B if B is inside
    at its start or begins within it.
    """
    ua = union([a], space)
    marks = (
        ua.select(F.col("lo").alias("at"), F.lit(1).alias("k"), F.col("hi"))
        .unionByName(intersect(ua, b, space).select(F.col("lo").alias("at"), F.lit(2).alias("k"), F.lit(None).alias("hi")))
    )
    # every piece of the intersection lies in the last range of A that began before it
    o = in_order(marks, ["at", "k"]).scan(
        "__r", F.when(F.col("k") == 1, F.struct(F.col("at").alias("lo"), F.col("hi").alias("hi"))), "last"
    )
    return o.rows().where("k = 2").select("__r.lo", "__r.hi").distinct()


def rebit(a: DataFrame, bits: int, space: Space = V4) -> DataFrame:
    """Widen prefixes longer than ``bits``, then coalesce.

    Every range becomes its prefixes first, so a short prefix keeps its extent.
    """
    p = cidrs(union([a], space), space)
    return union([to_ranges(p.select("addr", F.least("len", F.lit(bits)).alias("len")), space=space)], space)


def cidrs(a: DataFrame, space: Space = V4) -> DataFrame:
    """Ranges to their fewest prefixes (at most 62 per IPv4 range, 254 per IPv6 range)."""
    return a.select(F.explode(space.cidrs(F.col("lo"), F.col("hi"))).alias("p")).select("p.addr", "p.len")


def size6(a: DataFrame) -> DataFrame:
    """Fewest prefixes and ranges of an IPv6 set, and its addresses in two exact parts: whole /64 networks, and the rest."""
    u = union([a], V6)
    n = u.agg(F.count(F.lit(1))).scalar()
    power = F.array(*[F.lit(str(1 << k)).cast("decimal(20,0)") for k in range(65)])
    long = F.when(F.col("len") > 64, F.get(power, 128 - F.col("len"))).cast("decimal(28,0)")
    short = F.when(F.col("len") <= 64, F.get(power, 64 - F.col("len"))).cast("decimal(28,0)")
    p = cidrs(u, V6).agg(F.count(F.lit(1)).alias("prefixes"), F.sum(short).alias("s"), F.sum(long).alias("l"))
    zero, unit = F.lit(0).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    rest = F.coalesce(F.col("l"), zero)
    nets = F.coalesce(F.col("s"), zero) + F.floor(rest / unit)
    return p.select(
        "prefixes", nets.cast("string").alias("networks64"), (rest % unit).cast("decimal(20,0)").cast("string").alias("addresses"), n.alias("ranges")
    )


def subset(a: DataFrame, b: DataFrame, space: Space = V4) -> DataFrame:
    """Is A within B?"""
    return difference(a, b, space).agg((F.count(F.lit(1)) == 0).alias("subset"))


def equal(a: DataFrame, b: DataFrame, space: Space = V4) -> DataFrame:
    return sweep([a, b], lambda x, y: (x > 0) != (y > 0), space).agg((F.count(F.lit(1)) == 0).alias("equal"))


def size(a: DataFrame) -> DataFrame:
    """Fewest prefixes, addresses and ranges of a set."""
    u = union([a])
    return u.agg(
        F.coalesce(F.sum(F.size(range_cidrs(F.col("lo"), F.col("hi")))), F.lit(0)).cast("long").alias("prefixes"),
        F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)).cast("long").alias("addresses"),
        F.count(F.lit(1)).alias("ranges"),
    )


def min_max(a: DataFrame) -> DataFrame:
    """Lowest and highest address."""
    return a.agg(F.min("lo").alias("min"), F.max("hi").alias("max"))


def table_stats(prefixes: DataFrame, space: Space = V4) -> DataFrame:
    """Prefixes and addresses per prefix length, with the total as length -1."""
    per = F.pow(F.lit(2.0), F.lit(space.bits) - F.col("len"))
    exact = per.cast("decimal(20,0)") if space is V4 else per
    return (
        prefixes.select("addr", "len").distinct()
        .rollup("len")
        .agg(F.count(F.lit(1)).alias("prefixes"), F.sum(exact).cast("double").alias("addresses"), F.grouping("len").alias("__g"))
        .withColumn("len", F.when(F.col("__g") == 1, F.lit(-1)).otherwise(F.col("len")))
        .drop("__g")
    )


# --- prefix tables ----------------------------------------------------------------------


def _candidates(df: DataFrame, addr: str, lengths: DataFrame, keep: list[str], space: Space) -> DataFrame:
    """Each address masked to every prefix length that occurs in ``lengths`` (len), at most 33 or 129."""
    present = lengths.agg(F.collect_set("len").alias("l")).scalar()
    each = df.withColumn("__all", present).select(*keep, F.col(addr).alias("__addr"), F.explode("__all").alias("__len"))
    return each.withColumn("__net", space.network(F.col("__addr"), F.col("__len"))).drop("__addr")


#: Bits of the filter of a prefix table, as powers of two: up to 16 MB.
FILTER_BITS = (16, 27)
#: Words of the filter that come to the driver in one row.
FILTER_WORDS = 1024

U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _halves(column: pa.Array, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that hold an address, and the high and low 64 bits of it."""
    if not wide:
        at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        low = column.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
        return at, np.zeros_like(low), low
    column = column.cast(pa.binary())
    whole = pc.fill_null(pc.equal(pc.binary_length(column), V6_BITS // 8), False)
    at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.zeros(0, U64), np.zeros(0, U64)
    kept = column.take(pa.array(at))
    begin = np.frombuffer(kept.buffers()[1], np.int32)[kept.offset]
    flat = np.frombuffer(kept.buffers()[2], np.uint8)[begin : begin + len(at) * V6_BITS // 8]
    high, low = flat.view(">u8").reshape(-1, 2).T.astype(U64)
    return at, high, low


def _masks(length: int, wide: bool) -> tuple[np.uint64, np.uint64]:
    """What ``network`` keeps of an address, as its high and low 64 bits."""
    if wide:
        kept = (1 << V6_BITS) - (1 << V6_BITS - min(max(length, 0), V6_BITS))
    else:
        kept = ((1 << V4_BITS) - (1 << (V4_BITS - length) % 64)) % (1 << 64)
    return U64(kept >> 64), U64(kept % (1 << 64))


def _slots(high: np.ndarray, low: np.ndarray, nth: np.ndarray | int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a network of the ``nth`` length."""
    with np.errstate(over="ignore"):
        h = _mixed(_mixed(high + np.asarray(nth).astype(U64) * U64(0x9E3779B97F4A7C15)) + low)
    return h >> U64(64 - bits), (h >> U64(64 - 2 * bits)) & U64((1 << bits) - 1)


def _filter(nets: DataFrame, wide: bool):
    """Two bits for every network of a stored table (__net, nth), and how many bits there are; broadcast to the tasks."""
    spark = nets.sparkSession
    bits = min(max(nets.count().bit_length() + 5, FILTER_BITS[0]), FILTER_BITS[1])
    words = 1 << bits - 6

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, high, low = _halves(batch.column("__net"), wide)
            slot = np.concatenate(_slots(high, low, batch.column("nth").to_numpy()[at], bits)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot // (64 * FILTER_WORDS)), pa.array(slot)], ["part", "slot"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, parts = np.zeros(words, U64), set()
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            np.bitwise_or.at(field, slot >> 6, U64(1) << (slot & 63).astype(U64))
            parts.update(np.unique(batch.column("part").to_numpy()).tolist())
        for part in parts:
            some = field[part * FILTER_WORDS : (part + 1) * FILTER_WORDS].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([some], pa.binary())], ["part", "some"])

    rows = nets.mapInArrow(slots, "part long, slot long").repartition("part").mapInArrow(gather, "part long, some binary")
    field = np.zeros(words, U64)
    for r in rows.collect():
        some = np.frombuffer(bytes(r.some), U64)
        field[r.part * FILTER_WORDS : r.part * FILTER_WORDS + len(some)] = some
    return spark.sparkContext.broadcast(field), bits


def _may_match(field, bits: int, lengths: list[int], wide: bool, rest: bool):
    """(__a, __x) to (__a, nth): the first of the lengths at which the address may have a prefix; with ``rest``, all after ``nth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, high, low = _halves(batch.column("__x"), wide)
            after = batch.column("nth").to_numpy()[at] if rest else np.full(len(at), -1)
            found, left = [], np.arange(len(at))
            for nth, length in enumerate(lengths):
                one, two = _masks(length, wide)
                some = left[after[left] < nth]
                hit = np.ones(len(some), bool)
                for slot in _slots(high[some] & one, low[some] & two, nth, bits):
                    hit &= (field.value[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1
                found.append((at[some[hit]], np.full(np.count_nonzero(hit), nth, np.int32)))
                if not rest:
                    left = some[~hit]
            rows, nths = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("__a").take(pa.array(rows)), pa.array(nths, pa.int32())], ["__a", "nth"])

    return run


def lpm_join(
    df: DataFrame, addr: str, prefixes: DataFrame, values: list[str], how: str = "left", space: Space = V4
) -> DataFrame:
    """Longest-prefix match of an address against a prefix table (addr, len, ..).

    Distinct addresses are masked to every prefix length that occurs, the longest first, and looked up in a filter
    of the table; only the first that may be there goes on, as one row, to the table itself. The few that are
    not there try their shorter ones. So no address is shuffled once per length. The
    answer per address is joined back, so an address that fills a third of the rows is matched once.
    """
    key, wide = ["__len", "__net"], space is V6
    table = prefixes.select(
        space.network(F.col("addr"), F.col("len")).alias("__net"), F.col("len").alias("__len"), *values
    )
    one = table.groupBy(*key).agg(F.first(F.struct(F.col("__len").alias("prefix_len"), *values)).alias("__m"))
    lengths = sorted((r[0] for r in prefixes.select("len").where("len is not null").distinct().collect()), reverse=True)
    kind = prefixes.schema["len"].dataType
    every = F.array(*[F.lit(n).cast(kind) for n in lengths]) if lengths else F.lit(None).cast(T.ArrayType(kind))
    nets = table.select("__net", (F.array_position(every, F.col("__len")) - 1).cast("int").alias("nth")).where("__net is not null and nth >= 0")
    field, bits = _filter(stored(nets.distinct(), "prefixes"), wide)

    distinct = df.select(F.col(addr).alias("__a")).where("__a is not null").distinct()
    schema = T.StructType([T.StructField("__a", df.schema[addr].dataType), T.StructField("nth", T.IntegerType())])
    number = F.col("__a").cast(space.dtype).alias("__x")

    def masked(found: DataFrame) -> DataFrame:
        """With the network at the length that was found."""
        long = found.withColumn("__len", F.get(every, F.col("nth")))
        return long.withColumn("__net", space.network(F.col("__a"), F.col("__len")))

    cut = [int(n) for n in lengths]
    first = masked(distinct.select("__a", number).mapInArrow(_may_match(field, bits, cut, wide, False), schema))
    first = stored(first.join(one.hint("merge"), key, "left").select("__a", "nth", "__m"), "longest")
    missed = first.where("__m is null").select("__a", number, "nth")
    again = masked(missed.mapInArrow(_may_match(field, bits, cut, wide, True), schema))
    # only lengths are compared, by a hash aggregate; a struct of values would be sorted
    nth = again.join(one.select(*key).hint("merge"), key).groupBy("__a").agg(F.min("nth").alias("nth"))
    hits = masked(nth).join(one.hint("merge"), key).select("__a", "__m").unionByName(first.where("__m is not null").select("__a", "__m"))
    out = df.join(hits.hint("merge"), df[addr] == F.col("__a"), how).drop("__a")
    return out.withColumns({c: F.col(f"__m.{c}") for c in ["prefix_len", *values]}).drop("__m")


def _contained(inner: DataFrame, outer: DataFrame, proper: bool, space: Space) -> DataFrame:
    """Pairs (inner prefix, containing prefix of outer), through masked ancestors."""
    own = inner.select("addr", "len").distinct()
    anc = _candidates(own, "addr", outer.select("len"), ["addr", "len"], space)
    anc = anc.where(F.col("__len") < F.col("len") if proper else F.col("__len") <= F.col("len"))
    table = outer.select(F.col("addr").alias("__net"), F.col("len").alias("__len")).distinct()
    return anc.join(table, ["__len", "__net"])


def supernets(prefixes: DataFrame, space: Space = V4) -> DataFrame:
    """Prefixes that no other prefix of the table contains."""
    p = prefixes.select("addr", "len").distinct()
    inside = _contained(p, p, True, space).select("addr", "len").distinct()
    return p.join(inside, ["addr", "len"], "left_anti")


def subnets(prefixes: DataFrame, space: Space = V4) -> DataFrame:
    """Prefixes contained in another one of the table."""
    p = prefixes.select("addr", "len").distinct()
    return p.join(_contained(p, p, True, space), ["addr", "len"], "left_semi")


def match_prefixes(a: DataFrame, b: DataFrame, which: str = "longest", space: Space = V4) -> DataFrame:
    """The longest or shortest prefix of A that contains each prefix of B."""
    pairs = _contained(b, a, False, space)
    pick = (F.max if which == "longest" else F.min)(F.struct(F.col("__len").alias("len"), F.col("__net").alias("net")))
    return pairs.groupBy("addr", "len").agg(pick.alias("__m")).select(
        "addr", "len", F.col("__m.net").alias("match_addr"), F.col("__m.len").alias("match_len")
    )
