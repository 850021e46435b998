"""Queries for prefix tables, address sets and flow records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net
from ..operators import prefixes as P
from . import views as V
from .core import query


def _ab(spark, sf):
    return P.to_ranges(V.prefix_table(spark, sf)), P.to_ranges(V.prefix_table(spark, sf, "b"))


def _set(name: str, inside: str):
    return query(name, f"WITH {V.RANGES} {V.sweep_sql(inside)}")


@_set("pfx_union", "(ca > 0 OR cb > 0)")
def pfx_union(spark, sf):
    return P.union(list(_ab(spark, sf)))


@_set("pfx_intersect", "(ca > 0 AND cb > 0)")
def pfx_intersect(spark, sf):
    return P.intersect(*_ab(spark, sf))


@_set("pfx_difference", "(ca > 0 AND cb <= 0)")
def pfx_difference(spark, sf):
    return P.difference(*_ab(spark, sf))


@query("pfx_invert", f"""WITH {V.RANGES}, u AS ({V.sweep_sql('(ca > 0)')}), g AS (SELECT hi + 1 AS lo, lead(lo, 1, 4294967296) OVER (ORDER BY lo) - 1 AS hi FROM u
  UNION ALL SELECT 0, min(lo) - 1 FROM u) SELECT lo, hi FROM g WHERE lo <= hi""")  # fmt: skip
def pfx_invert(spark, sf):
    return P.invert(_ab(spark, sf)[0])


@query("pfx_cover", f"""WITH {V.RANGES}, u AS ({V.sweep_sql('(ca > 0)')}), i AS ({V.sweep_sql('(ca > 0 AND cb > 0)')})
  SELECT lo, hi FROM u WHERE EXISTS (SELECT 1 FROM i WHERE i.lo >= u.lo AND i.lo <= u.hi)""")  # fmt: skip
def pfx_cover(spark, sf):
    return P.cover(*_ab(spark, sf))


@query("pfx_rebit", f"""WITH {V.PFX_A}, pb AS (SELECT 0::BIGINT AS addr, 0 AS len WHERE false), ra AS (SELECT addr - addr % 65536 AS lo, addr - addr % 65536 + 65535 AS hi FROM pa WHERE len > 16
  UNION ALL SELECT addr, addr + (1::BIGINT << (32 - len)) - 1 FROM pa WHERE len <= 16), edges AS (SELECT lo AS pos, 1 AS da FROM ra UNION ALL SELECT hi + 1, -1 FROM ra),
  depth AS (SELECT pos, sum(sum(da)) OVER (ORDER BY pos) AS ca FROM edges GROUP BY pos) {V.sweep_sql('(ca > 0)')}""")  # fmt: skip
def pfx_rebit(spark, sf):
    return P.rebit(_ab(spark, sf)[0], 16)


@query("pfx_subset", f"""WITH {V.RANGES}, d AS ({V.sweep_sql('(ca > 0 AND cb <= 0)')}) SELECT 'a in b' AS test, (SELECT count(*) FROM d) = 0 AS subset UNION ALL SELECT 'a in a+b', true""")
def pfx_subset(spark, sf):
    a, b = _ab(spark, sf)
    return P.subset(a, b).withColumn("test", F.lit("a in b")).unionByName(P.subset(a, a.unionByName(b)).withColumn("test", F.lit("a in a+b")))


@query("pfx_equal", f"""WITH {V.RANGES}, d AS ({V.sweep_sql('((ca > 0) <> (cb > 0))')}) SELECT 'a is b' AS test, (SELECT count(*) FROM d) = 0 AS equal UNION ALL SELECT 'a is a+a', true""")
def pfx_equal(spark, sf):
    a, b = _ab(spark, sf)
    return P.equal(a, b).withColumn("test", F.lit("a is b")).unionByName(P.equal(a, a.unionByName(a)).withColumn("test", F.lit("a is a+a")))


# minimal blocks of a range: start by start, the largest aligned block that fits
_BLOCKS = """blk(lo, hi, addr, k) AS (SELECT lo, hi, lo, (SELECT max(k) FROM range(33) t(k) WHERE lo % (1::BIGINT << k) = 0 AND lo + (1::BIGINT << k) - 1 <= hi) FROM u
  UNION ALL SELECT lo, hi, n, (SELECT max(k) FROM range(33) t(k) WHERE n % (1::BIGINT << k) = 0 AND n + (1::BIGINT << k) - 1 <= hi)
  FROM (SELECT lo, hi, addr + (1::BIGINT << k) AS n FROM blk) WHERE n <= hi)"""


@query("pfx_size", f"WITH RECURSIVE {V.RANGES}, u AS ({V.sweep_sql('(ca > 0)')}), {_BLOCKS} SELECT (SELECT count(*) FROM blk) AS prefixes, sum(hi - lo + 1)::BIGINT AS addresses, count(*) AS ranges FROM u")
def pfx_size(spark, sf):
    return P.size(_ab(spark, sf)[0])


@query("pfx_cidrs", f"WITH RECURSIVE {V.RANGES}, u AS ({V.sweep_sql('(ca > 0 AND cb <= 0)')}), {_BLOCKS} SELECT addr, CAST(32 - k AS INTEGER) AS len FROM blk")
def pfx_cidrs(spark, sf):
    return P.cidrs(P.difference(*_ab(spark, sf)))


@query("pfx_min_max", f"WITH {V.RANGES} SELECT min(lo) AS min, max(hi) AS max FROM ra")
def pfx_min_max(spark, sf):
    return P.min_max(_ab(spark, sf)[0])


@query("prefix_table_stats", f"""WITH {V.PFX_A}, d AS (SELECT DISTINCT addr, len FROM pa) SELECT len, count(*) AS prefixes, sum(CAST(1::BIGINT << (32 - len) AS DOUBLE)) AS addresses FROM d GROUP BY len
  UNION ALL SELECT -1, count(*), sum(CAST(1::BIGINT << (32 - len) AS DOUBLE)) FROM d""")  # fmt: skip
def prefix_table_stats(spark, sf):
    return P.table_stats(V.prefix_table(spark, sf))


@query("pfx_union_v6", f"""WITH {V.RANGES} SELECT repeat('0', 20) || 'ffff' || printf('%08x', lo) AS lo, repeat('0', 20) || 'ffff' || printf('%08x', hi) AS hi FROM ({V.sweep_sql('(ca > 0 OR cb > 0)')})""")
def pfx_union_v6(spark, sf):
    out = P.union([_v6(r) for r in _ab(spark, sf)], P.V6)
    return out.select(F.lower(F.hex("lo")).alias("lo"), F.lower(F.hex("hi")).alias("hi"))


def _v6(ranges):
    """IPv4 ranges as mapped IPv6 ranges."""
    six = lambda c: F.unhex(F.concat(F.lit("0" * 20 + "FFFF"), F.lpad(F.hex(c), 8, "0")))
    return ranges.select(six(F.col("lo")).alias("lo"), six(F.col("hi")).alias("hi"))


@query("pfx_difference_v6", f"""WITH {V.RANGES} SELECT repeat('0', 20) || 'ffff' || printf('%08x', lo) AS lo, repeat('0', 20) || 'ffff' || printf('%08x', hi) AS hi FROM ({V.sweep_sql('(ca > 0 AND cb <= 0)')})""")
def pfx_difference_v6(spark, sf):
    a, b = (_v6(r) for r in _ab(spark, sf))
    return P.difference(a, b, P.V6).select(F.lower(F.hex("lo")).alias("lo"), F.lower(F.hex("hi")).alias("hi"))


# The prefixes a.b.c.d/n of the tables as 2001:db8:aabb:ccdd::/(32 + n).


def _wide_prefixes(spark, sf, which="a"):
    p = V.prefix_table(spark, sf, which)
    net_ = F.unhex(F.concat(F.lit("20010DB8"), F.lpad(F.hex("addr"), 8, "0"), F.lit("0" * 16)))
    return p.select(net_.alias("addr"), (F.col("len") + 32).alias("len"), "owner")


def _wide(spark, sf):
    return [P.to_ranges(_wide_prefixes(spark, sf, w), space=P.V6) for w in "ab"]


def _hexed(df, *cols):
    return df.select(*[F.lower(F.hex(c)).alias(c) if c in cols else c for c in df.columns])


def _wide_sql(ranges: str) -> str:
    lo, hi = ("'20010db8' || printf('%08x', {0}) || repeat('{1}', 16)".format(*x) for x in (("lo", "0"), ("hi", "f")))
    return f"SELECT {lo} AS lo, {hi} AS hi FROM ({ranges})"


@query("pfx_intersect_v6", f"WITH {V.RANGES} {_wide_sql(V.sweep_sql('(ca > 0 AND cb > 0)'))}")
def pfx_intersect_v6(spark, sf):
    return _hexed(P.intersect(*_wide(spark, sf), P.V6), "lo", "hi")


@query("pfx_invert_v6", f"""WITH {V.RANGES}, u AS ({V.sweep_sql('(ca > 0)')}), g AS (SELECT hi + 1 AS lo, lead(lo) OVER (ORDER BY lo) - 1 AS hi FROM u)
  SELECT CASE WHEN lo = 4294967296 THEN '20010db9' || repeat('0', 24) ELSE '20010db8' || printf('%08x', lo) || repeat('0', 16) END AS lo,
    CASE WHEN hi IS NULL THEN repeat('f', 32) ELSE '20010db8' || printf('%08x', hi) || repeat('f', 16) END AS hi FROM g WHERE hi IS NULL OR lo <= hi
  UNION ALL SELECT repeat('0', 32), CASE WHEN min(lo) = 0 THEN '20010db7' || repeat('f', 24) ELSE '20010db8' || printf('%08x', min(lo) - 1) || repeat('f', 16) END FROM u""")  # fmt: skip
def pfx_invert_v6(spark, sf):
    return _hexed(P.invert(_wide(spark, sf)[0], P.V6), "lo", "hi")


@query("pfx_cover_v6", f"""WITH {V.RANGES}, u AS ({V.sweep_sql('(ca > 0)')}), i AS ({V.sweep_sql('(ca > 0 AND cb > 0)')}),
  c AS (SELECT lo, hi FROM u WHERE EXISTS (SELECT 1 FROM i WHERE i.lo >= u.lo AND i.lo <= u.hi)) {_wide_sql('SELECT * FROM c')}""")  # fmt: skip
def pfx_cover_v6(spark, sf):
    return _hexed(P.cover(*_wide(spark, sf), P.V6), "lo", "hi")


@query("pfx_rebit_v6", f"""WITH {V.PFX_A}, ra AS (SELECT addr - addr % 65536 AS lo, addr - addr % 65536 + 65535 AS hi FROM pa WHERE len > 16
  UNION ALL SELECT addr, addr + (1::BIGINT << (32 - len)) - 1 FROM pa WHERE len <= 16), edges AS (SELECT lo AS pos, 1 AS da FROM ra UNION ALL SELECT hi + 1, -1 FROM ra),
  depth AS (SELECT pos, sum(sum(da)) OVER (ORDER BY pos) AS ca FROM edges GROUP BY pos) {_wide_sql(V.sweep_sql('(ca > 0)'))}""")  # fmt: skip
def pfx_rebit_v6(spark, sf):
    return _hexed(P.rebit(_wide(spark, sf)[0], 48, P.V6), "lo", "hi")


@query("pfx_subset_v6", f"""WITH {V.RANGES}, d AS ({V.sweep_sql('(ca > 0 AND cb <= 0)')}) SELECT 'a in b' AS test, (SELECT count(*) FROM d) = 0 AS subset UNION ALL SELECT 'a in a+b', true""")
def pfx_subset_v6(spark, sf):
    a, b = _wide(spark, sf)
    return P.subset(a, b, P.V6).withColumn("test", F.lit("a in b")).unionByName(P.subset(a, a.unionByName(b), P.V6).withColumn("test", F.lit("a in a+b")))


@query("pfx_equal_v6", f"""WITH {V.RANGES}, d AS ({V.sweep_sql('((ca > 0) <> (cb > 0))')}) SELECT 'a is b' AS test, (SELECT count(*) FROM d) = 0 AS equal UNION ALL SELECT 'a is a+a', true""")
def pfx_equal_v6(spark, sf):
    a, b = _wide(spark, sf)
    return P.equal(a, b, P.V6).withColumn("test", F.lit("a is b")).unionByName(P.equal(a, a.unionByName(a), P.V6).withColumn("test", F.lit("a is a+a")))


@query("pfx_cidrs_v6", f"WITH RECURSIVE {V.RANGES}, u AS ({V.sweep_sql('(ca > 0 AND cb <= 0)')}), {_BLOCKS} SELECT '20010db8' || printf('%08x', addr) || repeat('0', 16) AS addr, CAST(64 - k AS INTEGER) AS len FROM blk")
def pfx_cidrs_v6(spark, sf):
    return _hexed(P.cidrs(P.difference(*_wide(spark, sf), P.V6), P.V6), "addr")


@query("pfx_size_v6", f"WITH RECURSIVE {V.RANGES}, u AS ({V.sweep_sql('(ca > 0)')}), {_BLOCKS} SELECT (SELECT count(*) FROM blk) AS prefixes, CAST(sum(hi - lo + 1)::BIGINT AS VARCHAR) AS networks64, '0' AS addresses, count(*) AS ranges FROM u")
def pfx_size_v6(spark, sf):
    return P.size6(_wide(spark, sf)[0])


@query("pfx_min_max_v6", f"WITH {V.RANGES} SELECT '20010db8' || printf('%08x', min(lo)) || repeat('0', 16) AS min, '20010db8' || printf('%08x', max(hi)) || repeat('f', 16) AS max FROM ra")
def pfx_min_max_v6(spark, sf):
    return _hexed(P.min_max(_wide(spark, sf)[0]), "min", "max")


@query("prefix_table_stats_v6", f"""WITH {V.PFX_A}, d AS (SELECT DISTINCT addr, len FROM pa) SELECT len + 32 AS len, count(*) AS prefixes, sum(pow(2.0::DOUBLE, 96 - len)) AS addresses FROM d GROUP BY len
  UNION ALL SELECT -1, count(*), sum(pow(2.0::DOUBLE, 96 - len)) FROM d""")  # fmt: skip
def prefix_table_stats_v6(spark, sf):
    return P.table_stats(_wide_prefixes(spark, sf), P.V6)


LPM = f"""WITH {V.FLOW}, {V.PFX_A}, t AS (SELECT addr, len, min(owner) AS owner FROM pa GROUP BY ALL), d AS (SELECT DISTINCT src FROM flow), lens AS (SELECT DISTINCT len FROM t),
  m AS (SELECT d.src, arg_max(t.owner, t.len) AS owner, max(t.len) AS prefix_len FROM d CROSS JOIN lens JOIN t ON t.len = lens.len AND t.addr = d.src - d.src % (1::BIGINT << (32 - lens.len)) GROUP BY d.src)"""


@query("lpm_join", LPM + " SELECT orderkey, linenumber, f.src, prefix_len, owner FROM flow f LEFT JOIN m ON m.src = f.src")
def lpm_join(spark, sf):
    t = V.prefix_table(spark, sf).groupBy("addr", "len").agg(F.min("owner").alias("owner"))
    return P.lpm_join(V.flow(spark, sf), "src", t, ["owner"]).select("orderkey", "linenumber", "src", "prefix_len", "owner")


@query("lpm_join_v6", LPM + " SELECT orderkey, linenumber, f.src, prefix_len + 32 AS prefix_len, owner FROM flow f LEFT JOIN m ON m.src = f.src")
def lpm_join_v6(spark, sf):
    t = _wide_prefixes(spark, sf).groupBy("addr", "len").agg(F.min("owner").alias("owner"))
    host = F.unhex(F.concat(F.lit("20010DB8"), F.lpad(F.hex("src"), 8, "0"), F.lpad(F.hex("linenumber"), 16, "0")))
    f = V.flow(spark, sf).withColumn("src6", host)
    return P.lpm_join(f, "src6", t, ["owner"], space=P.V6).select("orderkey", "linenumber", "src", "prefix_len", "owner")


@query("select_prefix_v6", f"WITH {V.FLOW} SELECT orderkey, linenumber, src FROM flow WHERE src BETWEEN 1073741824 AND 1610612735")
def select_prefix_v6(spark, sf):
    """2001:db8:4000::/35 of the sources, written as text and read back."""
    text = F.concat_ws(":", F.lit("2001:db8"), F.hex(F.shiftright("src", 16)), F.hex(F.col("src").bitwiseAND(65535)), F.lit(":"), F.hex("linenumber"))
    f = V.flow(spark, sf).withColumn("src6", net.ip6_parse(F.replace(text, F.lit(":::"), F.lit("::"))))
    return f.where(net.in_prefix6(F.col("src6"), "2001:db8:4000::/35")).select("orderkey", "linenumber", "src")


@query("flow_scan", f"""WITH {V.FLOW} SELECT dst_port, protocol, count(*) AS flows, sum(packets)::BIGINT AS packets, sum(bytes)::BIGINT AS bytes FROM flow
  WHERE src BETWEEN 1073741824 AND 2147483647 AND bytes > 5000 GROUP BY ALL""")  # fmt: skip
def flow_scan(spark, sf):
    f = V.flow(spark, sf).where(F.col("src").between(1 << 30, (1 << 31) - 1) & (F.col("bytes") > 5000))
    return f.groupBy("dst_port", "protocol").agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


_IN = "(SELECT x.addr, x.len, y.addr AS oa, y.len AS ol FROM {x} x JOIN (SELECT DISTINCT len AS l FROM {y}) ls ON {cmp} JOIN {y} y ON y.len = ls.l AND y.addr = x.addr - x.addr % (1::BIGINT << (32 - ls.l)))"


@query("pfx_supernets", f"""WITH {V.PFX_A}, d AS (SELECT DISTINCT addr, len FROM pa) SELECT addr, len FROM d EXCEPT SELECT addr, len FROM {_IN.format(x='d', y='d', cmp='ls.l < x.len')}""")
def pfx_supernets(spark, sf):
    return P.supernets(V.prefix_table(spark, sf))


@query("pfx_subnets", f"WITH {V.PFX_A}, d AS (SELECT DISTINCT addr, len FROM pa) SELECT DISTINCT addr, len FROM {_IN.format(x='d', y='d', cmp='ls.l < x.len')}")
def pfx_subnets(spark, sf):
    return P.subnets(V.prefix_table(spark, sf))


for _which, _fn in (("longest", "max"), ("shortest", "min")):

    def _match(spark, sf, which=_which):
        return P.match_prefixes(V.prefix_table(spark, sf), V.prefix_table(spark, sf, "b"), which)

    query(
        f"pfx_{_which}",
        f"""WITH {V.PFX_A}, {V.PFX_B}, a AS (SELECT DISTINCT addr, len FROM pa), b AS (SELECT DISTINCT addr, len FROM pb)
  SELECT addr, len, arg_{_fn}(oa, ol) AS match_addr, {_fn}(ol) AS match_len FROM {_IN.format(x='b', y='a', cmp='ls.l <= x.len')} GROUP BY ALL""",
    )(_match)
