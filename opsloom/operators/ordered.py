"""Order-dependent work without a single-task window.

``F.row_number().over(Window.orderBy(..))`` moves every row to one task, and a
window over a hot series moves a third of the rows to one task. Here the rows
are sorted once by range partitioning; each range partition is a *chunk*.
Work inside a chunk is an ordinary window, and what a chunk needs to know about
the chunks before it (a sum, a maximum, the last row) is carried by a table
with at most one row per chunk.

Give an order that ends in a unique column, so that results do not depend on the
run. Ties are spread over chunks in any case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

CHUNK = "__chunk"
POS = "__pos"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Ordered:
    """Rows in one global order, cut into chunks; ``series`` restarts the scans."""

    df: DataFrame
    series: tuple[str, ...] = ()
    whole: bool = True  # no row was left out since the sort

    def _window(self):
        return Window.partitionBy(*self.series, CHUNK).orderBy(POS)

    def with_columns(self, cols: dict[str, Column]) -> Ordered:
        """Add row-wise columns (no effect on order)."""
        return replace(self, df=self.df.withColumns(cols))

    def where(self, cond: Column | str) -> Ordered:
        """Leave rows out; the order of the others stands."""
        return replace(self, df=self.df.where(cond), whole=False)

    def within(self, *series: str) -> Ordered:
        """Scan within finer series, if the present order keeps each together."""
        return replace(self, series=tuple(series))

    def scans(self, items: dict[str, tuple[Column, str] | tuple[Column, str, bool]]) -> Ordered:
        """Running ``sum``/``max``/``min``/``last`` values from the start of the series.

        ``items`` maps a name to (value, kind[, inclusive=True]); exclusive scans
        leave the current row out (NULL on the first row, 0 for sums) and ``last``
        skips NULL values. Scans of one call share a window and a carry table;
        a scan of a scan reads its input again for the carry, so keep chains short.
        """
        fns = {"sum": F.sum, "max": F.max, "min": F.min}
        w = self._window()
        spec = {n: (t[0], t[1], t[2] if len(t) > 2 else True) for n, t in items.items()}
        df = self.df.withColumns({f"__v_{n}": v for n, (v, _, _) in spec.items()})
        inner, totals, over = {}, {}, {}
        for n, (_, kind, inclusive) in spec.items():
            v, frame = F.col(f"__v_{n}"), w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            if kind == "last":
                inner[n] = F.last(v, ignorenulls=True).over(frame)
                totals[n] = F.max(F.when(v.isNotNull(), F.struct(F.col(POS), v.alias("v"))))["v"]
                over[n] = lambda x, win: F.last(x, ignorenulls=True).over(win)
            else:
                fn = fns[kind]
                inner[n] = fn(v).over(frame)
                totals[n] = fn(v)
                over[n] = lambda x, win, fn=fn: fn(x).over(win)
        # one row per (series, chunk), then the total of what lies before it
        per = df.groupBy(*self.series, CHUNK).agg(*[c.alias(f"__c_{n}") for n, c in totals.items()])
        before = Window.partitionBy(*self.series).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carry = per.select(
            F.col(CHUNK).alias("__c"),
            *[F.col(s).alias(f"__s{i}") for i, s in enumerate(self.series)],
            F.count(F.lit(1)).over(before).alias("__earlier"),
            *[over[n](F.col(f"__c_{n}"), before).alias(f"__c_{n}") for n in spec],
        ).where("__earlier > 0")
        out = df.withColumns(inner)
        cond = out[CHUNK] == F.col("__c")
        for i, s in enumerate(self.series):
            cond = cond & out[s].eqNullSafe(F.col(f"__s{i}"))
        # a chunk continues at most one series of the chunks before it, so the
        # carry has at most as many rows as there are sort partitions
        out = out.join(F.broadcast(carry), cond, "left")
        merged = {}
        for n, (_, kind, _) in spec.items():
            here, earlier = F.col(n), F.col(f"__c_{n}")
            if kind == "sum":
                merged[n] = F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
            elif kind == "last":
                merged[n] = F.coalesce(here, earlier)
            else:
                merged[n] = (F.greatest if kind == "max" else F.least)(here, earlier)
        helper = ["__c", "__earlier", *[f"__s{i}" for i in range(len(self.series))]]
        helper += [f"__{p}_{n}" for p in ("c", "v") for n in spec]
        return replace(self, df=out.withColumns(merged).drop(*helper))

    def scan(self, name: str, value: Column, kind: str, inclusive: bool = True) -> Ordered:
        return self.scans({name: (value, kind, inclusive)})

    def lag(self, name: str, value: Column) -> Ordered:
        """``value`` of the previous row of the series (NULL on the first)."""
        return self.scans({name: lag_of(value)}).with_columns({name: F.col(f"{name}.v")})

    def number(self, name: str) -> Ordered:
        """1-based row number within the series.

        Without series the position within the chunk is already known, so only the
        sizes of the chunks before are added: nothing is shuffled again.
        """
        if self.series or not self.whole:
            return self.scans({name: row_count()})
        sizes = self.df.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
        # one row per chunk, and as many chunks as sort partitions
        start = sizes.select(F.col(CHUNK).alias("__c"), "__n").select(
            "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
        )
        out = self.df.join(F.broadcast(start), self.df[CHUNK] == F.col("__c"))
        index = F.col(POS).bitwiseAND(F.lit((1 << 33) - 1))
        return replace(self, df=out.withColumn(name, F.col("__start") + index + 1).drop("__c", "__start"))

    def rows(self) -> DataFrame:
        """The rows without the bookkeeping columns."""
        return self.df.drop(CHUNK, POS)


def row_count() -> tuple[Column, str]:
    """The item of ``scans`` for a 1-based row number."""
    return F.lit(1).cast("long"), "sum"


def lag_of(value: Column) -> tuple[Column, str, bool]:
    """The item of ``scans`` for the previous row: a struct, so NULL values count."""
    return F.struct(value.alias("v")), "last", False


def spread_ties(df: DataFrame) -> list[Column]:
    """Last sort keys that tell equal rows apart: a row hash, then the input partition.

    A key value, or a group of copies, that fills a third of the rows would
    otherwise be one range and one task. Both are the same when a task is run again.
    """
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.spark_partition_id()]


def in_order(df: DataFrame, order: Sequence[str | Column], series: Sequence[str] = ()) -> Ordered:
    """Sort once and cut into chunks.

    The sorted rows are written with their chunk and position: these must be the
    same for everything that later reads them, also after an executor is lost.
    """
    keys = [F.col(s) for s in series] + [_col(o) for o in order] + spread_ties(df)
    mid = F.monotonically_increasing_id()
    sorted_rows = stored(df.sort(*keys).withColumn(POS, mid), "ordered")
    out = sorted_rows.withColumn(CHUNK, F.shiftright(F.col(POS), 33).cast("int"))
    return Ordered(out, tuple(series))


def number_rows(
    df: DataFrame, order: Sequence[str | Column], name: str = "rn", series: Sequence[str] = ()
) -> DataFrame:
    """Dense 1-based numbers in ``order`` (restarting per ``series``)."""
    return in_order(df, order, series).number(name).rows()
