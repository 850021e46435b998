"""Large rule tables: an inverted index from texts that a pattern needs to its rules.

Of every rule the rarest run of characters (among all rules) that each of its matches must contain is indexed. A subject is
looked up by its own runs of the lengths that occur, once for all rows that share it, and only the rules
it meets are verified. Rules without such a run are verified on every subject.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 6  # characters of an indexed run at most
EVERY = ".*"


def needed_runs(pattern: str) -> list[str]:
    """Runs of plain characters that every match of a pattern holds; none if unsure.

    The pattern is Java's. Syntax that Python reads otherwise, or not at all, makes it unsure.
    """
    if re.search(r"\(\?(?!:)|&&|\[\[|\[[^\]]*\[", pattern):
        return []
    try:
        tree = rp.parse(pattern)
    except (re.error, OverflowError):
        return []
    return [r for r in _runs(tree) if r]


def _runs(tree) -> list[str]:
    out, run = [], ""
    for op, arg in tree:
        if op is rc.LITERAL:
            run += chr(arg)
            continue
        out.append(run)
        run = ""
        if op is rc.SUBPATTERN:
            out += _runs(arg[-1])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
            out += _runs(arg[2])
    return [*out, run]


def keyed(patterns: Sequence[Mapping[str, str]]) -> list[tuple[str, str] | None]:
    """For every rule (column to pattern) the (column, run) it is indexed by, or None.

    The run that the fewest rules hold is taken, then the longest.
    """
    grams = []
    for one in patterns:
        mine = set()
        for c, p in one.items():
            for r in needed_runs(p):
                mine |= {(c, r[i : i + RUN]) for i in range(max(1, len(r) - RUN + 1))}
        grams.append(mine)
    seen = Counter(g for mine in grams for g in mine)
    return [min(mine, key=lambda g: (seen[g], -len(g[1]), g)) if mine else None for mine in grams]


def whole(c: Column, pattern: Column | str) -> Column:
    """Whether a pattern matches a whole value."""
    if isinstance(pattern, str):
        return c.rlike(f"^(?:{pattern})$")
    return F.regexp_like(c, F.concat(F.lit("^(?:"), pattern, F.lit(")$")))


def _runs_of(c: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a value; null if it is shorter."""
    at = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n)))))


def matching_rules(subjects: DataFrame, patterns: Sequence[Mapping[str, str]]) -> DataFrame:
    """The distinct subjects with ``__rules``, the ordinals of the rules that match, ascending; subjects that match none are left out.

    ``patterns``: per rule, column to pattern of the whole value; a column that is not named may be anything.
    Null values match nothing but a column that is not named.
    """
    spark = subjects.sparkSession
    columns = subjects.columns
    base = subjects.distinct()
    keys = keyed(patterns)
    rows = [(i, k[0], k[1], *(p.get(c) for c in columns)) for i, (k, p) in enumerate(zip(keys, patterns)) if k]
    plain = [i for i, k in enumerate(keys) if k is None]
    parts = []
    if rows:
        schema = "o int, c string, run string, " + ", ".join(f"__p{n} string" for n in range(len(columns)))
        index = spark.createDataFrame(rows, schema)  # configuration: it is in the plan already
        sizes = {c: sorted({len(r[2]) for r in rows if r[1] == c}) for c in columns}
        looked = []
        for c in columns:
            looked += [base.select(*columns, F.lit(c).alias("c"), F.explode(_runs_of(F.col(f"`{c}`"), n)).alias("run")) for n in sizes[c]]
        runs = looked[0]
        for other in looked[1:]:
            runs = runs.unionByName(other)
        met = runs.join(F.broadcast(index), ["c", "run"])
        for n, c in enumerate(columns):
            p = F.col(f"__p{n}")
            met = met.where(p.isNull() | F.coalesce(whole(F.col(f"`{c}`"), p), F.lit(False)))
        parts.append(met.select(*columns, "o"))
    if plain:
        tests = []
        for i in plain:
            fits = F.lit(True)
            for c, p in patterns[i].items():
                fits = fits & F.coalesce(whole(F.col(f"`{c}`"), p), F.lit(False))
            tests.append(F.when(fits, F.lit(i)))
        parts.append(base.select(*columns, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("o")))
    out = parts[0] if parts else base.select(*columns, F.lit(0).alias("o")).where("false")
    for other in parts[1:]:
        out = out.unionByName(other)
    return out.groupBy(*columns).agg(F.array_sort(F.collect_set("o")).alias("__rules"))
