"""Secret scan over a trigram inverted index, in DataFrame operations only."""

from __future__ import annotations

import itertools
import re
import re._constants as sc
import re._parser as sp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored
from .sizes import counted

LIMIT = 64  # spellings kept apart while a query is derived; beyond, a part is a gap


@dataclass(frozen=True)
class Rule:
    """A pattern (in the syntax that Java and Python share) and the least length of a group of it."""

    kind: str
    pattern: str
    group: int
    least: int


# The base kinds and their patterns.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + MORE
GAP = None  # anything may stand here


def _spellings(tree) -> list[tuple[str | None, ...]]:
    """What a parsed pattern can match, in lower case: sequences of texts and gaps."""
    out: list[tuple[str | None, ...]] = [()]
    for op, arg in tree:
        if op is sc.LITERAL:
            step = [(chr(arg).lower(),)]
        elif op is sc.IN:
            step = _class(arg)
        elif op is sc.SUBPATTERN:
            step = _spellings(arg[-1])
        elif op is sc.BRANCH:
            step = [s for branch in arg[1] for s in _spellings(branch)]
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            low, high, body = arg
            inner = _spellings(body)
            if (low, high) == (0, 1):
                step = [(), *inner]
            elif low == 0:
                step = [(GAP,)]
            else:
                step = _times(inner, low)
                if high != low:
                    step = [s + (GAP,) for s in step]
        else:
            step = [(GAP,)]
        step = list(dict.fromkeys(step))
        if len(out) * len(step) > LIMIT:
            step = [(GAP,)]
        out = list(dict.fromkeys(a + b for a, b in itertools.product(out, step)))
    return out


def _times(inner: list[tuple[str | None, ...]], n: int) -> list[tuple[str | None, ...]]:
    """All sequences of ``n`` spellings, each any of ``inner``; past LIMIT what follows is a gap, and so are repetitions past it of one spelling."""
    out: list[tuple[str | None, ...]] = [()]
    for k in range(n):
        if len(out) * len(inner) > LIMIT or k == LIMIT:
            return [s + (GAP,) for s in out]
        out = list(dict.fromkeys(a + b for a, b in itertools.product(out, inner)))
    return out


def _class(items) -> list[tuple[str | None, ...]]:
    chars = set()
    for op, arg in items:
        if op is not sc.LITERAL:
            return [(GAP,)]
        chars.add(chr(arg).lower())
    return [(c,) for c in sorted(chars)] if len(chars) <= 8 else [(GAP,)]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """A pattern as an OR of ANDs of lower-case trigrams; empty if some match needs none.

    Every match contains, for one of the sets at least, all of its trigrams.
    """
    found = []
    for spelling in _spellings(sp.parse(pattern)):
        grams = set()
        for is_gap, run in itertools.groupby(spelling, lambda x: x is GAP):
            text = "" if is_gap else "".join(run)
            grams |= {text[i : i + 3] for i in range(len(text) - 2)}
        if not grams:
            return []
        found.append(frozenset(grams))
    least = [a for a in set(found) if not any(b < a for b in found)]
    return sorted(least, key=sorted)


# Letters from the most to the least frequent in English text.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"
PER_AND = 3


def asked(grams: frozenset[str]) -> list[str]:
    """The ``PER_AND`` trigrams of a set that are likely the rarest; fewer postings, and still necessary."""
    rare = lambda g: sum(FREQUENT.find(c) if c in FREQUENT else len(FREQUENT) for c in g)
    return sorted(sorted(grams), key=rare, reverse=True)[:PER_AND]


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index, (gram, doc_id), for the trigrams that the queries name, from one pass over each text."""
    by_first = [f"{re.escape(c)}(?:{'|'.join(re.escape(g[1:]) for g in sorted(group))})" for c, group in itertools.groupby(sorted(grams), key=lambda g: g[0])]
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(f"(?=({'|'.join(by_first)}))"), F.lit(1)))
    return docs.select(F.explode(held).alias("gram"), "doc_id")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(doc_id, kinds): documents in all postings of some AND of a rule's query."""
    spark = docs.sparkSession
    queries = [(r.kind, i, asked(q)) for r in rules for i, q in enumerate(trigram_query(r.pattern))]
    if not queries:
        return None
    index = stored(postings(docs, sorted({g for _, _, q in queries for g in q})), "trigram-index")
    terms = [
        F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("term"), F.lit(g).alias("gram"), F.lit(len(q)).alias("needs"))
        for kind, i, q in queries
        for g in q
    ]
    wanted = spark.range(1).select(F.inline(F.array(*terms)))
    # a table of the rules' trigrams, a few dozen rows whatever the documents hold
    met = index.join(F.broadcast(wanted), "gram").groupBy("doc_id", "kind", "term", "needs")
    # repeated rows post a trigram again: distinct ones count
    hits = met.agg(F.size(F.collect_set("gram")).alias("has")).where("has = needs")
    return hits.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """(start, end, kind) of the matches whose group is long enough, in code points.

    The pieces between the matches and the matches themselves give the positions.
    """
    pattern = _long_enough(rule)
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    sized = F.arrays_zip(between.alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(part, F.length).alias("part"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("got"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        one = F.struct(begin.alias("start"), end.alias("end"))
        got = F.when(x["part"] >= rule.least, F.concat(acc["got"], F.array(one))).otherwise(acc["got"])
        return F.struct(F.coalesce(end, begin).alias("at"), got.alias("got"))

    return F.aggregate(sized, start, step)["got"]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with ``secrets``: array of (start, rank, kind, end), by start, then rule order.

    Per rule the matches are leftmost and do not overlap; positions are code
    points, the end is exclusive. Rules with mandatory trigrams look only at documents
    in the intersection of their postings; rules without scan every text. All rules
    run over a text in one pass, after one join with the candidates by doc_id.

    Null or empty texts have no secrets. Rows with the same doc_id share candidates, and
    each is verified. Rows without doc_id are verified for every rule. A column named
    ``secrets`` is replaced. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    with scratch(docs.sparkSession):
        known = candidates(docs.where("doc_id is not null"), rules)
        if known is not None:
            known = stored(known.withColumnRenamed("doc_id", "__i").withColumnRenamed("kinds", "__kinds"), "secret-candidates", keep=True)
    base = docs.drop("secrets")
    if known is None:
        base = base.withColumn("__kinds", F.lit(None).cast("array<string>")).withColumn("__i", F.lit(None))
    else:
        base = base.join(counted(known), F.col("doc_id") == F.col("__i"), "left")
    nothing = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    all_spans = []
    for rank, rule in enumerate(rules):
        got = F.transform(spans(text, rule), _named(rank, rule.kind))
        if trigram_query(rule.pattern):
            look = F.col("doc_id").isNull() | F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False))
        else:
            look = text.rlike(_long_enough(rule))
        all_spans.append(F.when(look, got).otherwise(nothing))
    return base.withColumn("secrets", F.array_sort(F.concat(*all_spans))).drop("__i", "__kinds")


def _named(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _long_enough(rule: Rule) -> str:
    """The pattern, for one class of characters without its matches that are too short: the others are the same."""
    one_class = rule.group == 0 and rule.pattern.startswith("[") and rule.pattern.index("]") == len(rule.pattern) - 2 and rule.pattern.endswith("+")
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if one_class else rule.pattern
