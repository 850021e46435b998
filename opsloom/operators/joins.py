"""Joins, lookups and rule matching.

No broadcast is forced on data: Catalyst broadcasts a side when its measured
size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and
merges, with AQE splitting the partitions of hot keys. Rule tables are literal
configuration: small ones become CASE expressions, which need no join at all,
large ones a table that is broadcast (``rule_index``).
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import range_blocks
from .ordered import number_rows, spread_ties
from .rows import Expr, truth
from .rule_index import matching_rules


def join_tables(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
    fields: Sequence[str] | None = None, fill: object = None,
) -> DataFrame:
    """Equi join; ``fill`` replaces what an unmatched side leaves empty."""
    out = left.join(right, list(on), how)
    if fill is not None:
        out = out.na.fill(fill)
    return out.select(*fields) if fields else out


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Equi join for a left side with very hot keys.

    Left rows are spread over ``salts`` copies of the right rows; exact for inner,
    left, semi and anti joins. The salt comes from the row and its input partition,
    so that a task that is run again gives every row the same one. The copies go through
    the shuffle: their number is not in the size that the planner guesses, and a
    broadcast of all of them would fill the driver.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(*spread_ties(left)), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies.hint("merge"), [*on, "__salt"], how).drop("__salt")


def lookup_semi(df: DataFrame, field_name: str, values: DataFrame, reject: bool = False) -> DataFrame:
    """Rows whose value is (not) in a value list."""
    v = values.select(F.col(values.columns[0]).alias("__v")).distinct()
    return df.join(v, df[field_name] == F.col("__v"), "left_anti" if reject else "left_semi")


def lookup_dict(
    df: DataFrame, dictionary: DataFrame, keys: Sequence[Sequence[tuple[str, str]]], values: Sequence[str],
    *, first_by: Sequence[str] | None = None, how: str = "left",
) -> DataFrame:
    """Dictionary lookup by one or several alternative composite keys.

    ``keys`` lists alternatives, each a list of (row field, dictionary field). An
    alternative is only tried when no earlier one has an entry. With ``first_by``
    the dictionary keeps one record per key, the first in that order; without it
    all records are returned.
    """
    if first_by is None and len(keys) == 1:
        return _join_all(df, dictionary, keys[0], values, how)
    if first_by is None:
        raise ValueError("alternative keys need first_by: the key of the record that is used")
    out = df
    for i, key in enumerate(keys):
        cols = [F.col(d).alias(f"__d{i}_{j}") for j, (_, d) in enumerate(key)]
        ordered = F.struct(*first_by)
        rec = F.min_by(F.struct(*values), ordered).alias(f"__r{i}")
        # an aggregate, not a window: one record per key before anything is shuffled
        one = dictionary.groupBy(*cols).agg(rec)
        cond = F.lit(True)
        for j, (f, _) in enumerate(key):
            cond = cond & (out[f] == F.col(f"__d{i}_{j}"))
        out = out.join(one, cond, "left").drop(*[f"__d{i}_{j}" for j in range(len(key))])
    rec = F.coalesce(*[F.col(f"__r{i}") for i in range(len(keys))])
    if how == "inner":
        out = out.where(rec.isNotNull())
    return out.withColumns({v: rec[v] for v in values}).drop(*[f"__r{i}" for i in range(len(keys))])


def _join_all(
    df: DataFrame, dictionary: DataFrame, key: Sequence[tuple[str, str]], values: Sequence[str], how: str
) -> DataFrame:
    names = [f"__k{j}" for j in range(len(key))]
    right = dictionary.select(*[F.col(d).alias(n) for n, (_, d) in zip(names, key)], *values)
    cond = F.lit(True)
    for n, (f, _) in zip(names, key):
        cond = cond & (df[f] == F.col(n))
    return df.join(right, cond, how).drop(*names)


def choose_by_value_map(keys: DataFrame, pairs: DataFrame, key: str, forward: bool = True) -> DataFrame:
    """Look a value up in (a, b) pairs and give the other side."""
    src, dst = ("a", "b") if forward else ("b", "a")
    p = pairs.select(F.col(src).alias(key), F.col(dst).alias("mapped"))
    return keys.join(p, key)


def translate_id(df: DataFrame, ids: Sequence[str], trans: DataFrame) -> DataFrame:
    """Replace ids by their translation when there is one (``trans``: inid, outid)."""
    one = trans.groupBy("inid").agg(F.min("outid").alias("__out"))
    for c in ids:
        t = one.withColumnsRenamed({"inid": "__in", "__out": "__to"})
        df = df.join(t, df[c] == F.col("__in"), "left")
        df = df.withColumn(c, F.coalesce("__to", c)).drop("__in", "__to")
    return df


def paste(inputs: Sequence[DataFrame], orders: Sequence[Sequence[Expr]], columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """Put the n-th rows of all inputs side by side; a short input gives empty text."""
    joined = None
    for i, (df, order, c) in enumerate(zip(inputs, orders, columns)):
        one = number_rows(df, order, "rn").select("rn", F.col(c).cast("string").alias(f"__p{i}"))
        joined = one if joined is None else joined.join(one, "rn", "full")
    parts = [F.coalesce(F.col(f"__p{i}"), F.lit("")) for i in range(len(inputs))]
    return joined.select("rn", F.concat_ws(sep, *parts).alias("line"))


# --- interval join ----------------------------------------------------------------


def interval_join(
    points: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str, how: str = "inner"
) -> DataFrame:
    """Point in inclusive range, as an equi join.

    A range is cut into its aligned power-of-two blocks (at most two per bit, all
    of it covered exactly once). A point is in a block of size 2^k if the two agree
    above bit k, so it is looked up once per block size that occurs. Distinct point
    values are resolved first: a value that fills a third of the rows is looked
    up once.
    """
    rid = [c for c in ranges.columns]
    blocks = ranges.select(*rid, F.explode(range_blocks(F.col(lo), F.col(hi))).alias("__b")).select(
        *rid, F.col("__b.size_log2").alias("__k"), F.col("__b.start").alias("__s")
    )
    pts = points.select(F.col(point).cast("bigint").alias("__p")).distinct()
    # at most 63 sizes can occur
    sizes = blocks.agg(F.collect_set("__k").alias("k")).scalar()
    probe = pts.withColumn("__ks", sizes).select(
        "__p", F.explode("__ks").alias("__k")
    ).withColumn(
        "__s",
        F.col("__p") - F.col("__p").bitwiseAND(F.expr("shiftleft(bigint(1), __k) - 1")),
    )
    found = probe.join(blocks, ["__k", "__s"]).drop("__k", "__s")
    src = points.withColumn("__p", F.col(point).cast("bigint"))
    return src.join(found, "__p", how).drop("__p")


# --- rules ------------------------------------------------------------------------


@dataclass(frozen=True)
class AlarmRule:
    """One row of the alarm classification table."""

    id: str
    text: str = ".*"
    obj: str | None = None
    state: int = 0
    tmode: int = -1
    smode: int = -1
    severity: int = 0
    comment: str | None = None
    variables: str = ""
    names: Sequence[str] = field(default=())


# The fallback rule, the pattern that needs no ancestor, attribute keys.
ANY_RULE = "__ANY__"
EVERYTHING = "__ALL__"
NAME_ATTR = "name"
PRIVACY_ATTR = "custpriv"
SIZE_PREFIXES = ("si_sz_", "scopeinv_size_")

LADDER = 64  # rules that are one CASE; more are looked up in an index


def longest_literal(pattern: str) -> str:
    """The longest run of plain characters every match must contain ('' if unsure).

    Of escapes only that of a punctuation character stands for itself; any other
    (a code, a class, a quotation) makes the pattern unsure.
    """
    if re.search(r"\\(?:[A-Za-z0-9]|$)", pattern):
        return ""
    if re.search(r"[|?*{(\[]", pattern):
        simple = re.split(r"\.\*|\.\+", pattern)
        if any(re.search(r"[|?*+{}()\[\]^$.\\]", p) for p in simple):
            return ""
        return max(simple, key=len)
    runs = re.split(r"\\.|[.^$+]", pattern)
    # the character before a + may repeat, but it is there at least once
    return max(runs, key=len)


def _matches(c: Column, pattern: str) -> Column:
    lit = longest_literal(pattern)
    rx = c.rlike(f"^(?:{pattern})$")
    return (F.contains(c, F.lit(lit)) & rx) if lit else rx


def rule_match_first(
    df: DataFrame, rules: Sequence[AlarmRule], alarmid: str = "alarmid", text: str = "text", obj: str = "id1"
) -> DataFrame:
    """Ordinal of the first rule that fits (NULL if none), as ``rule``.

    A row with an id takes the first rule of that id, else the ``__ANY__`` rule; a
    row without one takes the first rule whose object and text patterns match the
    whole value. The table is configuration: up to ``LADDER`` rules are one CASE, no join, no shuffle, and
    a cheap ``contains`` ahead of every regular expression. Of more, a row looks at the rules that an index
    of the texts they need gives, once for all rows with the same object and text.
    """
    aid = F.coalesce(F.col(alarmid), F.lit(""))
    by_id: dict[str, int] = {}
    for i, r in enumerate(rules):
        by_id.setdefault(r.id, i)
    any_rule = by_id.get(ANY_RULE)
    if len(rules) > LADDER:
        return _indexed_match(df, rules, by_id, any_rule, aid, text, obj)
    ids = F.create_map(*[F.lit(x) for kv in by_id.items() for x in kv])
    known = F.coalesce(F.try_element_at(ids, aid), F.lit(any_rule).cast("int"))
    ladder = None
    for i, r in enumerate(rules):
        p = _matches(F.col(text), r.text)
        if r.obj is not None:
            p = p & _matches(F.col(obj), r.obj)
        ladder = F.when(truth(p), F.lit(i)) if ladder is None else ladder.when(truth(p), F.lit(i))
    return df.withColumn("rule", F.when(aid != "", known).otherwise(ladder))


def _indexed_match(df: DataFrame, rules: Sequence[AlarmRule], by_id: Mapping[str, int], any_rule: int | None, aid: Column, text: str, obj: str) -> DataFrame:
    subjects = df.where(aid == "").select(F.col(text).alias("__text"), F.col(obj).alias("__obj"))
    patterns = [{"__text": r.text} | ({} if r.obj is None else {"__obj": r.obj}) for r in rules]
    first = matching_rules(subjects, patterns).select(F.col("__text"), F.col("__obj"), F.col("__rules")[0].alias("__first"))
    ids = F.broadcast(df.sparkSession.createDataFrame(list(by_id.items()), "__id string, __known int"))
    out = df.withColumn("__aid", aid).join(ids, F.col("__aid") == F.col("__id"), "left")
    same = (F.col("__aid") == "") & F.col(text).eqNullSafe(F.col("__text")) & F.col(obj).eqNullSafe(F.col("__obj"))
    out = out.join(first, same, "left")
    known = F.coalesce(F.col("__known"), F.lit(any_rule).cast("int"))
    return out.withColumn("rule", F.when(F.col("__aid") != "", known).otherwise(F.col("__first"))).drop(
        "__aid", "__id", "__known", "__text", "__obj", "__first"
    )


def _pick(rules: Sequence, of: str, values: Sequence, dtype: str) -> Column:
    """A rule attribute by ordinal: NULL where the rule does not set it."""
    arr = F.array(*[F.lit(v).cast(dtype) for v in values])
    return F.get(arr, F.col(of))


def rule_captures(df: DataFrame, rules: Sequence[AlarmRule], text: str = "text") -> DataFrame:
    """``name=value`` variables from the capture groups of the matched rule."""
    if len(rules) > LADDER:
        values = {"names": ([list(r.names) for r in rules], "array<string>"), "pattern": ([f"^(?:{r.text})$" for r in rules], "string")}
        out, pick = _picked(df, "rule", values)
        got = F.transform(pick["names"], lambda n, i: F.concat(n, F.lit("="), F.call_function("regexp_extract", F.col(text), pick["pattern"], i + 1)))
        return out.withColumn("captured", F.coalesce(F.array_join(got, "\t\t"), F.lit(""))).drop(*_helpers(values))
    out = None
    for i, r in enumerate(rules):
        if not r.names:
            continue
        pairs = [
            F.concat(F.lit(f"{n}="), F.regexp_extract(F.col(text), f"^(?:{r.text})$", g + 1))
            for g, n in enumerate(r.names)
        ]
        hit = F.col("rule") == i
        v = F.concat_ws("\t\t", *pairs)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return df.withColumn("captured", F.coalesce(out, F.lit("")) if out is not None else F.lit(""))


def rule_apply_overrides(df: DataFrame, rules: Sequence[AlarmRule]) -> DataFrame:
    """What the matched rule overrides: state, modes, severity, comment, variables, id."""
    hit = F.col("rule").isNotNull()
    values = {
        "id": ([r.id for r in rules], "string"), "state": ([r.state for r in rules], "int"),
        "tmode": ([r.tmode if r.tmode != -1 else None for r in rules], "int"), "smode": ([r.smode if r.smode != -1 else None for r in rules], "int"),
        "severity": ([r.severity if r.severity > 0 else None for r in rules], "int"), "comment": ([r.comment for r in rules], "string"),
        "variables": ([r.variables or None for r in rules], "string"),
    }
    out, pick = _picked(df, "rule", values)
    extra = F.nullif(
        F.concat_ws("\t\t", pick["variables"], F.nullif(F.col("captured"), F.lit("")) if "captured" in df.columns else F.lit(None)),
        F.lit(""),
    )
    return out.withColumns(
        {
            "alarmid": F.when(hit & (F.coalesce("alarmid", F.lit("")) == ""), pick["id"]).otherwise(F.col("alarmid")),
            "state": F.when(hit, pick["state"]).otherwise(F.col("state")),
            "tmode": F.coalesce(pick["tmode"], "tmode"),
            "smode": F.coalesce(pick["smode"], "smode"),
            "severity": F.coalesce(pick["severity"], "severity"),
            "comment": F.coalesce(pick["comment"], "comment"),
            "variables": F.concat_ws("\t\t", F.nullif(F.col("variables"), F.lit("")), extra),
        }
    ).drop(*_helpers(values))


@dataclass(frozen=True)
class FilterRule:
    """Account filter: object and text patterns within a time window."""

    obj: str = ".*"
    text: str = ".*"
    alarmid: str = ".*"
    account: str = ""
    start: int = 0
    end: int = 1 << 40
    tmode: int = 0
    smode: int = 0
    severity: int = 0
    comment: str | None = None


def filter_rule_match(
    df: DataFrame, rules: Sequence[FilterRule], obj: str = "id1", text: str = "text",
    alarmid: str = "alarmid", time: str = "timeissued",
) -> DataFrame:
    """Overrides by the first filter that matches, after classification.

    Up to ``LADDER`` filters are one CASE; more are looked up as in ``rule_match_first``, and of those that a row
    meets the first one whose time window holds counts.
    """
    if len(rules) > LADDER:
        return _filtered(_indexed_filter(df, rules, {"__obj": obj, "__text": text, "__aid": alarmid}, time), rules)
    ladder = None
    for i, r in enumerate(rules):
        p = F.col(time).between(r.start, r.end)
        for c, rx in ((obj, r.obj), (text, r.text), (alarmid, r.alarmid)):
            if rx != ".*":
                p = p & _matches(F.col(c), rx)
        ladder = F.when(truth(p), F.lit(i)) if ladder is None else ladder.when(truth(p), F.lit(i))
    return _filtered(df.withColumn("filter", ladder), rules)


def _indexed_filter(df: DataFrame, rules: Sequence[FilterRule], columns: Mapping[str, str], time: str) -> DataFrame:
    given = [{"__obj": r.obj, "__text": r.text, "__aid": r.alarmid} for r in rules]
    patterns = [{c: p for c, p in one.items() if p != ".*"} for one in given]
    subjects = df.select(*[F.col(c).alias(n) for n, c in columns.items()])
    windows = F.broadcast(df.sparkSession.createDataFrame([(i, r.start, r.end) for i, r in enumerate(rules)], "o int, start bigint, end bigint"))
    met = matching_rules(subjects, patterns).select(*columns, F.explode("__rules").alias("o")).join(windows, "o")
    met = met.groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("o", "start", "end"))).alias("__met"))
    same = F.lit(True)
    for n, c in columns.items():
        same = same & df[c].eqNullSafe(met[n])
    open_ = F.filter("__met", lambda m: F.col(time).between(m["start"], m["end"]))
    return df.join(met, same, "left").withColumn("filter", F.get(open_, F.lit(0))["o"]).drop("__met", *columns)


def _filtered(out: DataFrame, rules: Sequence[FilterRule]) -> DataFrame:
    """What the filter of each row overrides."""

    values = {
        "tmode": ([r.tmode or None for r in rules], "int"), "smode": ([r.smode or None for r in rules], "int"),
        "severity": ([r.severity or None for r in rules], "int"), "comment": ([r.comment for r in rules], "string"),
        "account": ([r.account for r in rules], "string"),
    }
    out, pick = _picked(out, "filter", values)
    changed = {c: F.coalesce(pick[c], c) for c in ("tmode", "smode", "severity", "comment")}
    return out.withColumns({**changed, "account": pick["account"]}).drop(*_helpers(values))


def _picked(df: DataFrame, of: str, values: Mapping[str, tuple[Sequence, str]]) -> tuple[DataFrame, dict[str, Column]]:
    """Attributes of the rule with ordinal ``of``: out of constants for a few rules, else by a join with the rule table."""
    n = max(len(v) for v, _ in values.values())
    if n <= LADDER:
        return df, {c: _pick(v, of, v, t) for c, (v, t) in values.items()}
    names = _helpers(values)
    schema = "__o int, " + ", ".join(f"{h} {t}" for h, (_, t) in zip(names, values.values()))
    rows = list(zip(range(n), *(v for v, _ in values.values())))
    rule_table = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # configuration: as large as the plan's rules
    return df.join(rule_table, F.col(of) == F.col("__o"), "left").drop("__o"), {c: F.col(h) for c, h in zip(values, names)}


def _helpers(values: Mapping[str, object]) -> list[str]:
    return [f"__of_{c}" for c in values]


# --- attribute conditions ----------------------------------------------------------


def attr_conditions(
    attrs: DataFrame, conditions: Sequence[tuple[str, str]], keys: Sequence[str] = ("level", "id")
) -> DataFrame:
    """Assets for which every (attribute, value pattern) holds.

    An attribute that is absent fails its condition. Each attribute row sets the
    bits of the conditions it meets, in as many words as there are; the bits are
    OR-ed before the shuffle.
    """
    tests = [(F.col("key") == k) & F.col("val").rlike(rx) for k, rx in conditions]
    rel = attrs.where(F.col("key").isin([k for k, _ in conditions]))
    met = rel.groupBy(*keys).agg(*met_words(tests))
    return met.where(holds_all(range(len(tests)))).select(*keys)


# Conditions per word: bits of a non-negative long.
WORD = 62


def met_words(tests: Sequence[Column], prefix: str = "__met") -> list[Column]:
    """Aggregates that OR the bits of all tests, ``WORD`` tests to a column; one column at least."""
    zero = F.lit(0).cast("long")
    words = []
    for at in range(0, max(1, len(tests)), WORD):
        bits = zero
        for i, t in enumerate(tests[at : at + WORD]):
            bits = bits.bitwiseOR(F.when(t, F.lit(1 << i).cast("long")).otherwise(zero))
        words.append(F.bit_or(bits).alias(f"{prefix}{at // WORD}"))
    return words


def holds_all(chosen: Iterable[int], prefix: str = "__met") -> Column:
    """Whether the tests of these numbers were all met."""
    masks: dict[int, int] = {}
    for i in chosen:
        masks[i // WORD] = masks.get(i // WORD, 0) | 1 << i % WORD
    out = F.lit(True)
    for word, mask in sorted(masks.items()):
        out = out & (F.col(f"{prefix}{word}").bitwiseAND(F.lit(mask).cast("long")) == mask)
    return out


@dataclass(frozen=True)
class ThresholdRule:
    """Threshold of an account for assets by id (or name) pattern."""

    stat: str
    spec: str
    pattern: str
    by_name: bool = False
    regex: bool = True
    account: str = ""


def threshold_match(
    assets: DataFrame, closure: DataFrame, attrs: DataFrame, rules: Sequence[ThresholdRule],
    account_conditions: Mapping[str, Sequence[tuple[str, str]]], customer_level: str = "c",
    restricted: Collection[str] = (),
) -> DataFrame:
    """One threshold row per asset and stat name, the first rule that holds.

    A rule holds if its pattern matches the asset's id (or name), ignoring case,
    and, for every (level, pattern) of its account, some ancestor at that level
    matches; the asset must also have a customer. For ``restricted`` accounts an
    asset that has a privacy attribute must carry a T in it.
    """
    own = F.when(F.col("key") == NAME_ATTR, F.col("val"))
    priv = F.when(F.col("key") == PRIVACY_ATTR, F.col("val"))
    names = (
        attrs.where(F.col("key").isin(NAME_ATTR, PRIVACY_ATTR))
        .groupBy("level", "id")
        .agg(F.min(own).alias("name"), F.min(priv).alias("__priv"))
    )
    conds = sorted({c for cs in account_conditions.values() for c in cs if c[1] != EVERYTHING})
    number = {c: i for i, c in enumerate(conds)}
    tests = [(F.col("level2") == lv) & F.col("id2").rlike(f"^(?:{rx})$") for lv, rx in conds]
    cust = F.min(F.when(F.col("level2") == customer_level, F.col("id2")))
    anc = closure.groupBy(F.col("level1").alias("level"), F.col("id1").alias("id")).agg(*met_words(tests), cust.alias("cid"))
    base = assets.join(anc, ["level", "id"]).where("cid is not null").join(names, ["level", "id"], "left")
    by_stat: dict[str, list[tuple[int, ThresholdRule]]] = {}
    for i, r in enumerate(rules):
        by_stat.setdefault(r.stat, []).append((i, r))
    hits = []
    for stat, rs in by_stat.items():
        ladder = None
        for _, r in rs:
            subject = F.coalesce(F.col("name"), F.lit("")) if r.by_name else F.col("id")
            p = subject.rlike(f"(?i)^(?:{r.pattern})$") if r.regex else (F.lower(subject) == r.pattern.lower())
            p = p & holds_all(number[c] for c in account_conditions.get(r.account, ()) if c in number)
            if r.account in restricted:
                p = p & (F.col("__priv").isNull() | F.contains("__priv", F.lit("T")))
            val = F.struct(F.lit(stat).alias("stat"), F.lit(r.spec).alias("spec"), F.lit(r.account).alias("account"))
            ladder = F.when(truth(p), val) if ladder is None else ladder.when(truth(p), val)
        hits.append(ladder)
    one = F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")
    return base.select("level", "id", "cid", one).select("level", "id", "cid", "h.*")


def profile_expand(assets: DataFrame, attrs: DataFrame, rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """Profile rules to (level, id, key, spec).

    ``rules``: level, id, key, spec, status; only ``keep`` counts. ``defaults``: level,
    key, spec. A spec with ``%`` on a key without an instance is repeated for every
    ``si_sz_<key>...`` or ``scopeinv_size_<key>...`` attribute of the asset, with the
    attribute's value in place of ``%``.
    """
    own = rules.where("status = 'keep'").join(assets.select("level", "id"), ["level", "id"], "left_semi")
    spec = own.select("level", "id", "key", "spec").unionByName(
        assets.select("level", "id").join(defaults, "level").select("level", "id", "key", "spec")
    )
    fan = F.contains("spec", F.lit("%")) & ~F.contains("key", F.lit("."))
    inst = F.regexp_extract("__attr", f"^(?:{'|'.join(SIZE_PREFIXES)})(.*)$", 1)
    sized = F.startswith(F.col("key"), F.lit(SIZE_PREFIXES[0])) | F.startswith(F.col("key"), F.lit(SIZE_PREFIXES[1]))
    sizes = attrs.where(sized).select(
        "level", "id", F.col("key").alias("__attr"), F.col("val").alias("__size")
    )
    plain = spec.where(~fan)
    many = (
        spec.where(fan)
        .join(sizes, ["level", "id"])
        .withColumn("__inst", inst)
        .where(F.startswith("__inst", F.col("key")))
        .select("level", "id", F.col("__inst").alias("key"), F.replace("spec", F.lit("%"), F.col("__size")).alias("spec"))
    )
    return plain.unionByName(many)

