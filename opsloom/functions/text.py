"""Text functions: escapes, cut, tr, fold, templates, checksums."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters that the HTML escape writes as &#xHH; and the URL
# escape as %HH (the URL escape adds blank and plus).
HTML_SPECIALS = "&;%|'\"<>\\"
URL_SPECIALS = " +%;&|'\"<>\\"


def _runs(c: Column, runs: str, special: str, rewrite) -> Column:
    """Cut into runs by a pattern and rewrite those that are special."""
    parts = F.regexp_extract_all(c, F.lit(f"({runs})"), F.lit(1))
    return F.array_join(F.transform(parts, lambda r: F.when(r.rlike(special), rewrite(r)).otherwise(r)), "")


def url_enc(c: Column) -> Column:
    """``%HH`` for specials and bytes outside printable ASCII; line ends become blanks."""
    flat = F.translate(c, "\n\r", "  ")
    plain = f"[!-~&&[^{re.escape(URL_SPECIALS.strip())}]]"
    other = f"[^!-~{re.escape(URL_SPECIALS.strip())}]|[{re.escape(URL_SPECIALS.strip())}]"
    return _runs(
        flat, f"{plain}+|(?:{other})+", f"^(?:{other})", lambda r: F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
    )


def url_dec(c: Column) -> Column:
    """Plus stays plus: the escape never writes a blank that way."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def html_enc(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&#x26;"))
    out = F.regexp_replace(out, "(?<!&#x26);", "&#x3B;")
    for ch in HTML_SPECIALS[2:]:
        out = F.replace(out, F.lit(ch), F.lit(f"&#x{ord(ch):02X};"))
    return out


def html_dec(c: Column) -> Column:
    special = "&#x[0-9A-Fa-f]{2};"
    return _runs(
        c, f"[^&]+|{special}|&", f"^{special}$", lambda r: F.char(F.conv(F.substring(r, 4, 2), 16, 10).cast("int"))
    )


def simple_enc(c: Column, separators: str = "|") -> Column:
    """Backslash before separators, ``\\t`` for tabs."""
    out = F.regexp_replace(c, f"([{re.escape(separators)}])", r"\\$1")
    return F.replace(out, F.lit("\t"), F.lit("\\t"))


def simple_dec(c: Column, separators: str = "|") -> Column:
    out = F.replace(c, F.lit("\\t"), F.lit("\t"))
    return F.regexp_replace(out, rf"\\([{re.escape(separators)}])", "$1")


def _spans(spec: str) -> list[tuple[int, int | None]]:
    """``"1,3-5,7-"`` to sorted, merged 1-based inclusive spans."""
    spans = []
    for part in spec.split(","):
        lo, dash, hi = part.partition("-")
        first = int(lo or 1)
        spans.append((first, (int(hi) if hi else None) if dash else first))
    spans.sort(key=lambda s: s[0])
    merged: list[tuple[int, int | None]] = []
    for lo, hi in spans:
        if merged and (merged[-1][1] is None or lo <= merged[-1][1] + 1):
            end = merged[-1][1]
            merged[-1] = (merged[-1][0], None if end is None or hi is None else max(end, hi))
        else:
            merged.append((lo, hi))
    return merged


def cut_chars(c: Column, spec: str, out_delim: str = "") -> Column:
    """Select character positions."""
    n = F.length(c)
    parts = [
        F.when(
            n >= lo, F.substring(c, F.lit(lo), (n if hi is None else F.lit(hi)) - (lo - 1))
        )
        for lo, hi in _spans(spec)
    ]
    return F.concat_ws(out_delim, *parts)


def cut_fields(
    c: Column, spec: str, delim: str = "\t", out_delim: str | None = None, only_delimited: bool = False
) -> Column:
    """Select delimited fields.

    A line without the delimiter is passed whole, or gives NULL with
    ``only_delimited``.
    """
    parts = F.split(c, re.escape(delim))
    n = F.size(parts)
    chosen = [
        F.slice(parts, F.lit(lo), F.greatest((n if hi is None else F.least(n, F.lit(hi))) - (lo - 1), F.lit(0)))
        for lo, hi in _spans(spec)
    ]
    picked = F.concat_ws(delim if out_delim is None else out_delim, F.concat(*chosen))
    whole = F.lit(None).cast("string") if only_delimited else c
    return F.when(F.contains(c, F.lit(delim)), picked).otherwise(whole)


def _char_class(chars: str, complement: bool) -> str:
    return f"[{'^' if complement else ''}{re.escape(chars)}]"


def _expand(spec: str) -> str:
    """``a-z`` ranges to the characters they stand for."""
    return re.sub(
        r"(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), spec, flags=re.S
    )


def tr(
    c: Column,
    chars: str,
    to: str = "",
    *,
    delete: bool = False,
    squeeze: bool = False,
    complement: bool = False,
) -> Column:
    """Translate, delete or squeeze characters.

    A short second set is padded with its last character. With ``complement``
    every character outside ``chars`` becomes the last character of ``to``.
    """
    src, dst = _expand(chars), _expand(to)
    if delete:
        out = F.regexp_replace(c, _char_class(src, complement), "")
        return F.regexp_replace(out, f"({_char_class(dst, False)})\\1+", "$1") if squeeze and dst else out
    out = c
    if dst:
        if complement:
            out = F.regexp_replace(out, _char_class(src, True), re.escape(dst[-1]))
        else:
            out = F.translate(out, src, (dst + dst[-1] * len(src))[: len(src)])
    if squeeze:
        out = F.regexp_replace(out, f"({_char_class(dst or src, complement and not dst)})\\1+", "$1")
    return out


def fold(c: Column, width: int, at_blanks: bool = False) -> Column:
    """Wrap every line at ``width`` characters to an array of lines.

    With ``at_blanks`` a line that is too long ends after its last blank, if it
    has one.
    """
    pieces = F.lit(rf"(.{{1,{width}}}\z|.{{0,{width - 1}}}[ \t]|.{{1,{width}}})")

    def one(line: Column) -> Column:
        if at_blanks:
            return F.when(line == "", F.array(line)).otherwise(F.regexp_extract_all(line, pieces, F.lit(1)))
        n = F.greatest(F.ceil(F.length(line) / width).cast("int"), F.lit(1))
        return F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.substring(line, i * width + 1, F.lit(width))
        )

    return F.flatten(F.transform(F.split(c, "\n"), one))


def checksum(c: Column, method: str) -> Column:
    """``crc`` (number), ``md5`` or ``sha1`` (hex text) of one record."""
    raw = c.cast("binary")
    return {"crc": F.crc32, "md5": F.md5, "sha1": F.sha1}[method](raw)


def html_ref(c: Column, tag: str = "a") -> Column:
    """The text inside the first ``tag`` element."""
    return F.regexp_extract(c, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>", 1)


def json_path(c: Column, path: str) -> Column:
    """``a.b[0]`` access into JSON text."""
    return F.get_json_object(c, "$." + path.removeprefix("$."))


def vars_unpack(c: Column, pair_sep: str = "\t\t", kv_sep: str = "=") -> Column:
    """``k=v`` lists to a map; the last of equal keys wins."""
    pairs = F.filter(F.split(c, re.escape(pair_sep)), lambda p: F.contains(p, F.lit(kv_sep)))
    keyed = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(p, kv_sep, 1).alias("k"),
            F.substring(p, F.instr(p, kv_sep) + len(kv_sep), F.length(p)).alias("v"),
        ),
    )
    keys = F.array_distinct(F.transform(keyed, lambda s: s["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(keyed, lambda s: s["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, last)


def map_edit(c: Column, edits: Sequence[tuple[str, str]]) -> Column:
    """A chain of regular-expression substitutions."""
    for pat, sub in edits:
        c = F.regexp_replace(c, pat, sub)
    return c


TEMPLATE_ITEM = r"%\(([^)]*)\)%"


def template_text(
    assets: DataFrame, closure: DataFrame, attrs: DataFrame, template: str, shown: int = 3
) -> DataFrame:
    """Fill ``%(level.key/level.key)%`` items of a template per asset.

    An item lists the values of ``key`` on the asset's ancestors at ``level`` (the
    asset itself if no level is given): at most ``shown`` in order, one per line,
    then ``...``. The first alternative with a value is used; if none has one,
    the asset's id. ``closure`` is ``map_closure`` output.
    """
    specs = re.findall(TEMPLATE_ITEM, template)
    wanted = sorted({tuple(alt.rpartition(".")[::2]) for sp in specs for alt in sp.split("/")})
    own = assets.select(
        F.col("level").alias("level1"), F.col("id").alias("id1"),
        F.lit("").alias("level2"), F.col("id").alias("id2"), F.col("level").alias("at"),
    )
    reach = closure.select(
        "level1", "id1", "level2", "id2", F.col("level2").alias("at")
    ).unionByName(own).distinct()
    hit = F.lit(False)
    for level, key in wanted:
        hit = hit | ((F.col("level2") == level) & (F.col("key") == key))
    named = attrs.select(F.col("level").alias("at"), F.col("id").alias("id2"), "key", "val")
    vals = (
        reach.join(named, ["at", "id2"])
        .where(hit)
        .select("level1", "id1", F.concat_ws(".", "level2", "key").alias("item"), "val")
        .distinct()
    )
    first = smallest(vals, ["level1", "id1", "item"], "val", shown + 1)
    text = F.concat(
        F.array_join(F.slice("vs", 1, shown), "\n"),
        F.when(F.size("vs") > shown, F.lit(" ...")).otherwise(F.lit("")),
    )
    names = [".".join(w) for w in wanted]
    wide = (
        first.select("level1", "id1", "item", text.alias("t"))
        .groupBy(F.col("level1").alias("level"), F.col("id1").alias("id"))
        .agg(*[F.max(F.when(F.col("item") == n, F.col("t"))).alias(f"__t{i}") for i, n in enumerate(names)])
    )
    out = assets.join(wide, ["level", "id"], "left")
    pieces: list[Column] = []
    at = 0
    for m in re.finditer(TEMPLATE_ITEM, template):
        alts = [".".join(a.rpartition(".")[::2]) for a in m[1].split("/")]
        pieces += [
            F.lit(template[at : m.start()]),
            F.coalesce(*[F.col(f"__t{names.index(a)}") for a in alts], F.col("id")),
        ]
        at = m.end()
    pieces.append(F.lit(template[at:]))
    return out.withColumn("text", F.concat(*pieces)).drop(*[f"__t{i}" for i in range(len(names))])


def smallest(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """The n smallest distinct values per key, as a sorted array ``vs``.

    Distinct values first; a rank limit, which Spark applies before the shuffle as well,
    leaves every task n values per key.
    """
    once = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    few = once.withColumn("__r", rank).where(F.col("__r") <= n)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("vs"))
