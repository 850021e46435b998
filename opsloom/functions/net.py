"""IPv4/IPv6 addresses, prefixes and AS paths as Column expressions.

IPv4 addresses are ``bigint`` in 0..2^32-1; IPv6 addresses are 16-byte
``binary`` values, which compare byte by byte in address order.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

V4_BITS = 32
V4_MAX = (1 << 32) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def ip_parse(text: Column) -> Column:
    """Dotted quad to number; NULL when it is not an address."""
    parts = F.split(text, "\\.")
    num = F.lit(0).cast("bigint")
    for i, weight in enumerate((1 << 24, 1 << 16, 1 << 8, 1)):
        num = num + F.get(parts, F.lit(i)).try_cast("bigint") * weight
    return F.when(text.rlike(f"^{_OCTET}(\\.{_OCTET}){{3}}$"), num)


def ip_format(addr: Column) -> Column:
    a = addr.cast("bigint")
    octets = [F.shiftright(a, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def mask(length: Column) -> Column:
    """The netmask of a prefix length."""
    low = F.expr("shiftleft(bigint(1), 32)") - F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.lit(V4_BITS) - length.cast("int")
    )
    return low


def network(addr: Column, length: Column) -> Column:
    """The first address of the prefix that holds ``addr``."""
    return addr.cast("bigint").bitwiseAND(mask(length))


def broadcast_address(addr: Column, length: Column) -> Column:
    return network(addr, length) + F.lit(V4_MAX) - mask(length)


def prefix_parse(text: Column) -> Column:
    """``a.b.c.d/len`` (trailing octets may be left out) to struct(addr, len)."""

    def halves(body: Column) -> Column:
        head = F.get(body, F.lit(0))
        dots = F.size(F.split(head, "\\."))
        length = F.coalesce(F.get(body, F.lit(1)).try_cast("int"), F.when(F.size(body) == 1, dots * 8))
        full = F.concat(head, F.repeat(F.lit(".0"), F.lit(4) - dots))
        return F.struct(ip_parse(full).alias("addr"), length.alias("len"))

    def prefix(p: Column) -> Column:
        ok = p["addr"].isNotNull() & p["len"].between(0, V4_BITS)
        return F.when(ok, F.struct(network(p["addr"], p["len"]).alias("addr"), p["len"].alias("len")))

    return let(let(F.split(text, "/"), halves), prefix)


def in_prefix(addr: Column, prefix: str) -> Column:
    """Address-in-prefix test for a literal prefix: plain Column arithmetic."""
    body, _, length = prefix.partition("/")
    octets = body.split(".")
    bits = int(length) if length else 8 * len(octets)
    net = ipaddress.IPv4Network((".".join(octets + ["0"] * (4 - len(octets))), bits), strict=False)
    return addr.between(int(net.network_address), int(net.broadcast_address))


# --- IPv6: text, bits and neighbours ----------------------------------------------

V6_BITS = 128
V6_MIN, V6_MAX = bytes(16), b"\xff" * 16
# one past the last address: longer, so it sorts after every address
V6_END = V6_MAX + b"\x00"
_MAPPED = "0" * 20 + "FFFF"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _hex32(quad: Column) -> Column:
    return F.lpad(F.hex(ip_parse(quad)), 8, "0")


def ip6_parse(text: Column) -> Column:
    """Colon text to 16 bytes; an IPv4 text gives its mapped address, other text NULL.

    ``::`` stands for one group of zeros or more; the last two groups may be a dotted quad.
    Every step is bound once: repeated, the text would be parsed again at each place.
    """

    def plain(t: Column) -> Column:
        def two(tail: Column) -> Column:
            groups = let(_hex32(tail), lambda h: F.concat(F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
            return F.when(tail != "", F.concat(t.substr(F.lit(1), F.length(t) - F.length(tail)), groups)).otherwise(t)

        return F.when(F.contains(t, F.lit(".")), let(F.regexp_extract(t, f"^(?:.*:)({_QUAD})$", 1), two)).otherwise(t)

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))

    def sides(t: Column) -> Column:
        at = F.instr(t, F.lit("::"))
        short = at > 0
        left = groups(F.when(short, t.substr(F.lit(1), at - 1)).otherwise(t))
        right = groups(F.when(short, t.substr(at + 2, F.length(t))).otherwise(F.lit("")))
        return F.struct(left.alias("left"), right.alias("right"), short.alias("short"))

    def every(s: Column) -> Column:
        gap = 8 - F.size(s["left"]) - F.size(s["right"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))
        fits = F.when(s["short"], gap >= 1).otherwise(gap == 0)
        return F.struct(F.concat(s["left"], zeros, s["right"]).alias("groups"), fits.alias("fits"))

    def whole(s: Column) -> Column:
        fits = s["fits"] & F.forall(s["groups"], lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
        return F.when(fits, F.unhex(F.array_join(F.transform(s["groups"], lambda g: F.lpad(g, 4, "0")), "")))

    def address(t: Column) -> Column:
        quad = F.unhex(F.concat(F.lit(_MAPPED), _hex32(t)))
        return F.when(t.rlike(f"^{_QUAD}$"), quad).when(F.contains(t, F.lit(":")), let(let(let(plain(t), sides), every), whole))

    return let(text, address)


def ip6_format(addr: Column) -> Column:
    """16 bytes to the shortest text: the first longest run of zero groups is ``::``; mapped and compatible IPv4 addresses end in a dotted quad."""

    def shortest(s: Column) -> Column:
        group, zeros = s["group"], s["zeros"]
        out = F.array_join(group, ":")
        for n in range(2, 9):
            at = F.instr(zeros, F.lit("0" * n))
            before, after = F.slice(group, F.lit(1), at - 1), F.slice(group, at + n, F.lit(8))
            out = F.when(at > 0, F.concat(F.array_join(before, ":"), F.lit("::"), F.array_join(after, ":"))).otherwise(out)
        return out

    def marked(group: Column) -> Column:
        zeros = F.array_join(F.transform(group, lambda g: F.when(g == "0", F.lit("0")).otherwise(F.lit("x"))), "")
        return F.struct(group.alias("group"), zeros.alias("zeros"))

    def text(h: Column) -> Column:
        group = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(h, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
        quad = let(F.conv(F.substring(h, 25, 8), 16, 10).cast("bigint"), ip_format)
        mapped = F.startswith(h, F.lit(_MAPPED.lower()))
        compatible = F.startswith(h, F.lit("0" * 24)) & (F.substring(h, 25, 4) != "0000")
        out = let(let(group, marked), shortest)
        four = F.when(mapped, F.concat(F.lit("::ffff:"), quad)).when(compatible, F.concat(F.lit("::"), quad))
        return F.when(h.isNotNull(), F.coalesce(four, out))

    return let(F.lower(F.hex(addr)), text)


def ip6_next(addr: Column) -> Column:
    """The next address; ``V6_END`` after the last one."""

    def step(h: Column) -> Column:
        ones = F.length(F.regexp_extract(h, "F*$", 0))
        digit = F.substring(h, 32 - ones, F.lit(1))
        up = F.translate(digit, "0123456789ABCDE", "123456789ABCDEF")
        return F.when(ones == 32, F.lit(V6_END.hex())).otherwise(
            F.concat(h.substr(F.lit(1), 31 - ones), up, F.repeat(F.lit("0"), ones))
        )

    return F.unhex(let(F.hex(addr), step))


def ip6_prev(addr: Column) -> Column:
    """The address before; the last one before ``V6_END``."""

    def step(h: Column) -> Column:
        zeros = F.length(F.regexp_extract(h, "0*$", 0))
        digit = F.substring(h, 32 - zeros, F.lit(1))
        down = F.translate(digit, "123456789ABCDEF", "0123456789ABCDE")
        return F.when(F.length(h) > 32, F.lit(V6_MAX.hex())).otherwise(
            F.concat(h.substr(F.lit(1), 31 - zeros), down, F.repeat(F.lit("F"), zeros))
        )

    return F.unhex(let(F.hex(addr), step))


def ip6_bits(addr: Column) -> Column:
    """The address as 128 characters 0 and 1 (129 for ``V6_END``)."""
    h = F.hex(addr)
    halves = [F.lpad(F.conv(F.substring(h, at, 16), 16, 2), 64, "0") for at in (1, 17)]
    return F.when(F.length(h) > 32, F.lit("1" + "0" * V6_BITS)).otherwise(F.concat(*halves))


def ip6_of_bits(bits: Column) -> Column:
    """128 characters 0 and 1 to an address."""
    halves = [F.lpad(F.conv(F.substring(bits, at, 64), 2, 16), 16, "0") for at in (1, 65)]
    return F.unhex(F.concat(*halves))


_DIGITS = "0123456789ABCDEF"


def _filled6(addr: Column, length: Column, ones: bool) -> Column:
    """An address with the bits behind the first ``length`` cleared, or set: on its hex digits, of which one at most is cut."""
    n = F.when(length < 0, F.lit(0)).when(length > V6_BITS, F.lit(V6_BITS)).otherwise(length.cast("int"))
    h, whole = F.hex(addr), F.shiftright(n, 2)
    digit, part = h.substr(whole + 1, F.lit(1)), F.lit("")
    for bits in (1, 2, 3):
        low = 15 >> bits
        cut = "".join(_DIGITS[v | low if ones else v & ~low] for v in range(16))
        part = F.when(n.bitwiseAND(F.lit(3)) == bits, F.translate(digit, _DIGITS, cut)).otherwise(part)
    filled = F.rpad(F.concat(h.substr(F.lit(1), whole), part), V6_BITS // 4, "F" if ones else "0")
    return F.when(F.octet_length(addr) == V6_BITS // 8, F.unhex(filled))


def network6(addr: Column, length: Column) -> Column:
    """The first address of the prefix that holds ``addr``."""
    return _filled6(addr, length, False)


def broadcast_address6(addr: Column, length: Column) -> Column:
    """The last address of the prefix that holds ``addr``."""
    return _filled6(addr, length, True)


def prefix6_parse(text: Column) -> Column:
    """``address/len`` (128 without a length) to struct(addr, len)."""

    def halves(body: Column) -> Column:
        length = F.when(F.size(body) == 1, F.lit(V6_BITS)).otherwise(F.get(body, F.lit(1)).try_cast("int"))
        return F.struct(F.when(F.size(body) <= 2, ip6_parse(F.get(body, F.lit(0)))).alias("addr"), length.alias("len"))

    def prefix(p: Column) -> Column:
        ok = p["addr"].isNotNull() & p["len"].between(0, V6_BITS)
        return F.when(ok, F.struct(network6(p["addr"], p["len"]).alias("addr"), p["len"].alias("len")))

    return F.when(F.contains(text, F.lit(":")), let(let(F.split(text, "/"), halves), prefix))


def in_prefix6(addr: Column, prefix: str) -> Column:
    """Address-in-prefix test for a literal IPv6 prefix."""
    net = ipaddress.IPv6Network(prefix, strict=False)
    first, last = (F.lit(bytearray(x.packed)) for x in (net.network_address, net.broadcast_address))
    return addr.between(first, last)


def range_cidrs6(lo: Column, hi: Column) -> Column:
    """The fewest prefixes of an IPv6 range: ``array<struct<addr binary, len int>>`` in address order.

    On the bits of lo and of hi + 1, with p the first in which they differ. Going up from lo:
    the block at its last 1 behind p (at p if there is none), then one for every 0 between,
    with that bit set. Then one for every 1 of the end behind p, with that bit cleared.
    """

    def bit(s: Column, i: Column) -> Column:
        return F.substring(s, i, F.lit(1))

    def block(head: Column, length: Column) -> Column:
        return F.struct(ip6_of_bits(F.rpad(head, V6_BITS, "0")).alias("addr"), length.cast("int").alias("len"))

    def ends(s: Column) -> Column:
        p = F.element_at(F.filter(F.sequence(F.lit(1), F.lit(V6_BITS + 1)), lambda i: bit(s["a"], i) != bit(s["e"], i)), 1)
        return F.struct(s["a"].alias("a"), s["e"].alias("e"), p.alias("p"))

    def places(s: Column) -> Column:
        behind = F.filter(F.sequence(F.lit(1), F.lit(V6_BITS + 1)), lambda i: i > s["p"])
        last = F.coalesce(F.array_max(F.filter(behind, lambda i: bit(s["a"], i) == "1")), s["p"])
        return F.struct(s["a"].alias("a"), s["e"].alias("e"), behind.alias("behind"), last.alias("last"))

    def blocks(s: Column) -> Column:
        # the first character is the carry above the 128 bits
        inside = lambda text, n: text.substr(F.lit(2), n)
        first = F.array(block(inside(s["a"], s["last"] - 1), s["last"] - 1))
        up = F.transform(
            F.filter(s["behind"], lambda i: (i < s["last"]) & (bit(s["a"], i) == "0")),
            lambda i: block(F.concat(inside(s["a"], i - 2), F.lit("1")), i - 1),
        )
        down = F.transform(
            F.filter(s["behind"], lambda i: bit(s["e"], i) == "1"),
            lambda i: block(F.concat(inside(s["e"], i - 2), F.lit("0")), i - 1),
        )
        return F.array_sort(F.concat(first, up, down))

    both = F.struct(F.concat(F.lit("0"), ip6_bits(lo)).alias("a"), F.lpad(ip6_bits(ip6_next(hi)), V6_BITS + 1, "0").alias("e"))
    return let(let(let(both, ends), places), blocks)


# --- AS paths -----------------------------------------------------------------


def aspath_parse(text: Column) -> Column:
    """Blank-separated AS numbers to ``array<bigint>`` (set braces are dropped)."""
    clean = F.trim(F.regexp_replace(text, "[{}(),\\[\\]\\s]+", " "))
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(
        F.split(clean, " ").cast("array<bigint>")
    )


def aspath_origin(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))


def aspath_text(path: Column) -> Column:
    """The path as ``' a b c '``: one blank before and after every element."""
    return F.concat(F.lit(" "), F.concat_ws("  ", path.cast("array<string>")), F.lit(" "))


def aspath_match(path: Column, pattern: str) -> Column:
    """Element-wise pattern over a path.

    ``7018`` one element, ``!7018`` any other element, ``.`` any element,
    ``[1 2 3]``/``[!1 2 3]`` (not) one of a set; each may be followed by ``*``,
    ``+``, ``?`` or ``{m,n}``. ``^`` and ``$`` anchor; without them the pattern may
    match anywhere in the path.
    """
    return aspath_text(path).rlike(aspath_regex(pattern))


def aspath_regex(pattern: str) -> str:
    body = pattern.strip()
    left, right = body.startswith("^"), body.endswith("$")
    body = body.removeprefix("^").removesuffix("$")
    out = []
    for m in re.finditer(r"(!?)(?:(\d+)|(\.)|\[(!?)([\d\s]+)\])\s*([*+?]|\{\d*,?\d*\})?", body):
        neg, one, dot, set_neg, members, rep = m.groups()
        if dot:
            elem = r"\d+"
        else:
            alt = "|".join([one] if one else members.split())
            elem = rf"(?!(?:{alt}) )\d+" if neg or set_neg else rf"(?:{alt})"
        out.append(f"(?: {elem} ){rep or ''}")
    return ("^" if left else "") + "".join(out) + ("$" if right else "")


# --- dyadic blocks ------------------------------------------------------------


def range_blocks(lo: Column, hi: Column) -> Column:
    """The fewest aligned power-of-two blocks that make up ``[lo, hi]``.

    Returns ``array<struct<start bigint, size_log2 int>>`` in address order. With
    p the highest bit in which lo and hi+1 differ, the range splits at the
    multiple m of 2^p; the left part holds one block per set bit of m-lo and the
    right part one per set bit of hi+1-m.
    """
    one = F.lit(1).cast("bigint")

    def low_bits(x: Column, k: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", one, k) - 1)

    def has(x: Column, k: Column) -> Column:
        return F.call_function("shiftright", x, k).bitwiseAND(one) == 1

    def split(s: Column) -> Column:
        # bit length via the binary text: exact for all 63 bits
        p = F.length(F.bin(s["lo"].bitwiseXOR(s["end"]))) - 1
        return F.struct(s["end"].alias("end"), s["lo"].alias("lo"), p.alias("p"))

    def parts(s: Column) -> Column:
        right = low_bits(s["end"], s["p"])
        return F.struct(
            s["end"].alias("end"), (s["end"] - right - s["lo"]).alias("left"), right.alias("right"),
            F.sequence(F.lit(0), s["p"]).alias("ks"),
        )

    def blocks(s: Column) -> Column:
        m = s["end"] - s["right"]
        lefts = F.transform(
            F.filter(s["ks"], lambda k: has(s["left"], k)),
            lambda k: F.struct((m - (s["left"] - low_bits(s["left"], k))).alias("start"), k.alias("size_log2")),
        )
        rights = F.transform(
            F.filter(s["ks"], lambda k: has(s["right"], k)),
            lambda k: F.struct((s["end"] - low_bits(s["end"], k + 1)).alias("start"), k.alias("size_log2")),
        )
        return F.array_sort(F.concat(lefts, rights))

    ends = F.struct(lo.cast("bigint").alias("lo"), (hi.cast("bigint") + 1).alias("end"))
    return let(let(let(ends, split), parts), blocks)


def range_cidrs(lo: Column, hi: Column) -> Column:
    """``range_blocks`` as IPv4 prefixes: ``array<struct<addr bigint, len int>>``."""
    return F.transform(
        range_blocks(lo, hi),
        lambda b: F.struct(
            b["start"].alias("addr"), (F.lit(V4_BITS) - b["size_log2"]).alias("len")
        ),
    )
