"""Number <-> name maps, including bit-flag sets."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol numbers and TCP flag bits of flow records.
PROTOCOLS = {1: "icmp", 2: "igmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 51: "ah"}
TCP_FLAGS = {1: "fin", 2: "syn", 4: "rst", 8: "psh", 16: "ack", 32: "urg"}


def _map(pairs: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def code_name(
    code: Column, names: Mapping[int, str], *, shift: int = 0, mask: int | None = None
) -> Column:
    """Name of a code (of its ``mask``ed bits after a right ``shift``); NULL if unknown."""
    part = F.shiftright(code.cast("bigint"), shift)
    if mask is not None:
        part = part.bitwiseAND(F.lit(mask))
    return F.try_element_at(_map(names), part.cast("int"))


def name_code(name: Column, names: Mapping[int, str], ignore_case: bool = False) -> Column:
    inverse = {(n.lower() if ignore_case else n): c for c, n in names.items()}
    return F.try_element_at(_map(inverse), F.lower(name) if ignore_case else name)


def flag_names(code: Column, flags: Mapping[int, str], sep: str = "|") -> Column:
    """The names of the bits set, lowest first."""
    return F.concat_ws(
        sep, *[F.when(code.bitwiseAND(F.lit(bit)) != 0, F.lit(n)) for bit, n in sorted(flags.items())]
    )


def flags_code(names: Column, flags: Mapping[int, str], sep: str = "|") -> Column:
    """A ``a|b|c`` name set as a number; unknown names add nothing."""
    parts = F.split(names, f"[{sep}]")
    total = F.lit(0)
    for bit, n in sorted(flags.items()):
        total = total + F.when(F.array_contains(parts, n), F.lit(bit)).otherwise(F.lit(0))
    return total


def has_flags(code: Column, wanted: str, flags: Mapping[int, str], sep: str = "|") -> Column:
    """All flags of the literal ``a|b`` set are on."""
    by_name = {n: b for b, n in flags.items()}
    bits = sum(by_name[n] for n in wanted.split(sep))
    return code.bitwiseAND(F.lit(bits)) == bits
