"""Addresses of both families as numbers: parsing, blocks, public or not.

A number is written as lower-case hex of fixed width (8 digits for version 4, 32 for version 6), so
numbers of one family compare as strings and a prefix of whole digits is a substring.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow import dims

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def v4_hex(address: Column) -> Column:
    """Eight hex digits of a dotted address; null for anything else."""
    octets = F.transform(
        F.split(address, r"\."), lambda o: F.lpad(F.lower(F.hex(o.try_cast("bigint"))), 2, "0")
    )
    return F.when(address.rlike(rf"^{_V4}$"), F.array_join(octets, ""))


def _without_dots(low: Column) -> Column:
    """A dotted tail stands for the last two groups."""
    tail = F.regexp_extract(low, rf":({_V4})$", 1)
    groups = F.regexp_replace(v4_hex(tail), "^(.{4})", "$1:")
    return F.when(tail == "", low).otherwise(F.concat(F.regexp_replace(low, r"[\d.]+$", ""), groups))


def _expanded(sides: Column) -> Column:
    """32 digits of the groups left and right of a double colon (or of all groups)."""
    given = F.flatten(sides)
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(given))
    groups = F.when(F.size(sides) == 1, given).otherwise(
        F.concat(sides[0], zeros, F.try_element_at(sides, F.lit(2)))
    )
    full = F.when(F.size(sides) == 1, F.size(given) == 8).otherwise(
        (F.size(sides) == 2) & (F.size(given) <= 7)
    )
    sound = full & F.forall(given, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(sound, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


def v6_hex(address: Column) -> Column:
    """32 hex digits of an address with colons; null for anything else. A zone is left out."""
    low = F.regexp_replace(F.lower(address), "%[^%/]+$", "")
    none = F.array().cast("array<string>")
    sides = F.transform(
        F.split(_once(low, _without_dots), "::", -1),
        lambda s: F.when(s == "", none).otherwise(F.split(s, ":", -1)),
    )
    return F.when(address.contains(":"), _once(sides, _expanded))


def address_hex(address: Column) -> Column:
    """Number of an address of either family; its width tells which. Null if it is none."""
    return F.coalesce(v4_hex(address), v6_hex(address))


def prefix_key(number: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a number: whole digits and the rest of the next one."""
    digits, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    next_digit = F.conv(F.substr(number, digits + 1, F.lit(1)), 16, 10).cast("int")
    kept = F.when(rest > 0, F.call_function("shiftright", next_digit, 4 - rest))
    return F.concat_ws("/", F.substr(number, F.lit(1), digits), kept.cast("string"))


def _within(number: Column, block: str) -> Column:
    net = ipaddress.ip_network(block)
    width = net.max_prefixlen // 4
    low, high = (f"{int(a):0{width}x}" for a in (net.network_address, net.broadcast_address))
    return (F.length(number) == width) & number.between(low, high)


def is_public_number(number: Column) -> Column:
    """Whether a number lies outside all blocks that are not reachable world-wide; the longest block decides."""
    blocks = [(b, False) for b in dims.CLOSED_BLOCKS] + [(b, True) for b in dims.OPEN_BLOCKS]
    blocks.sort(key=lambda e: -ipaddress.ip_network(e[0]).prefixlen)

    def decide(n: Column) -> Column:
        chain = F
        for block, public in blocks:
            chain = chain.when(_within(n, block), F.lit(public))
        return chain.otherwise(True)

    return F.coalesce(_once(number, lambda n: n.isNotNull() & decide(n)), F.lit(False))
