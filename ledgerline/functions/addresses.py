"""128-bit addresses as two longs: reading, canonical text, prefix test.  Column expressions only."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.normalize import ipv4_to_long, is_ipv4, long_to_ipv4
from ledgerline.functions.text import let

GROUP = "[0-9A-Fa-f]{1,4}"
SIDE = rf"(?:{GROUP}(?::{GROUP})*)?"
#: Eight groups, or two sides with one gap between them.
SHAPE = rf"\A(?:{GROUP}(?::{GROUP}){{7}}|{SIDE}::{SIDE})\z"
NO_GROUPS = "array<string>"


def _hex(number: Column) -> Column:
    return F.lower(F.hex(number))


def _plain(text: Column) -> Column:
    """An address whose last 32 bits are in dotted form gets them as two groups; a bad dotted part gives null."""
    last = F.element_at(F.split(text, ":"), -1)
    number = ipv4_to_long(last)
    groups = F.concat(_hex(F.shiftright(number, 16)), F.lit(":"), _hex(number.bitwiseAND(F.lit(0xFFFF))))
    head = F.left(text, F.length(text) - F.length(last))
    return F.when(~text.contains("."), text).when(is_ipv4(last), F.concat(head, groups))


def _groups(side: Column) -> Column:
    return F.when(side == "", F.array().cast(NO_GROUPS)).otherwise(F.split(side, ":"))


def _long(numbers: Column, first: int) -> Column:
    """Four 16-bit numbers as one long; the highest bit is its sign."""
    part = lambda i: F.shiftleft(F.get(numbers, F.lit(first + i)), 48 - 16 * i)
    return part(0).bitwiseOR(part(1)).bitwiseOR(part(2)).bitwiseOR(part(3))


def ipv6_to_longs(text: Column) -> Column:
    """struct(high, low) of a valid address, else null.

    Valid: eight groups of one to four hex digits, the last two possibly as a dotted IPv4
    address without leading zeros; one gap ``::`` stands for at least one zero group.
    """

    def numbers(plain: Column) -> Column:
        at = F.locate("::", plain)
        left = _groups(F.when(at > 0, F.left(plain, at - 1)).otherwise(plain))
        right = F.when(at > 0, _groups(F.substr(plain, at + 2))).otherwise(F.array().cast(NO_GROUPS))

        def fill(sides: Column) -> Column:
            gap = 8 - F.size(sides["left"]) - F.size(sides["right"])
            zeros = F.array_repeat(F.lit("0"), gap)
            all_groups = F.concat(sides["left"], zeros, sides["right"])
            fits = F.when(at > 0, gap >= 1).otherwise(gap == 0)
            return F.when(fits, F.transform(all_groups, lambda g: F.conv(g, 16, 10).cast("bigint")))

        filled = let(F.struct(left.alias("left"), right.alias("right")), fill)
        return F.when(plain.rlike(SHAPE), filled)

    halves = lambda n: F.when(n.isNotNull(), F.struct(_long(n, 0).alias("high"), _long(n, 4).alias("low")))
    return let(let(_plain(text), numbers), halves)


def _shorten(text: Column) -> Column:
    """The longest run of two or more zero groups, the first of equal ones, becomes ``::``."""
    run = lambda n: rf"^(?:(.*?):)??0(?::0){{{n - 1}}}(?::(.*))?$"
    return F.coalesce(*[F.when(text.rlike(run(n)), F.regexp_replace(text, run(n), "$1::$2")) for n in range(8, 1, -1)], text)


def ipv6_text(address: Column) -> Column:
    """Canonical text of struct(high, low): lower case, no leading zeros, one gap; IPv4-mapped addresses end in dotted form."""

    def write(a: Column) -> Column:
        group = lambda half, shift: _hex(F.shiftright(a[half], shift).bitwiseAND(F.lit(0xFFFF)))
        groups = F.concat_ws(":", *[group(half, shift) for half in ("high", "low") for shift in (48, 32, 16, 0)])
        mapped = (a["high"] == 0) & (F.shiftrightunsigned(a["low"], 32) == 0xFFFF)
        dotted = F.concat(F.lit("::ffff:"), long_to_ipv4(a["low"].bitwiseAND(F.lit(0xFFFFFFFF))))
        return F.when(a.isNull(), F.lit(None).cast("string")).when(mapped, dotted).otherwise(let(groups, _shorten))

    return let(address, write)


def _halves(number: int) -> tuple[int, int]:
    """A 128-bit number as two signed longs."""
    signed = lambda half: half - (1 << 64) if half >> 63 else half
    return signed(number >> 64), signed(number & (1 << 64) - 1)


def ipv6_equals(address: Column, text: str) -> Column:
    """The address is this one."""
    high, low = _halves(int(ipaddress.IPv6Address(text)))
    return (address["high"] == high) & (address["low"] == low)


def ipv6_in(address: Column, network: str) -> Column:
    """The address begins with the bits of the network's prefix."""
    net = ipaddress.IPv6Network(network)
    high, low = _halves(int(net.network_address))
    high_mask, low_mask = _halves(int(net.netmask))
    return (address["high"].bitwiseAND(F.lit(high_mask)) == high) & (address["low"].bitwiseAND(F.lit(low_mask)) == low)
