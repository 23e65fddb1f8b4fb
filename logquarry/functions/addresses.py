"""IP addresses as columns."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def ipv4_number(v: Column) -> Column:
    """A dotted address as a number; null if it is none."""
    octets = F.split(v, r"\.")
    number = sum((octets[i].cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0))
    return F.when(v.rlike(IPV4), number)


def in_network(v: Column, network: str) -> Column:
    """Whether an address lies in a network; false for anything that is no address of its family.

    IPv4 is a range of numbers.  IPv6 addresses are compared as 32 hexadecimal digits.
    """
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        number = ipv4_number(v)
        return F.coalesce(number.between(int(net.network_address), int(net.broadcast_address)), F.lit(False))
    full = ipv6_digits(v)
    low, high = (int(a).to_bytes(16, "big").hex() for a in (net.network_address, net.broadcast_address))
    return F.coalesce(full.between(low, high), F.lit(False))


def ipv6_digits(v: Column) -> Column:
    """An IPv6 address as 32 lower-case hexadecimal digits; null if it is none (dotted tails excluded)."""
    low = F.lower(v)
    sides = F.split(low, "::", -1)
    groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))
    pad = lambda a: F.transform(a, lambda g: F.lpad(g, 4, "0"))
    left, right = groups(sides[0]), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    gap = F.lit(8) - F.size(left) - F.size(right)
    joined = F.when(F.size(sides) == 1, left).when((F.size(sides) == 2) & (gap >= 1), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right))
    sound = (F.size(joined) == 8) & F.forall(joined, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(sound, F.array_join(pad(joined), ""))
