"""Public-address test over IP literals, as Column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, let_sql

# The networks that are not public. First private, loopback, link-local and unspecified space, then the
# special-purpose blocks.
SPECIAL_NETWORKS = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "0.0.0.0/8",
    "100.64.0.0/10",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
    "::/128",
    "::1/128",
    "fc00::/7",
    "fe80::/10",
    "2001:db8::/32",
    "2001:10::/28",
    "ff00::/8",
)

_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!\z)|\z)){4}\z"
_MAPPED = "00000000000000000000ffff"


def is_ipv4(ip: Column | str) -> Column:
    return col(ip).rlike(_V4)


def ipv4_number(ip: Column | str) -> Column:
    """Dotted quad as BIGINT; NULL for anything else."""
    octets = F.transform(F.split(F.when(is_ipv4(ip), col(ip)), r"\."), lambda o: o.cast("bigint"))
    return F.reduce(octets, F.lit(0).cast("bigint"), lambda number, octet: number * 256 + octet)


def ipv6_hex(ip: Column | str) -> Column:
    """IPv6 literal as 32 lower-case hex digits; NULL when malformed."""
    return let(F.lower(col(ip)), lambda text: let(_dotted_tail_to_hex(text), _expand))


def _dotted_tail_to_hex(ip: Column) -> Column:
    tail = F.regexp_extract(ip, r"(\d+\.\d+\.\d+\.\d+)\z", 1)
    quad = ipv4_number(tail)
    as_groups = F.concat(F.lower(F.hex(F.shiftright(quad, 16))), F.lit(":"), F.lower(F.hex(quad.bitwiseAND(F.lit(65535)))))
    return F.when(tail == "", ip).otherwise(F.concat(F.regexp_replace(ip, r"\d+\.\d+\.\d+\.\d+\z", ""), as_groups))


def _expand(ip: Column) -> Column:
    def groups(side: Column) -> Column:
        return F.transform(F.filter(F.split(side, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))

    halves = F.split(ip, "::")
    left, right = groups(halves[0]), groups(F.try_element_at(halves, F.lit(2)))
    missing = F.lit(8) - F.size(left) - F.coalesce(F.size(right), F.lit(0))
    short = F.concat(F.array_join(left, ""), F.repeat(F.lit("0000"), missing), F.array_join(right, ""))
    well_formed = ip.rlike(r"^[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,8}\z") & ~ip.rlike(r":::|::.*::|^:[^:]|[^:]:\z")
    text = F.when(ip.contains("::"), F.when(missing >= 1, short)).otherwise(F.array_join(left, ""))
    return F.when(well_formed & (F.length(text) == 32), text)


def address_hex(ip: Column | str) -> Column:
    """Any address as the 32 hex digits of its IPv6 form, IPv4 as an IPv4-mapped one; NULL for text that is no address."""
    v4 = F.lower(F.lpad(F.hex(ipv4_number(ip)), 8, "0"))
    return F.coalesce(F.concat(F.lit(_MAPPED), v4), ipv6_hex(ip))


def network_prefixes(network: Column | str) -> Column:
    """The prefixes of 32 hex digits that make up a network in CIDR form: one, or up to 8 where its length is no multiple of four bits.

    Bits beyond the length are ignored; an address alone is a network of one. NULL when malformed.
    """
    text = F.split(col(network), "/")
    ip, given = F.get(text, F.lit(0)), F.get(text, F.lit(1))
    digits = address_hex(ip)
    v4 = is_ipv4(ip)
    length = F.when(F.size(text) == 1, 128).otherwise(given.try_cast("int") + F.when(v4, 96).otherwise(0))
    good = digits.isNotNull() & (F.size(text) <= 2) & length.between(F.when(v4, 96).otherwise(0), 128)

    def expand(n: Column) -> Column:
        known, rest = F.floor(n["length"] / 4).cast("int"), n["length"] % 4
        size = F.element_at(F.array(*[F.lit(16 >> r) for r in range(4)]), rest + 1)
        digit = F.conv(F.substring(n["digits"], known + 1, F.lit(1)), 16, 10).cast("int")
        low = digit - digit % size
        head = F.substring(n["digits"], F.lit(1), known)
        ends = F.transform(F.sequence(low, low + size - 1), lambda d: F.concat(head, F.lower(F.hex(d))))
        return F.when(rest == 0, F.array(head)).otherwise(ends)

    return F.when(good, let(F.struct(digits.alias("digits"), length.cast("int").alias("length")), expand))


def _special(version: int) -> str:
    """SQL test of ``n`` (a number for IPv4, 32 hex digits for IPv6) against the special networks."""
    tests = []
    for net in map(ipaddress.ip_network, SPECIAL_NETWORKS):
        if net.version == version:
            low, high = int(net.network_address), int(net.broadcast_address)
            tests.append(f"n between {low} and {high}" if version == 4 else f"n between '{low:032x}' and '{high:032x}'")
    return " or ".join(tests)


def ipv4_is_public(ip: Column | str) -> Column:
    """NULL for text that is no IPv4 address."""
    return let_sql(ipv4_number(ip), "n", f"not ({_special(4)})")


def ip_is_public(ip: Column | str) -> Column:
    """False for every special address and for text that is no address; IPv4-mapped IPv6 counts as IPv4."""
    mapped = "get(transform(array(cast(conv(substring(n, 25, 8), 16, 10) as bigint)), n -> not ({})), 0)".format(_special(4))
    v6 = f"if(startswith(n, '{_MAPPED}'), {mapped}, not ({_special(6)}))"
    return F.coalesce(ipv4_is_public(ip), let_sql(ipv6_hex(ip), "n", v6), F.lit(False))
