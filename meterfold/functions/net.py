"""Client address from a forwarding header, as fixed-width hexadecimal (8 or 32 digits).

Equal-width lowercase hexadecimal sorts like the number itself, so one text column serves both
address families and a network is a range of texts.
"""

import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

from meterfold.functions.binding import bind
from meterfold.functions.text import clean

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = f"{_OCTET}(\\.{_OCTET}){{3}}"


def without_port(last: Column) -> Column:
    """``a.b.c.d:port`` or ``[v6]:port`` without its port and brackets."""
    colons = F.length(last) - F.length(F.replace(last, F.lit(":"), F.lit("")))
    return (
        F.when(last.startswith("["), F.regexp_extract(last, r"^\[([^\]]*)", 1))
        .when(colons == 1, F.regexp_extract(last, r"^([^:]*):", 1))
        .otherwise(last)
    )


def last_hop(header: Column) -> Column:
    """Last ``X-Forwarded-For`` entry without its port or brackets."""
    return bind(clean(F.element_at(F.split(header, ","), -1)), without_port)


def _octets_hex(v4: Column) -> Column:
    return F.concat(*[
        F.lpad(F.lower(F.hex(F.split_part(v4, F.lit("."), F.lit(i)).try_cast("int"))), 2, "0")
        for i in (1, 2, 3, 4)
    ])


def ipv4_hex(addr: Column) -> Column:
    return F.when(addr.rlike(f"^{_V4}$"), _octets_hex(addr))


def _hex_groups(address: Column) -> Column:
    """IPv6 text without its zone, with a dotted tail rewritten as two groups."""
    bare = F.regexp_replace(address, "%[^%]+$", "")
    tail = F.regexp_extract(bare, f":({_V4})$", 1)
    as_groups = _octets_hex(tail)
    return F.when(
        tail != "",
        F.concat(F.regexp_replace(bare, f"{_V4}$", ""),
                 F.substring(as_groups, 1, 4), F.lit(":"), F.substring(as_groups, 5, 4)),
    ).otherwise(bare)


_SHAPE = "^[0-9a-fA-F:]+$"
_MISSHAPEN = "(^:(?!:))|((?<!:):$)|(:::)|([0-9a-fA-F]{5})"


def _expand(groups: Column) -> Column:
    """32 digits from well-formed groups with at most one ``::``, else null."""
    def of_halves(halves: Column) -> Column:
        split = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
        widen = lambda g: F.lpad(F.lower(g), 4, "0")
        left = F.transform(split(halves[0]), widen)
        right = F.transform(split(F.coalesce(F.get(halves, 1), F.lit(""))), widen)
        return bind(F.struct(left.alias("l"), right.alias("r"), F.size(halves).alias("n")), of_parts)

    def of_parts(parts: Column) -> Column:
        used = F.size(parts["l"]) + F.size(parts["r"])
        fits = F.when(parts["n"] == 2, used <= 7).otherwise((parts["n"] == 1) & (used == 8))
        zeros = F.array_repeat(F.lit("0000"), F.greatest(F.lit(8) - used, F.lit(0)))
        return F.when(fits, F.array_join(F.concat(parts["l"], zeros, parts["r"]), ""))

    return F.when(groups.rlike(_SHAPE) & ~groups.rlike(_MISSHAPEN),
                  bind(F.split(groups, "::"), of_halves))


def ipv6_hex(addr: Column) -> Column:
    """32 hex digits, or null when the text is no IPv6 address."""
    return bind(_hex_groups(addr), _expand)


def address_hex(addr: Column) -> Column:
    return F.coalesce(ipv4_hex(addr), F.when(addr.contains(":"), ipv6_hex(addr)))


def with_client_hex(log: DataFrame, header: str, name: str) -> DataFrame:
    """Add the client address of a forwarding header as hex digits.

    Each step is bound, so a filter on the result that is pushed below repeats no step.
    """
    return log.withColumn(name, bind(last_hop(F.col(header)), address_hex))


def address_key(digits: Column) -> Column:
    """Addresses as text in order: all of the short kind before all of the long kind."""
    return bind(digits, lambda d: F.concat(F.when(F.length(d) == 8, "4").otherwise("6"), d))


def parse_ranges(setting: str) -> list[tuple[str, str]]:
    """Allowlist setting to disjoint ranges of address keys, both ends included, in order.

    Entries that are neither an address nor a network are ignored; networks that lie inside or right
    behind one another become one range.
    """
    networks = {4: [], 6: []}
    for entry in filter(None, (part.strip() for part in setting.split(","))):
        try:
            network = ipaddress.ip_network(entry, strict=False)
        except ValueError:
            continue
        networks[network.version].append(network)
    ranges = []
    for version, found in networks.items():
        digits = 8 if version == 4 else 32
        past = None
        for network in ipaddress.collapse_addresses(found):
            first, last = int(network.network_address), int(network.broadcast_address)
            if first == past:
                ranges[-1] = (ranges[-1][0], f"{version}{last:0{digits}x}")
            else:
                ranges.append((f"{version}{first:0{digits}x}", f"{version}{last:0{digits}x}"))
            past = last + 1
    return ranges


def in_ranges(key: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether a key lies in one of the disjoint, ordered ranges; false for null.

    A binary search over two constant arrays: the last range that starts at or before the key is found
    by halving steps, and its end decides.
    """
    starts, ends = (F.split(F.lit(",".join(side)), ",") for side in zip(*ranges))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(ranges).bit_length()))])

    def search(key: Column) -> Column:
        place = F.aggregate(steps, F.lit(-1), lambda at, step: F.when(
            F.get(starts, at + step) <= key, at + step).otherwise(at))
        return bind(place, lambda at: (at >= 0) & (key <= F.get(ends, at)))

    return F.coalesce(bind(key, search), F.lit(False))
