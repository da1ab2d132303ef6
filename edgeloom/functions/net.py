"""Address tests with built-in expressions: IPv4, IPv6, and CIDR ranges from settings."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
# Hex groups and colons; no lone colon at an end, at most one double colon.
_V6_FORM = r"^(?!:(?!:))(?!.*:::)(?!.*::.*::)[0-9A-Fa-f:]+(?<!(?<!:):)$"


FEW_SPANS = 8


def host_of(remote: Column) -> Column:
    """The host of ``ip:port`` or ``[ip]:port``; anything else is taken as a bare address."""
    return (
        F.when(remote.rlike(r"^\[[^\[\]]*\]:[^:\[\]]*$"), F.regexp_extract(remote, r"^\[([^\[\]]*)\]", 1))
        .when(remote.rlike(r"^[^:\[\]]*:[^:\[\]]*$"), F.substring_index(remote, ":", 1))
        .otherwise(remote)
    )


def ipv4_number(host: Column) -> Column:
    """An IPv4 address, also when written as ::ffff:a.b.c.d, as a number; null for anything else."""
    plain = F.regexp_extract(host, rf"^(?:::[fF]{{4}}:)?({_V4})$", 1)
    octets = F.split(plain, r"\.")
    number = F.aggregate(F.transform(octets, lambda o: F.expr("0L") + o.try_cast("bigint")), F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    return F.when(plain != "", number)


def ipv6_digits(host: Column) -> Column:
    """An IPv6 address as its 32 hex digits; null if it is not one."""
    present = F.size(F.filter(F.split(host, ":"), lambda g: g != ""))
    filled = F.replace(host, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), (8 - present).cast("int"))))
    groups = F.split(F.btrim(filled, F.lit(":")), ":")
    sound = host.rlike(_V6_FORM) & (present <= F.when(F.contains(host, F.lit("::")), 7).otherwise(8))
    digits = F.array_join(F.transform(groups, lambda g: F.lpad(F.when(F.length(g) <= 4, g), 4, "0")), "")
    return F.when(sound, F.lower(F.when(F.length(digits) == 32, digits)))


def address_columns(df: DataFrame, remote: str) -> DataFrame:
    """Adds the readings of an address that `in_ranges` needs, each computed once."""
    hosted = df.withColumn("_host", host_of(F.col(remote)))
    v6 = F.when(F.contains("_host", F.lit(":")), ipv6_digits(F.col("_host")))  # without a colon it is none
    return hosted.withColumns({"_v4": ipv4_number(F.col("_host")), "_v6": v6}).drop("_host")


def _disjoint(cidrs: list[str], version: int) -> list[tuple[int, int]]:
    """The ranges of one address version, in order, with those that overlap or touch made one; malformed ones are passed over."""
    spans = []
    for cidr in cidrs:
        try:
            net = ipaddress.ip_network(cidr, strict=False) if "/" in cidr else None
        except ValueError:
            continue
        if net is not None and net.version == version:
            spans.append((int(net.network_address), int(net.broadcast_address)))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _in_spans(digits: Column, spans: list[tuple[int, int]], width: int) -> Column:
    """Whether hex digits lie in one of the ordered spans, by binary search. The bounds are one folded literal each, so the plan is
    as small for many spans as for one."""
    if not spans:
        return F.lit(False)
    if len(spans) <= FEW_SPANS:  # compared one by one, without a search
        inside = F.lit(False)
        for low, high in spans:
            inside = inside | digits.between(f"{low:0{width}x}", f"{high:0{width}x}")
        return F.coalesce(inside, F.lit(False))
    lows, highs = (F.split(F.lit(",".join(f"{s[side]:0{width}x}" for s in spans)), ",") for side in (0, 1))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(spans).bit_length()))])
    last = F.aggregate(steps, F.lit(-1), lambda at, step: F.when(F.get(lows, at + step) <= digits, at + step).otherwise(at))
    return F.coalesce(digits <= F.get(highs, last), F.lit(False))


def in_ranges(cidrs: list[str]) -> Column:
    """Whether the address of `address_columns` lies in one of the ranges, which may be many. No range allows every address;
    malformed ranges are passed over; an address that cannot be read is in none."""
    if not cidrs:
        return F.lit(True)
    v4 = F.lower(F.lpad(F.hex("_v4"), 8, "0"))
    return _in_spans(v4, _disjoint(cidrs, 4), 8) | _in_spans(F.col("_v6"), _disjoint(cidrs, 6), 32)
