"""Text measures and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(c: Column) -> Column:
    """Bits of entropy of a text's characters; 0 for an empty one."""
    chars = F.split(c, "")
    n = F.length(c).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
    return F.when(F.length(c) > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def glob(c: Column, pattern: str) -> Column:
    """Whether the text matches a pattern with ``*`` and ``?``; other characters stand for themselves."""
    like = "".join({"*": "%", "?": "_"}.get(x, "\\" + x if x in "%_\\" else x) for x in pattern)
    return c.like(like)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def truncated(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("true", "t", "yes", "y", "1")


def size_bytes(c: Column) -> Column:
    """Bytes of sizes such as 16kb."""
    t = F.lower(F.trim(c))
    unit = F.regexp_extract(t, "([a-z]*)$", 1)
    factor = F.when(unit.isin("k", "kb"), 1024).when(unit.isin("m", "mb"), 1024**2).when(unit.isin("g", "gb"), 1024**3).otherwise(1)
    return (F.regexp_extract(t, r"^([0-9.]+)", 1).try_cast("double") * factor).cast("long")


def ipv4_number(c: Column) -> Column:
    """An IPv4 address as a long, null for anything else."""
    parts = F.split(c, r"\.")
    ok = c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.try_cast("long")))


def in_network(c: Column, cidr: str) -> Column:
    """Whether an IPv4 address lies in a network such as 10.0.0.0/8."""
    import ipaddress

    net = ipaddress.IPv4Network(cidr)
    return ipv4_number(c).between(int(net.network_address), int(net.broadcast_address))
