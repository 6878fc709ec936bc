"""Predicates of the routing plane as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: Column) -> Column:
    """An anchored regular expression in which only ``*`` is wild."""
    return F.concat(F.lit("(?-s)^\\Q"), F.replace(F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E$"))


def glob_match(value: Column, pattern: Column) -> Column:
    return F.regexp(value, glob_regex(pattern))


def string_match(value: Column, exact: Column, prefix: Column, regex: Column) -> Column:
    """Any of the conditions that are set holds; a null value never matches."""
    set_ = lambda c: F.coalesce(c, F.lit("")) != ""
    hit = (set_(exact) & (value == exact)) | (set_(prefix) & F.startswith(value, prefix)) | (set_(regex) & F.regexp(value, regex))
    return F.coalesce(hit, F.lit(False))


def minutes(clock: Column) -> Column:
    """HH:MM as minutes; 0 where it is not of that form."""
    part = lambda i: F.coalesce(F.try_element_at(F.split(clock, ":"), F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(F.size(F.split(clock, ":")) == 2, part(1) * 60 + part(2)).otherwise(0)


def in_window(ts: Column, start: Column, end: Column, days: Column) -> Column:
    """Within [start, end) minutes of the UTC day, past midnight if end is before start,
    and on one of the days (0 is Sunday) if any are given. The session time zone is UTC."""
    now = F.hour(ts) * 60 + F.minute(ts)
    day = F.coalesce(F.size(days) <= 0, F.lit(True)) | F.array_contains(days, F.dayofweek(ts) - 1)
    clock = F.when(start <= end, (now >= start) & (now < end)).otherwise((now >= start) | (now < end))
    return F.coalesce(day & clock, F.lit(False))


def threshold(text: Column) -> Column:
    """struct(op, value) of conditions such as ``>=50`` or ``<100ms`` (ms count as
    thousandths); ``==`` without an operator; null value where none can be read."""
    bare = F.trim(text)
    op = F.regexp_extract(bare, "^(>=|<=|==|>|<)", 1)
    rest = F.trim(F.substring(bare, F.length(op) + 1, F.length(bare)))
    number = F.regexp_replace(rest, "(ms|s)$", "").try_cast("double")
    value = F.when(rest.endswith("ms"), number / 1000).otherwise(number)
    return F.struct(F.when(op == "", "==").otherwise(op).alias("op"), value.alias("value"))


def holds(condition: Column, value: Column) -> Column:
    """A threshold struct on a value; true for a null condition."""
    op, limit = condition["op"], condition["value"]
    test = F.when(op == ">", value > limit).when(op == "<", value < limit).when(op == ">=", value >= limit).when(op == "<=", value <= limit).when(op == "==", value == limit).otherwise(False)
    return F.when(condition.isNull() | limit.isNull(), True).otherwise(test)


def fnv1a(text: Column) -> Column:
    """FNV-1a over 32 bits of the UTF-8 bytes, as a long."""
    digits = F.hex(F.encode(text, "utf-8"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.octet_length(text) - 1, F.lit(0))), lambda i: i < F.octet_length(text))
    return F.aggregate(
        places,
        F.lit(2166136261).cast("long"),
        lambda h, i: F.pmod(h.bitwiseXOR(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")) * F.lit(16777619).cast("long"), F.lit(4294967296).cast("long")),
    )


def topology_product(topology: Column) -> Column:
    """Rows times columns of ``RxC``; 4 for anything else."""
    parts = F.split(topology, "x")
    product = F.try_element_at(parts, F.lit(1)).try_cast("int") * F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.coalesce(F.when(F.size(parts) == 2, product), F.lit(4))


def template_hash(document: Column) -> Column:
    """First eight bytes of the SHA-256, in hex."""
    return F.substring(F.sha2(document, 256), 1, 16)
