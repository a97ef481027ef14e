"""Column functions over tags: arrays of strings whose first element is the name and whose second is the value.

Tags may be empty or have a name only, so elements are read with ``try_element_at``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import MOST_ADDRESS_BYTES, is_addressable, is_replaceable

HEX64 = "^[0-9a-fA-F]{64}$"


def name_of(tag: Column) -> Column:
    return F.try_element_at(tag, F.lit(1))


def value_of(tag: Column) -> Column:
    return F.try_element_at(tag, F.lit(2))


def is_single_letter(tag: Column) -> Column:
    return F.coalesce(name_of(tag).rlike("^[A-Za-z]$"), F.lit(False))


def has_value(tags: Column, letter: str, values: Iterable[str]) -> Column:
    """Some tag of that name has one of the values as its first value."""
    values = list(values)
    return F.coalesce(F.exists(tags, lambda t: F.coalesce((name_of(t) == letter) & value_of(t).isin(*values), F.lit(False))), F.lit(False))


def values(tags: Column, name: str) -> Column:
    """First values of all tags of that name that have one."""
    named = F.filter(tags, lambda t: F.coalesce((name_of(t) == name) & value_of(t).isNotNull(), F.lit(False)))
    return F.transform(named, value_of)


def first_d(tags: Column) -> Column:
    """The value of the first tag named d; empty if there is none or it has more than 255 bytes."""
    found = value_of(F.try_element_at(F.filter(tags, lambda t: F.coalesce(name_of(t) == "d", F.lit(False))), F.lit(1)))
    return F.when(F.octet_length(found) <= MOST_ADDRESS_BYTES, found).otherwise("")


def address(kind: Column, pubkey: Column, d: Column) -> Column:
    """kind:pubkey:d of a replaceable (its d is empty) or addressable kind, null of any other."""
    return F.when(is_replaceable(kind), F.concat_ws(":", kind.cast("string"), pubkey, F.lit(""))).when(is_addressable(kind), F.concat_ws(":", kind.cast("string"), pubkey, F.coalesce(d, F.lit(""))))


def named_address(value: Column, pubkey: Column) -> Column:
    """The address that a deletion by ``pubkey`` names, null if it names none or one of another key."""
    parts = F.split(value, ":", 3)
    kind = F.when(F.get(parts, F.lit(0)).rlike("^[0-9]{1,10}$"), F.get(parts, F.lit(0)).try_cast("long"))
    key = F.get(parts, F.lit(1))
    own = key.rlike(HEX64) & (F.lower(key) == pubkey) & (F.octet_length(value) <= MOST_ADDRESS_BYTES)
    return F.when(own, address(kind, pubkey, F.get(parts, F.lit(2))))


def expiration(tags: Column) -> Column:
    """The first value of a tag named expiration that is a whole number of seconds (to 2^63 - 1)."""
    number = F.filter(values(tags, "expiration"), lambda v: v.rlike(r"^\+?[0-9]+$") & v.try_cast("long").isNotNull())
    return F.try_element_at(number, F.lit(1)).try_cast("long")
