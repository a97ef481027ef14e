"""The query language: a list of filters, any of which may match, each of whose fields must match."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions import tags as tag
from tidelog.functions import text
from tidelog.schema import DAY, LARGEST_LONG

_HEX64 = re.compile("[0-9a-fA-F]{64}")


class FilterError(ValueError):
    """A filter that the language doesn't have."""


class InvalidTagQuery(FilterError):
    """A tag key that isn't one letter."""


@dataclass(frozen=True)
class Filter:
    ids: tuple[str, ...] | None = None
    authors: tuple[str, ...] | None = None
    kinds: tuple[int, ...] | None = None
    since: int | None = None
    until: int | None = None
    limit: int | None = None
    search: str | None = None
    tags: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    # building

    def with_id(self, value: str) -> Filter:
        return replace(self, ids=(*(self.ids or ()), _hex(value)))

    def with_event(self, value: str) -> Filter:
        return self.with_tag("e", _hex(value))

    def with_author(self, value: str) -> Filter:
        return replace(self, authors=(*(self.authors or ()), _hex(value)))

    def with_kind(self, value: int) -> Filter:
        return replace(self, kinds=(*(self.kinds or ()), _whole(value, 32, "kinds")))

    def with_since(self, value: int) -> Filter:
        return replace(self, since=_whole(value, 64, "since"))

    def with_until(self, value: int) -> Filter:
        return replace(self, until=_whole(value, 64, "until"))

    def with_limit(self, value: int) -> Filter:
        return replace(self, limit=_whole(value, 64, "limit"))

    def with_search(self, value: str) -> Filter:
        return replace(self, search=value)

    def with_tag(self, letter: str, value: str) -> Filter:
        """A name that isn't a letter, or an empty value, changes nothing."""
        if not _is_letter(letter) or not value:
            return self
        return replace(self, tags={**self.tags, letter: (*self.tags.get(letter, ()), value)})

    # JSON

    @classmethod
    def from_value(cls, value: object) -> Filter:
        if not isinstance(value, dict):
            raise FilterError("a filter must be an object")
        found: dict = {}
        tags: dict[str, tuple[str, ...]] = {}
        for key, one in value.items():
            if key.startswith("#"):
                if len(key[1:].encode()) != 1:
                    raise InvalidTagQuery(f"invalid tag query: {key}")
                if not _is_letter(key[1:]):
                    raise FilterError(f"unsupported filter field: {key}")
                many = [one] if isinstance(one, str) else one
                if not isinstance(many, list) or not all(isinstance(x, str) for x in many):
                    raise FilterError(f"{key} must be a string or an array of strings")
                if many:
                    tags[key[1:]] = tuple(many)
            elif key not in ("ids", "authors", "kinds", "since", "until", "limit", "search"):
                raise FilterError(f"unsupported filter field: {key}")
            elif one is None:
                continue
            elif key in ("ids", "authors", "kinds"):
                if not isinstance(one, list):
                    raise FilterError(f"{key} must be an array")
                found[key] = tuple(_whole(x, 32, key) if key == "kinds" else _hex(x) for x in one)
            elif key == "search":
                if not isinstance(one, str):
                    raise FilterError("search must be a string")
                found[key] = one
            else:
                found[key] = _whole(one, 64, key)
        return cls(tags=tags, **found)

    def to_value(self) -> dict:
        out = {k: list(v) if isinstance(v, tuple) else v for k in ("ids", "authors", "kinds", "since", "until", "limit", "search") if (v := getattr(self, k)) is not None}
        return out | {f"#{k}": list(v) for k, v in self.tags.items()}

    def limited(self, default: int | None, most: int | None) -> Filter:
        limit = default if self.limit is None else self.limit
        return replace(self, limit=limit if most is None else most if limit is None else min(limit, most))

    # columns

    @property
    def terms(self) -> list[str]:
        return text.terms(self.search)

    def fields(self, searchable_kinds: list[int] | None = None, by_day: bool = False) -> Column:
        """Holds for the notes that match in all but their text (false or null for others).

        Plain conjuncts, so that scans can take them.  ``by_day``: there is a
        column unix_day whose partitions can be left out.
        """
        parts = [F.col(c).isin(*given) for c, given in (("id", self.ids), ("pubkey", self.authors), ("kind", self.kinds)) if given]
        if self.since is not None:
            parts.append(F.col("created_at") >= self.since if self.since <= LARGEST_LONG else F.lit(False))
            if by_day:
                parts.append(F.col("unix_day") >= min(self.since, LARGEST_LONG) // DAY)
        if self.until is not None and self.until <= LARGEST_LONG:
            parts.append(F.col("created_at") <= self.until)
            if by_day:
                parts.append(F.col("unix_day") <= self.until // DAY)
        parts += [tag.has_value(F.col("tags"), letter, given) for letter, given in self.tags.items() if given]
        if self.terms and searchable_kinds is not None:
            parts.append(F.col("kind").isin(*searchable_kinds) if searchable_kinds else F.lit(False))
        return all_of(parts)

    def text_has_terms(self, search_text: Column) -> Column:
        return all_of([F.contains(search_text, F.lit(t)) for t in dict.fromkeys(self.terms)])


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def parse_filters(given: str | dict | list, default_limit: int | None = None, max_limit: int | None = None) -> list[Filter]:
    """One filter for an object, one for each of an array; an empty array is a filter that matches all."""
    try:
        value = json.loads(given) if isinstance(given, str) else given
    except json.JSONDecodeError as e:
        raise FilterError(f"invalid JSON: {e}") from e
    many = [value] if isinstance(value, dict) else value
    if not isinstance(many, list):
        raise FilterError("filters must be an object or an array of objects")
    return [f.limited(default_limit, max_limit) for f in map(Filter.from_value, many)] or [Filter().limited(default_limit, max_limit)]


def _is_letter(name: str) -> bool:
    return len(name) == 1 and name.isascii() and name.isalpha()


def _hex(value: object) -> str:
    if not isinstance(value, str) or not _HEX64.fullmatch(value):
        raise FilterError(f"not 64 hexadecimal digits: {value!r}")
    return value.lower()


def _whole(value: object, bits: int, key: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 1 << bits:
        raise FilterError(f"{key} must be a whole number of at most {bits} bits")
    return value
