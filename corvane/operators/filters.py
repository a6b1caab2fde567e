"""Filters over relationship IDs or entry IDs.

A list of filters is a conjunction. The first enumerates and orders the rows (multiset semantics:
a row for each matching relationship ID), the others are existence tests on the entry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Match:
    """Entries that carry ``rel_id`` under ``key``."""

    key: str
    rel_id: str


@dataclass(frozen=True)
class InverseMatch:
    """As first filter: a row for each relationship ID other than ``rel_id``. As a later filter: entries without ``rel_id``."""

    key: str
    rel_id: str


@dataclass(frozen=True)
class Comparison:
    """A predicate on the IDs under ``key``, or on the entry ID if ``key`` is empty, within inclusive bounds.

    ``predicate`` maps a Column to a boolean Column and stays in the JVM. ``python`` takes a string and
    returns a bool; it runs Arrow-batched on the distinct IDs only. ``stop_when`` ends a first filter
    before the first (relationship ID, entry ID) for which it holds; elsewhere such an ID just fails.
    """

    key: str
    predicate: Callable[[Column], Column] | None = None
    start: str = ""
    end: str = ""
    python: Callable[[str], bool] | None = None
    stop_when: Callable[[Column], Column] | None = None

    def native(self, rel_id: Column) -> Column:
        """The part that Catalyst can push down."""
        out = F.lit(True)
        if self.start:
            out = out & (rel_id >= F.lit(self.start))
        if self.end:
            out = out & (rel_id <= F.lit(self.end))
        if self.predicate is not None:
            out = out & F.coalesce(self.predicate(rel_id), F.lit(False))
        return out


Filter = Match | InverseMatch | Comparison


def comparison_with_range(key: str, start: str, end: str, predicate: Callable[[Column], Column] | None = None) -> Comparison:
    return Comparison(key, predicate, start, end)


def less_than(key: str, bound: str) -> Comparison:
    return Comparison(key, lambda c: c < bound, end=bound)


def less_than_or_equal_to(key: str, bound: str) -> Comparison:
    return Comparison(key, end=bound) if bound else Comparison(key, lambda c: c <= bound)


def greater_than(key: str, bound: str) -> Comparison:
    return Comparison(key, lambda c: c > bound, start=bound)


def greater_than_or_equal_to(key: str, bound: str) -> Comparison:
    return Comparison(key, start=bound)


def in_range(key: str, start: str, end: str) -> Comparison:
    """Inclusive at both ends; an empty bound is open."""
    return Comparison(key, start=start, end=end)


def checked(filters: object) -> list[Filter]:
    """The filters as a list; anything that isn't one is refused by its type's name."""
    out = list(filters or [])
    for f in out:
        if not isinstance(f, Match | InverseMatch | Comparison):
            raise TypeError(f"unsupported filter type {type(f).__name__}")
    return out
