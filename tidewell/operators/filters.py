"""Metadata filters as column expressions; on real columns they reach the Parquet scan."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From a key to its column: by default a column of that name.
Get = Callable[[str], Column]


def from_map(metadata: str = "metadata") -> Get:
    """Keys looked up in a map column of strings."""
    return lambda key: F.col(metadata)[key]


@dataclass(frozen=True)
class Term:
    """The value's string equals `value`; a missing key counts as ""."""

    key: str
    value: str

    def column(self, get: Get = F.col) -> Column:
        hit = get(self.key).cast("string") == self.value
        return F.coalesce(hit, F.lit(self.value == "")) if self.value == "" else hit


@dataclass(frozen=True)
class TermIn:
    """The value's string is one of `values`."""

    key: str
    values: tuple[str, ...]

    def column(self, get: Get = F.col) -> Column:
        return get(self.key).cast("string").isin(*self.values)


@dataclass(frozen=True)
class Range:
    """The value as a number lies between the bounds, either of them open or closed; what isn't a number never does."""

    key: str
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False

    def column(self, get: Get = F.col) -> Column:
        x, out = get(self.key), F.lit(True)
        x = x.try_cast("double")
        if self.low is not None:
            out = out & (x > self.low if self.low_open else x >= self.low)
        if self.high is not None:
            out = out & (x < self.high if self.high_open else x <= self.high)
        return out & x.isNotNull()


@dataclass(frozen=True)
class DateRange:
    """The value as a time (RFC 3339, or a bare date) lies in [start, end]; what isn't a time never does."""

    key: str
    start: str | None = None
    end: str | None = None

    def column(self, get: Get = F.col) -> Column:
        t, out = get(self.key).try_cast("timestamp"), F.lit(True)
        if self.start:
            out = out & (t >= F.lit(self.start).cast("timestamp"))
        if self.end:
            out = out & (t <= F.lit(self.end).cast("timestamp"))
        return out & t.isNotNull()


@dataclass(frozen=True)
class Year:
    """The value's year compares with `year` by eq, ne, gt, gte, lt or lte; what isn't a time never does."""

    key: str
    year: int
    how: str = "eq"

    def column(self, get: Get = F.col) -> Column:
        y = F.year(get(self.key).try_cast("timestamp"))
        return F.coalesce(getattr(operator, {"gte": "ge", "lte": "le"}.get(self.how, self.how))(y, F.lit(self.year)), F.lit(False))


def all_of(filters: list, get: Get = F.col) -> Column:
    """All filters (or columns) hold; None is skipped."""
    parts = [f if isinstance(f, Column) else f.column(get) for f in filters if f is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))
