"""All queries of the library's own operators and their SQL, by name."""

from __future__ import annotations

from tidewell.plans import answers, flows, graph, ingest, search  # noqa: F401
from tidewell.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
