"""All queries of the library with their oracle SQL."""

from __future__ import annotations

from keyloom.plans import applications, auctions, patterns
from keyloom.streaming import queries as streams

PLANS = (auctions, applications, patterns, streams)


def queries() -> dict:
    return {n: f for p in PLANS for n, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for p in PLANS for n, s in p.ORACLE_SQL.items()}
