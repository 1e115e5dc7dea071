"""Registered queries of the library."""

from __future__ import annotations

from tallystone.registry import ORACLES, QUERIES

from . import decisions, details, events, flows, keys, offers, products, records, reports, scalars, selection, series, stats, store, usage  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
