"""Catalogue of the areal queries: name, Spark plan and DuckDB twin."""

from __future__ import annotations

from arealith.plans import basics, content, modelled, places, roundtrips, statistics

PARTS = [basics, statistics, places, content, roundtrips, modelled]
flagship = statistics.flagship


def queries():
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
