"""All queries of the telemetry engine, and their SQL."""

from __future__ import annotations

from . import histograms, logs, metrics, traces

MODULES = (metrics, histograms, logs, traces)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in MODULES for k, f in m.SQL.items()}
