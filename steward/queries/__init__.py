"""Registered queries and their SQL, by theme."""

from . import drift, quality, runs, sheets, sinks

QUERIES = {**quality.QUERIES, **runs.QUERIES, **drift.QUERIES, **sheets.QUERIES, **sinks.QUERIES}
ORACLES = {**quality.ORACLES, **runs.ORACLES, **drift.ORACLES, **sheets.ORACLES, **sinks.ORACLES}
