"""Steward: declarative table quality, run tracking, sheet ingest and schema drift on Spark."""
