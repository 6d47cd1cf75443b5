"""Continuous assessment."""
