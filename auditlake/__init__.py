"""Spark library for auditing version-history packages held as tables."""
