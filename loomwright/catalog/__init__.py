"""Runnable queries over the driver tables, each with its DuckDB twin where SQL can say it."""

from loomwright.catalog.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
