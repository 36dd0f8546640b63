"""Queries over the driver tables, each with its DuckDB twin where SQL can say it."""
