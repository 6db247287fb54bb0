"""Registered queries: operators applied to the driver's tables, each with its DuckDB twin where SQL can say it."""
