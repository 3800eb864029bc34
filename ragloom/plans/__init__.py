"""Composed jobs (X1-X5) and the query catalogue with its DuckDB oracles."""
