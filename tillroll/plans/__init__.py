"""Query catalogue: Spark plans per query name and their DuckDB oracle SQL."""
