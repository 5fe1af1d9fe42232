"""DuckDB oracle SQL for the driver's correctness gate (independent re-statement)."""
