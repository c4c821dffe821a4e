"""DuckDB oracle SQL, written independently of the Spark operators."""
