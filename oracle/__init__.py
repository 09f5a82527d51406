"""DuckDB statements that answer every registered query independently of Spark."""
