"""Column expressions and sketch aggregates."""
