"""Column expressions and fixed domain values."""
