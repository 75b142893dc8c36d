"""Column expressions and query analysis."""
