"""Column expressions: metrics and categories."""
