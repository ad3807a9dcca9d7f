"""Column expressions: type coercion, the time grid, report text."""
