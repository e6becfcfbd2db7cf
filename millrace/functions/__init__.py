"""Column expressions: text and arrays."""
