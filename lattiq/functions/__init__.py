"""Column expressions: text, distances, statistics."""
