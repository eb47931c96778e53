"""Column expressions: text, numbers, vectors, intervals."""
