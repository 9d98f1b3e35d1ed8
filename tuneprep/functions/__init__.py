"""Column expressions: narrow, shuffle-free building blocks."""
