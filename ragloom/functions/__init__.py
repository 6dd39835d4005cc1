"""Column expressions and fixed lexicons."""
