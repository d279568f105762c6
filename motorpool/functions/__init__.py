"""Column expressions: no Python ever runs per row."""
