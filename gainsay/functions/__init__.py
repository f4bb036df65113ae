"""Column expressions: text, time, and per-artifact field extraction."""
