"""Column expressions and small numeric functions."""
