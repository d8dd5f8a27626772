"""Column expressions and exact distributed order statistics."""
