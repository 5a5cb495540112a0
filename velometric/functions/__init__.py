"""Column expressions and month arithmetic."""
