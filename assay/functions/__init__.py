"""Column expressions and small numeric helpers used by the operators."""
