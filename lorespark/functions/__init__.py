"""Column expressions, and Arrow functions where Spark has no equivalent."""
