"""Scalar functions as Column expressions, with Python only where SQL can't say it."""
