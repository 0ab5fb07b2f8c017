"""Operators: fitted once on a DataFrame, then applied as plain DataFrame transforms."""
