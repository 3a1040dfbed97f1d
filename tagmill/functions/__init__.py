"""Columns: how an expression of the language becomes a Spark predicate."""
