"""The command language: tokens, grammar and rules. Plain Python, no Spark."""
