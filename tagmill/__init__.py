"""Tagged events on Spark: a small text language compiled to DataFrame predicates."""
