"""Plans: pages of a query, dense numbering, cutting lineage."""
