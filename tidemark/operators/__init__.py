"""Relational operators: filters, joins, aggregates, dedup, ranking, spatial and graph reads."""
