"""Column expressions: rounding, predicates, calendar labels, rank statistics."""
