"""The report queries, each a function from a cohort to a DataFrame."""
