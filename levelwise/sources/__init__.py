"""Where cohorts come from and where results go."""
