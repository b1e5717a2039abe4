"""Size proofs that decide how a plan is shaped."""
