"""Rating plans: column algebra over a policy book."""
