"""Column helpers that settle null, rounding, time and quantile semantics once."""
