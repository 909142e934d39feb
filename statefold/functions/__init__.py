"""Column functions: key groups, expiry, accumulators."""
