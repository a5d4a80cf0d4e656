"""Column functions: NULL-safe arithmetic, window indicators, recursive filters, statistics."""
