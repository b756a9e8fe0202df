"""Column helpers: exact rounding, text, dates, buckets and test statistics."""
