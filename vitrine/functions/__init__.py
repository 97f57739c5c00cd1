"""Column functions: text formats, coercions and exact quantiles."""
