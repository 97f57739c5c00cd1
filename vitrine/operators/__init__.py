"""The analyses: each is a function from DataFrames to a lazy DataFrame."""
