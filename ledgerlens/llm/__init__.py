"""Training-data operators: near-dedup, packing, search, scans, tokenising, scoring and formatting.

Nothing outside this folder imports it.  Each operator is a function from DataFrames to a DataFrame
with column names as parameters; ``queries`` holds the thin contract queries.
"""
