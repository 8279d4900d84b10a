"""Versioned file-inventory analytics on Spark: manifests are DataFrames, operators are functions between them."""
