"""Ordered-sequence and byte-string analytics on Spark DataFrames."""
