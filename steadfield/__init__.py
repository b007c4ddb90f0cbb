"""Lossy compression of numeric fields with exact restoration of their integral invariants, on Spark DataFrames."""
